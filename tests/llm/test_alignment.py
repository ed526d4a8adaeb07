"""Token alignment against a plain version, on odd texts and small corpora."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from test_text_operators import BYTE, odd_texts, table

from binloom.llm import alignment
from binloom.llm.alignment import PAIR_BITS, ByteSide, PieceSide, align, alignment_counts
from binloom.llm.encoders import tokenizer_path

PIECES = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sides():
    return ByteSide(BYTE), PieceSide(PIECES)


def ends_of(ids, table):
    return np.cumsum([table.lengths[k] for k in ids]).tolist()


def plain_alignment(ids_a, ids_b, table_a, table_b):
    """Groups as text and links, by comparing all tokens."""
    ends_a, ends_b = ends_of(ids_a, table_a), ends_of(ids_b, table_b)
    groups, from_a, from_b = [], 0, 0
    for end in sorted({*ends_a} & {*ends_b}):
        to_a, to_b = ends_a.index(end) + 1, ends_b.index(end) + 1
        groups.append(",".join(map(str, ids_a[from_a:to_a])) + "|" + ",".join(map(str, ids_b[from_b:to_b])))
        from_a, from_b = to_a, to_b
    links = [
        (a, b)
        for i, a in enumerate(ids_a)
        for j, b in enumerate(ids_b)
        if max(ends_a[i] - table_a.lengths[a], ends_b[j] - table_b.lengths[b]) < min(ends_a[i], ends_b[j])
    ]
    return groups, links


def test_sides_equal_libraries(sides):
    a, b = sides
    texts = [*odd_texts(), "x <|endoftext|> <s> </s> <unk>", "▁a▁ b"]
    want = [e.ids for e in a.tokenizer.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert [ids.tolist() for ids in a.encoded(texts)] == want
    assert all(a.table.joined(ids) == b" " + t.encode() for t, ids in zip(texts, a.encoded(texts)))
    assert [ids.tolist() for ids in b.encoded(texts)] == b.model.encode(texts)
    assert b.table.joined(b.encoded(["a é 漢\n😀"])[0]) == " a é 漢\n😀".encode()


@pytest.mark.parametrize("block", [1 << 16, 3])
def test_alignment_equals_plain_version(sides, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK", block)
    a, b = sides
    for text in odd_texts(500, seed=9)[:500]:
        ids_a, ids_b = a.encoded([text])[0], b.encoded([text])[0]
        if not text or b.table.joined(ids_b) != b" " + text.encode():
            continue
        n, links, digest = align(ids_a, ids_b, a.table.lengths, b.table.lengths)
        groups, want = plain_alignment(ids_a.tolist(), ids_b.tolist(), a.table, b.table)
        assert (n, digest) == (len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest())
        assert sorted((x >> PAIR_BITS, x & (1 << PAIR_BITS) - 1) for x in links.tolist()) == sorted(want)


def plain_counts(texts, ids, sides):
    """The rows of the operator for a small corpus."""
    a, b = sides
    made = []
    for text in texts:
        text = text or ""
        ids_a, ids_b = (s.encoded([text])[0] for s in sides)
        fits = text and all(s.table.joined(k) == b" " + text.encode() for s, k in ((a, ids_a), (b, ids_b)))
        made.append((ids_a.tolist(), ids_b.tolist(), *plain_alignment(ids_a.tolist(), ids_b.tolist(), a.table, b.table)) if fits else ([], [], [], []))
    held = Counter(pair for row in made for pair in set(row[3]))
    top = {}
    for (x, _), n in held.items():
        top[x] = max(top.get(x, 0), n)
    return [
        (i, len(x), len(y), len(g), len(k), sum(held[p] == top[p[0]] for p in k), sum(held[p] for p in k))
        + (hashlib.sha256(";".join(g).encode()).hexdigest() if g else "",)
        for i, (x, y, g, k) in zip(ids, made)
    ]


@pytest.mark.parametrize("hot", [100_000, 20])
def test_counts_equal_plain_version(spark, sides, monkeypatch, hot):
    monkeypatch.setattr(alignment, "HOT_PAIRS", hot)  # 20: most pairs are joined by a shuffle
    texts = [None, "", "▁ no tokens", "the cat sat", "the cat sat", *odd_texts(120, seed=4)[:120], "unbelievable " * 30]
    ids = [None, None, 2, 3, 3, *range(10, 10 + len(texts) - 5)]
    got = alignment_counts(table(spark, texts, ids).repartition(4), BYTE, PIECES).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_counts(texts, ids, sides), key=str)


def test_counts_of_no_rows(spark):
    assert alignment_counts(table(spark, ["x"]).limit(0), BYTE, PIECES).count() == 0
    assert [r["n_a"] for r in alignment_counts(table(spark, [None]), BYTE, PIECES).collect()] == [0]


def test_long_text(spark, sides):
    text = "alignment of unusually long texts, " * 24_000
    a, b = sides
    ids_a, ids_b = a.encoded([text])[0], b.encoded([text])[0]
    assert len(ids_a) > 2 * alignment.BLOCK
    n, links, _ = align(ids_a, ids_b, a.table.lengths, b.table.lengths)
    ends = [set(np.cumsum(s.table.lengths[k]).tolist()) for s, k in ((a, ids_a), (b, ids_b))]
    assert (n, len(links)) == (len(ends[0] & ends[1]), len(ends[0] | ends[1]))
