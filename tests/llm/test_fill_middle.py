"""Fill-in-the-middle texts against a plain version, and their round trip."""

import hashlib
import random
import re

import pytest
from test_text_operators import odd_texts, table

from binloom.llm import fill_middle
from binloom.llm.fill_middle import Rates, fill_in_middle, fill_in_middle_digests, restored_parts


def plain_version(doc_id, text, rates=Rates()):
    """n, form, prefix_chars, middle_chars, output of one text, straight from the definition."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    drawn = hashlib.sha256(f"{rates.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(drawn[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(lines)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rates.transformed:
        return n, "plain", None, None, text
    prefix, middle, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    spm = h[3] % 100 < rates.suffix_first
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return n, "spm" if spm else "psm", len(prefix), len(middle), output


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    lines = ["\n".join("é漢 x"[: rng.randint(0, 4)] * rng.randint(0, 9) for _ in range(rng.randint(1, 30))) for _ in range(150)]
    marks = ["a<P>b\nc", "<S>", "x\n<M>\ny", "<<P", "<P<\n<S\nM>\n>P>", "\n", "\n\n\n", "no end", "one\r\ntwo\x85three four\n"]
    return [None, "", *odd_texts(200), *lines, *marks, "long " * 30_000, "many\n" * 30_000]


@pytest.mark.parametrize("piece_bytes", [1 << 15, 7])
def test_digests_equal_plain_version(spark, texts, monkeypatch, piece_bytes):
    texts = texts if piece_bytes > 7 else texts[:-2]
    monkeypatch.setattr(fill_middle, "PIECE_BYTES", piece_bytes)
    ids = [None, *range(1, len(texts))]
    got = sorted(map(tuple, fill_in_middle_digests(table(spark, texts, ids).repartition(3)).collect()), key=str)
    want = []
    for i, t in zip(ids, texts):
        *facts, output = plain_version(i, t)
        want.append((i, *facts, sha(output), sha(t or "")))
    assert got == sorted(want, key=str)


def test_outputs_and_rates(spark, texts):
    rates = Rates(seed=11, transformed=60, suffix_first=20)
    got = {tuple(r) for r in fill_in_middle(table(spark, texts), rates).collect()}
    assert got == {(i, *plain_version(i, t, rates)) for i, t in enumerate(texts)}
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_repeated_rows_and_ties(spark):
    texts = ["a\nb\nc\nd\n"] * 40 + ["a\nb\nc\nd"] * 3 + [None, "", None]
    ids = [5] * 40 + [5] * 3 + [None, None, 9]
    got = sorted(map(tuple, fill_in_middle_digests(table(spark, texts, ids)).collect()), key=str)
    want = []
    for i, t in zip(ids, texts):
        *facts, output = plain_version(i, t)
        want.append((i, *facts, sha(output), sha(t or "")))
    assert got == sorted(want, key=str)
    assert fill_in_middle_digests(table(spark, texts, ids).limit(0)).count() == 0
    assert fill_in_middle(table(spark, texts, ids)).count() == len(ids)


def test_marks_across_pieces():
    for text, form in ((b"<S>ab<<P>c<M>d", "spm"), (b"<P><S><M>", "psm"), (b"<P>x<S>y<<M>", "psm"), (b"<P>", "plain")):
        for size in range(1, len(text) + 1):
            parts = list(restored_parts((text[k : k + size] for k in range(0, len(text), size)), form))
            whole = [b"".join(p for place, p in parts if place == k) for k in range(3)]
            want = {"plain": [text, b"", b""], b"<S>ab<<P>c<M>d": [b"c", b"d", b"ab<"], b"<P><S><M>": [b""] * 3}
            assert whole == want.get("plain" if form == "plain" else text, [b"x", b"", b"y<"])
    with pytest.raises(ValueError):
        list(restored_parts([b"<P>a<S>b"], "psm"))
