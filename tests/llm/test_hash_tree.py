"""The hash tree against a plain version, its movement, and the numbering of shards."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
from test_text_operators import table

from binloom.llm.hash_tree import Shard, sharded, slots, tree, with_shard, write_shards

WEIGHTED = (
    *(Shard(k, "north", f"n{k % 2}", w) for k, w in enumerate((1.0, 2.0, 3.0, 0.0))),
    *(Shard(k, "south", "s", w) for k, w in ((10, 4.0), (11, 0.5))),
    Shard(20, "west", "w", 1.5),
)


def descend(key, nodes, salt="tree"):
    """Shard of a key, one level after the other."""
    below = defaultdict(Counter)
    for s in nodes:
        for parent, child in (("", s.region), (s.region, s.rack), (s.rack, str(s.shard))):
            below[parent][child] += s.weight
    at = ""
    for level in range(3):
        draws = []
        for child, weight in below[at].items():
            digest = hashlib.md5(f"{salt}:{level}:{child}:{'' if key is None else key}".encode()).hexdigest()
            if weight:
                draws.append((-math.log((int(digest[:13], 16) + 0.5) / 16**13) / weight, child))
        at = min(draws)[1]
    return int(at)


def placed(spark, keys, nodes, salt="tree"):
    rows = spark.createDataFrame([(k,) for k in keys], "key long")
    return {r["key"]: r["s"] for r in with_shard(rows, rows["key"], nodes, "s", salt).collect()}


def test_equals_plain_version(spark):
    keys = [None, -5, *range(500)]
    for nodes in (WEIGHTED, tree(8), tree(11)):
        assert placed(spark, keys, nodes) == {k: descend(k, nodes) for k in keys}
    assert placed(spark, keys, WEIGHTED, "other") != placed(spark, keys, WEIGHTED)


def test_shares_follow_weights(spark):
    got = Counter(placed(spark, range(20_000), WEIGHTED).values())
    total = sum(s.weight for s in WEIGHTED)
    assert got[3] == 0
    for s in WEIGHTED:
        assert abs(got[s.shard] - 20_000 * s.weight / total) < 5 * math.sqrt(20_000 * s.weight / total + 1)


def test_movement_stays_in_changed_subtrees(spark):
    keys = range(8000)
    for few, many in ((8, 9), (9, 10), (8, 12)):  # growth takes rows only into the new shards
        before, after = placed(spark, keys, tree(few)), placed(spark, keys, tree(many))
        moved = {k for k in keys if before[k] != after[k]}
        assert moved and all(after[k] >= few for k in moved)
        assert abs(len(moved) - 8000 * (1 - few / many)) < 200
    region = {s.shard: s.region for s in tree(8)}
    heavier = tuple(Shard(s.shard, s.region, s.rack, 3.0 if s.shard == 5 else 1.0) for s in tree(8))
    before, after = placed(spark, keys, tree(8)), placed(spark, keys, heavier)
    moved = [k for k in keys if before[k] != after[k]]
    assert moved and all(region[after[k]] == region[5] for k in moved)  # into the region that grew
    inside = [k for k in moved if region[before[k]] == region[5]]
    assert inside and all(after[k] in (4, 5) for k in inside)  # and there into the rack that grew


def test_rows_slots_and_cases(spark):
    texts = [None, "", "é漢", "same", "same", *[f"text {k}" for k in range(300)]]
    ids = [None, None, 3, 4, 4, *range(10, 310)]
    docs = table(spark, texts, ids).repartition(5)
    got = sharded(docs, tree(8), tree(9)).collect()
    plain = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), descend(i, tree(8)), descend(i, tree(9))) for i, t in zip(ids, texts))
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got) == plain
    numbered = defaultdict(list)
    for r in got:
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 8)
        numbered[r["shard"]].append((r["slot"], -1 if r["doc_id"] is None else r["doc_id"]))
    for rows in numbered.values():
        rows.sort()
        assert [slot for slot, _ in rows] == list(range(len(rows)))
        assert [i for _, i in rows] == sorted(i for _, i in rows)
    assert {r["grown_shard"] for r in sharded(docs, tree(8)).collect()} == {None}
    assert sharded(docs.limit(0), tree(8)).count() == 0


def test_slots_of_one_hot_id(spark):
    rows = spark.range(0, 30_000, 1, 6).selectExpr("cast(7 as long) AS id", "cast(1 as int) AS shard")
    got = slots(rows)
    assert got.agg({"slot": "max"}).head()[0] == 29_999 and got.select("slot").distinct().count() == 30_000


def test_written_shards(spark, tmp_path):
    docs = table(spark, [f"t{k}" for k in range(200)]).withColumnRenamed("key", "shard")
    write_shards(docs, tree(8), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == set(docs.columns)
    assert {r["doc_id"]: r["shard"] for r in back.collect()} == {k: descend(k, tree(8)) for k in range(200)}


def test_bad_trees():
    for nodes in ((), (Shard(1, "a", "b"), Shard(1, "a", "c")), (Shard(1, "a", "b", -1.0),), (Shard(1, "a", "b", 0.0),), (Shard(1, "a", "x"), Shard(2, "b", "x"))):
        with pytest.raises(ValueError):
            with_shard(None, None, nodes, "s")
    with pytest.raises(ValueError):
        tree(7)
