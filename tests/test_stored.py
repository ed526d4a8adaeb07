"""Stored tables follow their sources."""

import os

import pytest

from binloom.sources.stored import dropped_versions, fresh_table, source_state


def test_fresh_table(spark, tmp_path):
    source, path, calls = tmp_path / "in", f"file://{tmp_path}/out", []
    spark.range(10).write.csv(str(source))

    def build():
        calls.append(1)
        return spark.read.csv(str(source), schema="v long").selectExpr("v * 2 AS w")

    def total(**kwargs):
        return fresh_table(spark, [str(source)], path, build, **kwargs).agg({"w": "sum"}).head()[0]

    assert total() == 90 and total() == 90 and len(calls) == 1  # unchanged: not built again
    assert total(parameters={"factor": 2}) == 90 and len(calls) == 2
    old = fresh_table(spark, [str(source)], path, build)
    (source / "part-more.csv").write_text("100\n")
    assert total() == 290 and len(calls) == 3
    assert old.agg({"w": "sum"}).head()[0] == 90  # readers keep the table they opened
    assert dropped_versions(spark, [str(source)], path) == 2
    assert total() == 290 and len(calls) == 3
    before = source_state(spark, [str(source)])
    os.utime(source / "part-more.csv", (1, 1))  # same size, other time
    assert source_state(spark, [str(source)]) != before
    assert total() == 290 and len(calls) == 4


def test_failed_build_leaves_no_table(spark, tmp_path):
    source, path = tmp_path / "in", f"file://{tmp_path}/out"
    spark.range(3).write.csv(str(source))

    def broken():
        return spark.read.csv(str(source), schema="v long").selectExpr("raise_error('no') AS w")

    with pytest.raises(Exception, match="no"):
        fresh_table(spark, [str(source)], path, broken)
    assert fresh_table(spark, [str(source)], path, lambda: spark.range(1)).count() == 1
