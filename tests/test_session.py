"""Tables that cut a lineage, and scopes that delete them."""

import os

import pytest

from binloom.session import cut_lineage, scratch_tables


def folder(df):
    return os.path.dirname(df.inputFiles()[0].removeprefix("file:"))


def test_scratch_tables_go_and_kept_ones_stay(spark):
    outside = cut_lineage(spark.range(3))
    with scratch_tables(spark):
        inner = cut_lineage(spark.range(10))
        gone = folder(inner)
        with scratch_tables(spark):
            deeper = folder(cut_lineage(inner))
        assert not os.path.exists(deeper) and os.path.exists(gone)
        kept = cut_lineage(inner.where("id < 5"), keep=True)
    assert not os.path.exists(gone)
    assert kept.count() == 5 and outside.count() == 3
    with pytest.raises(ValueError), scratch_tables(spark):
        gone = folder(cut_lineage(spark.range(2)))
        raise ValueError
    assert not os.path.exists(gone)
