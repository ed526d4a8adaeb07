"""Tables that queries write on the way hold the columns they use and no others."""

import pytest

from binloom.plans import adapters, interval_queries, table_queries

REGION = {"chrom", "rid", "start", "end"}


@pytest.mark.parametrize(
    "queries, name, wanted",
    [
        (table_queries, "density_per_kb", [{"chrom", "pos"}, {"chrom", "start", "end", "cluster"}]),
        (interval_queries, "nearest_point_ties", [REGION, {"chrom", "pos"}]),
    ],
)
def test_written_columns(spark, monkeypatch, queries, name, wanted):
    real, written = adapters.cut_lineage, []

    def noted(df, *args, **kwargs):
        written.append(set(df.columns))
        if wanted[-1] == written[-1]:
            raise InterruptedError
        return real(df, *args, **kwargs)

    monkeypatch.setattr(adapters, "cut_lineage", noted)
    with pytest.raises(InterruptedError):
        queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert [w for w in written if w in wanted] == wanted
