"""Queries over region features."""

from __future__ import annotations

from pyspark.sql import functions as F

from binloom.functions.columns import rounded
from binloom.operators import features as X
from binloom.operators import wide
from binloom.params import MARKS, PATTERNS
from binloom.plans import adapters as A
from binloom.plans.sql import r6, with_ctes

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def _long(spark, sf, names):
    return X.long_features(A.roi_features(spark, sf), names).withColumn("value", rounded(F.col("value")))


_SPATIAL = " UNION ALL ".join(
    f"SELECT roi, mark || '_' || stage || '_{out}' AS feature, {r6(col)} AS value FROM spatial"
    for out, col in (("coverage", "coverage"), ("nseg", "nseg"), ("com", "com"), ("local_var", "local_var"))
) + f""" UNION ALL SELECT s.roi, s.mark || '_' || s.stage || '_maxseg_bins', {r6('coalesce(maxseg, 0)')}
    FROM spatial s LEFT JOIN maxseg m ON m.roi = s.roi AND m.mark = s.mark AND m.stage = s.stage"""


@query("roi_spatial", with_ctes(_SPATIAL, "spatial", "maxseg"))
def roi_spatial(spark, sf):
    return _long(spark, sf, X.spatial_names())


_PATTERNS = " UNION ALL ".join(
    f"SELECT roi, mark || '_pattern_{p}' AS feature, {r6(f'avg(CASE WHEN pat = {chr(39)}{p}{chr(39)} THEN 1 ELSE 0 END)')} AS value FROM pats GROUP BY roi, mark"
    for p in PATTERNS
) + f""" UNION ALL SELECT roi, mark || '_delta_cov_d7_d0', {r6("avg(b) - avg(a)")} FROM pats GROUP BY roi, mark
    UNION ALL SELECT roi, mark || '_delta_cov_d15_d7', {r6("avg(c) - avg(b)")} FROM pats GROUP BY roi, mark"""
_PATS = """pats AS (SELECT roi, mark, i, max(v) FILTER (WHERE stage = 'd0') AS a, max(v) FILTER (WHERE stage = 'd7') AS b,
    max(v) FILTER (WHERE stage = 'd15') AS c, CAST(a AS VARCHAR) || CAST(b AS VARCHAR) || CAST(c AS VARCHAR) AS pat
    FROM roibins GROUP BY roi, mark, i)"""


@query("roi_patterns", with_ctes(_PATTERNS, "roibins", extra=(_PATS,)))
def roi_patterns(spark, sf):
    return _long(spark, sf, X.temporal_names())


_RANK = "list_position([" + ",".join(f"'{m}'" for m in MARKS) + "], {0})"
_JACC = f"""jac AS (SELECT a.roi, a.stage, a.mark AS ma, b.mark AS mb,
    sum(a.v * b.v) / nullif(sum(greatest(a.v, b.v)), 0) AS j FROM roibins a JOIN roibins b ON a.roi = b.roi
    AND a.stage = b.stage AND a.i = b.i AND {_RANK.format('a.mark')} < {_RANK.format('b.mark')} GROUP BY ALL)"""


@query(
    "roi_jaccard",
    with_ctes(
        f"""SELECT roi, ma || '_vs_' || mb || '_' || stage || '_jaccard' AS feature, {r6('j')} AS value FROM jac
        UNION ALL SELECT roi, 'mean_jaccard_' || stage, {r6('avg(j)')} FROM jac GROUP BY roi, stage""",
        "roibins",
        extra=(_JACC,),
    ),
)
def roi_jaccard(spark, sf):
    return _long(spark, sf, X.jaccard_names())


_HDC = f"""d AS (SELECT roi, mark, max(coverage) FILTER (WHERE stage = 'd7') - max(coverage) FILTER (WHERE stage = 'd0') AS d1,
    max(coverage) FILTER (WHERE stage = 'd15') - max(coverage) FILTER (WHERE stage = 'd7') AS d2 FROM spatial GROUP BY roi, mark)"""


@query(
    "roi_hdc",
    with_ctes(
        f"""SELECT a.roi, 'HDC_' || a.mark || '_vs_' || b.mark || '_cos' AS feature,
        {r6('''CASE WHEN sqrt(a.d1*a.d1 + a.d2*a.d2) < 1e-8 OR sqrt(b.d1*b.d1 + b.d2*b.d2) < 1e-8 THEN 0
        ELSE greatest(-1, least(1, (a.d1*b.d1 + a.d2*b.d2) / (sqrt(a.d1*a.d1 + a.d2*a.d2) * sqrt(b.d1*b.d1 + b.d2*b.d2)))) END''')} AS value
        FROM d a JOIN d b ON a.roi = b.roi AND {_RANK.format('a.mark')} < {_RANK.format('b.mark')}""",
        "spatial",
        extra=(_HDC,),
    ),
)
def roi_hdc(spark, sf):
    return _long(spark, sf, X.concordance_names())


@query(
    "roi_net_change",
    with_ctes(
        f"""SELECT roi, mark, {r6("CASE WHEN max(greatest(a, b, c)) = 0 THEN NULL ELSE (sum(CASE WHEN a = 0 AND b = 1 THEN 1 ELSE 0 END) - sum(CASE WHEN a = 1 AND b = 0 THEN 1 ELSE 0 END)) / count(*) END")} AS d_first,
        {r6("CASE WHEN max(greatest(a, b, c)) = 0 THEN NULL ELSE (sum(CASE WHEN b = 0 AND c = 1 THEN 1 ELSE 0 END) - sum(CASE WHEN b = 1 AND c = 0 THEN 1 ELSE 0 END)) / count(*) END")} AS d_second
        FROM pats GROUP BY roi, mark""",
        "roibins",
        extra=(_PATS,),
    ),
)
def roi_net_change(spark, sf):
    return X.net_change(A.roi_masks(spark, sf)).select(
        "roi", "mark", rounded(F.col("d_first")).alias("d_first"), rounded(F.col("d_second")).alias("d_second")
    )


_BALANCE = """bal AS (SELECT roi, sum(CASE WHEN mark IN ('H3K4me1','H3K27ac') THEN coverage WHEN mark IN ('H3K9me3','H3K27me3')
    THEN -coverage ELSE 0 END * CASE stage WHEN 'd15' THEN 1 WHEN 'd0' THEN -1 ELSE 0 END) AS raw FROM spatial GROUP BY roi)"""


@query(
    "switch_score",
    with_ctes(
        f"SELECT roi, {r6('(raw - avg(raw) OVER ()) / stddev_samp(raw) OVER ()')} AS switch_score FROM bal",
        "spatial",
        extra=(_BALANCE,),
    ),
)
def switch_score(spark, sf):
    return X.switch_score(A.roi_features(spark, sf)).withColumn("switch_score", rounded(F.col("switch_score")))


_WIDE = {
    "rois": (
        f"""rois AS (SELECT chrom, tile * width * 200 AS "start", least(tile * width + width, last + 1) * 200 AS "end",
        chrom || ':' || width || ':' || tile AS roi FROM (SELECT *, unnest(range(0, last // width + 1)) AS tile FROM
        (SELECT 'chr' || s_suppkey AS chrom, last, unnest([{', '.join(map(str, A.WIDE_BINS))}, last + 1]) AS width
         FROM supplier, (SELECT max(bin) AS last FROM cells))))""",
        ["cells"],
    )
}


def _wide_long(spark, sf, names):
    found = wide.region_features(A.wide_rois(spark, sf), A.words(spark, sf))
    return X.long_features(found, names).withColumn("value", rounded(F.col("value")))


@query("wide_spatial", with_ctes(_SPATIAL, "spatial", "maxseg", instead=_WIDE))
def wide_spatial(spark, sf):
    return _wide_long(spark, sf, X.spatial_names())


@query("wide_patterns", with_ctes(_PATTERNS, "roibins", extra=(_PATS,), instead=_WIDE))
def wide_patterns(spark, sf):
    return _wide_long(spark, sf, X.temporal_names())


@query(
    "wide_jaccard",
    with_ctes(
        f"""SELECT roi, ma || '_vs_' || mb || '_' || stage || '_jaccard' AS feature, {r6('j')} AS value FROM jac
        UNION ALL SELECT roi, 'mean_jaccard_' || stage, {r6('avg(j)')} FROM jac GROUP BY roi, stage""",
        "roibins",
        extra=(_JACC,),
        instead=_WIDE,
    ),
)
def wide_jaccard(spark, sf):
    return _wide_long(spark, sf, X.jaccard_names())
