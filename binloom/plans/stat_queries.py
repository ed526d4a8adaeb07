"""Queries over ranks, quantiles and hypothesis tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from binloom.functions.columns import rounded
from binloom.operators import density, ranks, tests
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


def r(*names):
    return [rounded(F.col(n)).alias(n) for n in names]


def _lengths(spark, sf):
    return A.regions(spark, sf).select("rid", "stage", "cluster", (F.col("end") - F.col("start")).alias("len"))


_LEN = ('lens AS (SELECT rid, stage, cluster, "end" - "start" AS len FROM regions)',)


def _pvalues(spark, sf):
    return A.table(spark, sf, "events").select(
        "event_id", "event_type", ((F.col("event_id") % 997 + 1) / F.lit(998.0)).alias("p")
    )


_P = "(SELECT event_id, event_type, (event_id % 997 + 1) / 998.0::DOUBLE AS p FROM events)"


@query(
    "bh_adjust",
    f"""SELECT event_id, {r6('least(1, min(p * m / rn) OVER (PARTITION BY event_type ORDER BY p DESC))')} AS p_adjusted
    FROM (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY p) + count(*) OVER (PARTITION BY event_type, p) - 1 AS rn,
      count(*) OVER (PARTITION BY event_type) AS m FROM {_P})""",
)
def bh_adjust(spark, sf):
    return ranks.adjust_p(_pvalues(spark, sf), ["event_type"]).select("event_id", *r("p_adjusted"))


@query(
    "holm_adjust",
    f"""SELECT event_id, {r6('least(1, max(p * (m - rn + 1)) OVER (PARTITION BY event_type ORDER BY p))')} AS p_adjusted
    FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY p) AS rn,
      count(*) OVER (PARTITION BY event_type) AS m FROM {_P})""",
)
def holm_adjust(spark, sf):
    return ranks.adjust_p(_pvalues(spark, sf), ["event_type"], method="holm").select("event_id", *r("p_adjusted"))


@query(
    "average_rank",
    """SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice)
    + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0::DOUBLE AS rank FROM lineitem""",
)
def average_rank(spark, sf):
    lines = A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    return ranks.average_rank(lines, ["l_returnflag"], "l_extendedprice").select(
        "l_orderkey", "l_linenumber", "rank"
    )


@query(
    "length_ecdf",
    with_ctes(f"SELECT DISTINCT stage, len, {r6('cume_dist() OVER (PARTITION BY stage ORDER BY len)')} AS ecdf FROM lens", "regions", extra=_LEN),
)
def length_ecdf(spark, sf):
    return ranks.cumulative_share(_lengths(spark, sf), ["stage"], "len").select("stage", "len", *r("ecdf"))


@query(
    "group_quartiles",
    with_ctes(
        f"""SELECT cluster, stage, {r6('avg(len)')} AS mean, {r6('quantile_cont(len, 0.25)')} AS q25,
        {r6('quantile_cont(len, 0.5)')} AS median, {r6('quantile_cont(len, 0.75)')} AS q75 FROM lens GROUP BY ALL""",
        "regions", extra=_LEN,
    ),
)
def group_quartiles(spark, sf):
    lens = _lengths(spark, sf)
    keys = ["cluster", "stage"]
    quartiles = ranks.quantile_table(lens, keys, "len", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    means = lens.groupBy(*keys).agg(F.avg("len").alias("mean"))
    return quartiles.join(means, keys).select(*keys, *r("mean", "q25", "median", "q75"))


@query(
    "iqr_fence",
    """SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.25) AS q1,
    quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem) WHERE l_extendedprice BETWEEN q1 - 0.25 * (q3 - q1) AND q3 + 0.25 * (q3 - q1)""",
)
def iqr_fence(spark, sf):
    lines = A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return ranks.inside_fence(lines, "l_extendedprice", 0.25)


@query(
    "iqr_outlier_flags",
    with_ctes(
        """SELECT rid, NOT (len BETWEEN q1 - 0.3 * (q3 - q1) AND q3 + 0.3 * (q3 - q1)) AS is_outlier FROM lens JOIN
        (SELECT cluster, quantile_cont(len, 0.25) AS q1, quantile_cont(len, 0.75) AS q3 FROM lens GROUP BY cluster) USING (cluster)""",
        "regions", extra=_LEN,
    ),
)
def iqr_outlier_flags(spark, sf):
    return ranks.outlier_flags(_lengths(spark, sf), ["cluster"], "len", 0.3).select("rid", "is_outlier")


@query(
    "quantile_clip",
    with_ctes(
        f"""SELECT rid, {r6('(least(greatest(len, lo), hi) - lo) / nullif(hi - lo, 0)')} AS scaled FROM lens JOIN
        (SELECT cluster, quantile_cont(len, 0.05) AS lo, quantile_cont(len, 0.95) AS hi FROM lens GROUP BY cluster) USING (cluster)""",
        "regions", extra=_LEN,
    ),
)
def quantile_clip(spark, sf):
    return ranks.clip_and_scale(_lengths(spark, sf), ["cluster"], "len").select("rid", *r("scaled"))


_KW = """rk AS (SELECT *, rank() OVER (PARTITION BY {k} ORDER BY {v}) + (count(*) OVER (PARTITION BY {k}, {v}) - 1) / 2.0 AS rk FROM {t})"""


@query(
    "kruskal_eta2",
    with_ctes(
        f"""SELECT stage, n, k, {r6('h')} AS h, {r6('(h - k + 1) / (n - k)')} AS eta2 FROM (SELECT g.stage, n, k,
        (12.0 * q / (n * (n + 1.0)) - 3.0 * (n + 1)) / (1 - t / (CAST(n AS DOUBLE) * n * n - n)) AS h FROM
        (SELECT stage, sum(rs * rs / c) AS q, CAST(sum(c) AS BIGINT) AS n, count(*) AS k FROM
          (SELECT stage, cluster, sum(CAST(rk AS DOUBLE)) AS rs, count(*) AS c FROM rk GROUP BY ALL) GROUP BY stage) g JOIN
        (SELECT stage, sum(CAST(c AS DOUBLE) * c * c - c) AS t FROM (SELECT stage, len, count(*) AS c FROM lens GROUP BY ALL) GROUP BY stage) USING (stage))""",
        "regions", extra=_LEN + (_KW.format(k="stage", v="len", t="lens"),),
    ),
)
def kruskal_eta2(spark, sf):
    return ranks.kruskal(_lengths(spark, sf), ["stage"], "len", "cluster").select("stage", "n", "k", *r("h", "eta2"))


@query(
    "ks_distance",
    with_ctes(
        f"""SELECT cluster, max(na) AS n_first, max(nb) AS n_second, {r6('max(abs(ca / na - cb / nb))')} AS d FROM
        (SELECT DISTINCT cluster, len, count(*) FILTER (WHERE stage = 'd0') OVER (PARTITION BY cluster) AS na,
          count(*) FILTER (WHERE stage = 'd15') OVER (PARTITION BY cluster) AS nb,
          count(*) FILTER (WHERE stage = 'd0') OVER (PARTITION BY cluster ORDER BY len) AS ca,
          count(*) FILTER (WHERE stage = 'd15') OVER (PARTITION BY cluster ORDER BY len) AS cb FROM lens WHERE stage <> 'd7')
        GROUP BY cluster""",
        "regions", extra=_LEN,
    ),
)
def ks_distance(spark, sf):
    return ranks.ks_distance(_lengths(spark, sf), ["cluster"], "len", "stage", "d0", "d15").select(
        "cluster", "n_first", "n_second", *r("d")
    )


_FOUR = """four AS (SELECT cluster, count(*) FILTER (WHERE len > 800) AS a, count(*) FILTER (WHERE len <= 800) AS b,
    sum(count(*) FILTER (WHERE len > 800)) OVER () - count(*) FILTER (WHERE len > 800) AS c,
    sum(count(*) FILTER (WHERE len <= 800)) OVER () - count(*) FILTER (WHERE len <= 800) AS d FROM lens GROUP BY cluster)"""
_PMF = """pmf AS (SELECT *, exp(lgamma(a + b + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) + lgamma(c + d + 1) - lgamma(a + c - x + 1)
    - lgamma(c + d - a - c + x + 1) - (lgamma(a + b + c + d + 1) - lgamma(a + c + 1) - lgamma(b + d + 1))) AS q FROM
    (SELECT *, unnest(range(CAST(greatest(0, a - d) AS BIGINT), CAST(least(a + b, a + c) + 1 AS BIGINT))) AS x FROM
     (SELECT cluster, CAST(a AS BIGINT) a, CAST(b AS BIGINT) b, CAST(c AS BIGINT) c, CAST(d AS BIGINT) d FROM four)))"""


@query(
    "fisher_exact",
    with_ctes(
        f"""SELECT p.cluster, a, b, c, d, {r6('a * d / nullif(CAST(b AS DOUBLE) * c, 0)')} AS sample_odds_ratio,
        {r6('least(1, sum(q) FILTER (WHERE q <= o.qo * (1 + 1e-7)))')} AS p FROM pmf p JOIN
        (SELECT cluster, q AS qo FROM pmf WHERE x = a) o ON o.cluster = p.cluster GROUP BY p.cluster, a, b, c, d""",
        "regions", extra=_LEN + (_FOUR, _PMF),
    ),
)
def fisher_exact(spark, sf):
    counts = tests.versus_rest(_lengths(spark, sf), "cluster", F.col("len") > 800)
    return tests.fisher(counts).select("cluster", "a", "b", "c", "d", *r("sample_odds_ratio", "p"))


@query(
    "welch_t",
    with_ctes(
        f"""SELECT cluster, {r6('(mx - my) / sqrt(vx / nx + vy / ny)')} AS t,
        {r6('(vx / nx + vy / ny) ** 2 / ((vx / nx) ** 2 / (nx - 1) + (vy / ny) ** 2 / (ny - 1))')} AS df FROM
        (SELECT cluster, avg(len) FILTER (WHERE stage = 'd0') AS mx, avg(len) FILTER (WHERE stage = 'd15') AS my,
         var_samp(len) FILTER (WHERE stage = 'd0') AS vx, var_samp(len) FILTER (WHERE stage = 'd15') AS vy,
         count(*) FILTER (WHERE stage = 'd0') AS nx, count(*) FILTER (WHERE stage = 'd15') AS ny FROM lens GROUP BY cluster)""",
        "regions", extra=_LEN,
    ),
)
def welch_t(spark, sf):
    return tests.welch(_lengths(spark, sf), ["cluster"], "len", "stage", "d0", "d15").select("cluster", *r("t", "df"))


_EXPR = """expr AS (SELECT l_partkey AS gene, (['d0','d7','d15'])[l_orderkey % 3 + 1] AS period,
    CAST(sum(l_quantity) AS DOUBLE) AS tpm FROM lineitem GROUP BY 1, 2)"""


@query(
    "paired_t",
    f"""WITH {_EXPR} SELECT brand, {r6('avg(g) / (stddev_samp(g) / sqrt(count(g)))')} AS t, count(g) - 1 AS df FROM
    (SELECT p_brand AS brand, log2(a.tpm + 1) - log2(b.tpm + 1) AS g FROM expr a JOIN expr b ON a.gene = b.gene AND a.period = 'd0'
     AND b.period = 'd15' JOIN part ON p_partkey = a.gene) GROUP BY brand""",
)
def paired_t(spark, sf):
    lines = A.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("gene"), A.stage_of("l_orderkey").alias("period"), "l_quantity"
    )
    tpm = lambda s: F.sum(F.when(F.col("period") == s, F.col("l_quantity")))
    wide = lines.groupBy("gene").agg(tpm("d0").alias("x"), tpm("d15").alias("y"))
    brands = A.table(spark, sf, "part").select(F.col("p_partkey").alias("gene"), F.col("p_brand").alias("brand"))
    logged = wide.join(brands, "gene").select("brand", F.log2(F.col("x") + 1).alias("x"), F.log2(F.col("y") + 1).alias("y"))
    return tests.paired(logged, ["brand"], "x", "y").select("brand", "df", *r("t"))


@query(
    "proportion_z",
    with_ctes(
        f"""SELECT cluster, k, n, {r6('sign(k - n * e) * (abs(k - n * e) - least(0.5, abs(k - n * e))) / sqrt(n * e * (1 - e))')} AS z FROM
        (SELECT cluster, count(*) FILTER (WHERE stage = 'd0') AS k, count(*) AS n FROM lens GROUP BY cluster),
        (SELECT count(*) FILTER (WHERE stage = 'd0') / count(*) AS e FROM lens)""",
        "regions", extra=_LEN,
    ),
)
def proportion_z(spark, sf):
    counts = _lengths(spark, sf).groupBy("cluster").agg(
        F.count_if(F.col("stage") == "d0").alias("k"), F.count(F.lit(1)).alias("n")
    )
    expected = counts.agg(F.sum("k") / F.sum("n")).scalar()
    tested = tests.proportion(counts.withColumn("e", expected), "k", "n", F.col("e"), p_value=False)
    return tested.select("cluster", "k", "n", *r("z"))


@query(
    "pearson_r2",
    f"""SELECT l_returnflag, count(*) AS n, {r6('corr(l_quantity, l_extendedprice)')} AS r, {r6('corr(l_quantity, l_extendedprice) ** 2')} AS r2,
    {r6('regr_slope(l_extendedprice, l_quantity)')} AS slope FROM lineitem GROUP BY l_returnflag""",
)
def pearson_r2(spark, sf):
    return tests.correlation(A.table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice").select(
        "l_returnflag", "n", *r("r", "r2", "slope")
    )


@query(
    "state_enrichment",
    with_ctes(
        f"""SELECT cluster, {r6('log2((a / (a + b)) / (c / (c + d)))')} AS log2_fold FROM
        (SELECT cluster, CAST(a AS DOUBLE) a, CAST(b AS DOUBLE) b, CAST(c AS DOUBLE) c, CAST(d AS DOUBLE) d FROM four)""",
        "regions", extra=_LEN + (_FOUR,),
    ),
)
def state_enrichment(spark, sf):
    counts = tests.versus_rest(_lengths(spark, sf), "cluster", F.col("len") > 800)
    return tests.fold_enrichment(counts).select("cluster", *r("log2_fold"))


@query("test_p_values")
def test_p_values(spark, sf):
    """Tail probabilities of the Welch, Kruskal-Wallis and KS statistics per cluster."""
    lens = _lengths(spark, sf)
    welch = tests.with_t_p(tests.welch(lens, ["cluster"], "len", "stage", "d0", "d15"), "welch_p")
    ks = tests.with_ks_p(ranks.ks_distance(lens, ["cluster"], "len", "stage", "d0", "d15"), "ks_p")
    kw = tests.with_kruskal_p(ranks.kruskal(lens, ["cluster"], "len", "stage"), "kruskal_p")
    return welch.join(ks, "cluster").join(kw, "cluster").select("cluster", *r("welch_p", "ks_p", "kruskal_p"))


_GRID = 128
_BANDWIDTH = """0.9 * coalesce(nullif(least(sd, (q3 - q1) / 1.34), 0), nullif(sd, 0), nullif(abs(lo), 0), 1) * pow(n, -0.2)"""


@query(
    "density_curves",
    f"""WITH s AS (SELECT l_returnflag AS flag, count(*) AS n, min(l_extendedprice)::DOUBLE AS lo, max(l_extendedprice)::DOUBLE AS hi,
        stddev_samp(l_extendedprice::DOUBLE) AS sd, quantile_cont(l_extendedprice::DOUBLE, 0.25) AS q1, quantile_cont(l_extendedprice::DOUBLE, 0.75) AS q3
      FROM lineitem GROUP BY 1),
    b AS (SELECT flag, n, lo - 3 * bw AS x0, (hi - lo + 6 * bw) / {_GRID - 1} AS step, bw FROM (SELECT *, {_BANDWIDTH} AS bw FROM s)),
    p AS (SELECT b.*, (l_extendedprice::DOUBLE - x0) / step AS place FROM lineitem JOIN b ON flag = l_returnflag),
    w AS (SELECT flag, k, sum(w) / any_value(n) AS w FROM (SELECT flag, n, floor(place)::BIGINT AS k, 1 - (place - floor(place)) AS w FROM p
      UNION ALL SELECT flag, n, floor(place)::BIGINT + 1, place - floor(place) FROM p) GROUP BY 1, 2)
    SELECT b.flag, g.k AS "at", {r6('x0 + g.k * step')} AS x,
      {r6('1e6 * (SELECT sum(w.w * exp(-pow((w.k - g.k) * step / bw, 2) / 2)) FROM w WHERE w.flag = b.flag) / (bw * sqrt(2 * pi()))')} AS density
    FROM b, (SELECT unnest(range({_GRID})) AS k) g""",
)
def density_curves(spark, sf):
    """Density of prices per return flag, by a million."""
    rows = A.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").cast("double").alias("price"))
    return density.density_curve(rows, ["flag"], "price", _GRID).select("flag", "at", *r("x"), rounded(F.col("density") * 1e6).alias("density"))
