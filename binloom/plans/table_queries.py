"""Queries over classifications, grouped summaries, reshaping and set flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from binloom.functions import sequence as S
from binloom.functions.columns import ratio, rounded
from binloom.operators import intervals, ranks
from binloom.operators import tables as X
from binloom.params import MARKS, STAGES
from binloom.plans import adapters as A
from binloom.plans.sql import r6, stage, with_ctes

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


_STATE = """CASE WHEN H3K27ac = 1 AND H3K27me3 = 1 THEN 'Bivalent' WHEN H3K27ac = 1 THEN 'ac_only'
    WHEN H3K27me3 = 1 THEN 'me3_only' ELSE 'None' END"""
_PATHS = f"""paths AS (SELECT d0, d7, d15, count(*) AS n FROM (SELECT chrom, bin, max(s) FILTER (WHERE stage = 'd0') AS d0,
    max(s) FILTER (WHERE stage = 'd7') AS d7, max(s) FILTER (WHERE stage = 'd15') AS d15
    FROM (SELECT chrom, bin, stage, {_STATE} AS s FROM bins) GROUP BY chrom, bin)
    WHERE NOT (d0 = 'None' AND d7 = 'None' AND d15 = 'None') GROUP BY ALL)"""


@query("state_paths", with_ctes(f"SELECT * FROM (SELECT d0, d7, d15, n, {r6('n / sum(n) OVER ()')} AS share FROM paths) WHERE share >= 0.005", "bins", extra=(_PATHS,)))
def state_paths(spark, sf):
    return X.frequent_paths(X.state_paths(A.words(spark, sf), "H3K27ac", "H3K27me3")).select(*STAGES, "n", *r("share"))


@query(
    "presence_paths",
    with_ctes(
        """SELECT path, count(*) AS n FROM (SELECT chrom, bin, string_agg(CAST(H3K9ac AS VARCHAR), '' ORDER BY
        list_position(['d0','d7','d15'], stage)) AS path FROM bins GROUP BY chrom, bin) WHERE path <> '000' GROUP BY path""",
        "bins",
    ),
)
def presence_paths(spark, sf):
    return X.presence_paths(A.words(spark, sf), "H3K9ac").filter("n > 0")


_UNIONS = """unions AS (SELECT chrom, min("start") AS "start", max("end") AS "end" FROM
    (SELECT *, sum(h) OVER (PARTITION BY chrom ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS isl FROM
     (SELECT *, CASE WHEN "start" <= 1 + max("end") OVER (PARTITION BY chrom ORDER BY "start", "end"
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS h FROM longsegs)) GROUP BY chrom, isl)"""


@query(
    "exclusive_sets",
    with_ctes(
        """SELECT category, count(*) AS n FROM (SELECT u.chrom, u."start", (CASE WHEN bool_or(l.stage = 'd0') THEN '1' ELSE '' END) ||
        (CASE WHEN bool_or(l.stage = 'd7') THEN '2' ELSE '' END) || (CASE WHEN bool_or(l.stage = 'd15') THEN '3' ELSE '' END) AS category
        FROM unions u JOIN longsegs l ON l.chrom = u.chrom AND l."start" <= u."end" AND u."start" <= l."end" GROUP BY u.chrom, u."start")
        GROUP BY category""",
        "longsegs", extra=(_UNIONS,),
    ),
)
def exclusive_sets(spark, sf):
    segments = A.long_segments(spark, sf)
    counted = intervals.count_overlaps(
        intervals.merge_intervals(segments, slack=1), segments, closed=True, name="n", by=("stage", STAGES)
    )
    flags = {str(i + 1): F.col(f"n_{s}") > 0 for i, s in enumerate(STAGES)}
    return counted.select(X.membership_label(flags).alias("category")).groupBy("category").agg(
        F.count(F.lit(1)).alias("n")
    )


def _parts(spark, sf):
    return A.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("gene"), A.stage_of("l_orderkey").alias("stage"), "l_quantity"
    )


_HAVE = f"""have AS (SELECT l_suppkey * 100000 + l_partkey AS k, bool_or({stage('l_orderkey')} = 'd0') AS a,
    bool_or({stage('l_orderkey')} = 'd7') AS b, bool_or({stage('l_orderkey')} = 'd15') AS c FROM lineitem GROUP BY 1)"""


@query(
    "inheritance_flows",
    f"""WITH {_HAVE} SELECT * FROM (SELECT 'd0_d7' AS step, CASE WHEN a AND b THEN 'retained' WHEN a THEN 'lost' WHEN b THEN 'new' END AS flow,
    count(*) AS n FROM have GROUP BY ALL UNION ALL SELECT 'd7_d15', CASE WHEN b AND c THEN 'retained' WHEN b THEN 'lost' WHEN c THEN 'new' END,
    count(*) FROM have GROUP BY ALL) WHERE flow IS NOT NULL""",
)
def inheritance_flows(spark, sf):
    lines = A.table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") * 100000 + F.col("l_partkey")).alias("k"), A.stage_of("l_orderkey").alias("stage")
    )
    return X.inheritance_flows(X.membership(lines, "k"))


_TOP = """clus AS (SELECT roi, 'c' || CAST(CAST(substr(chrom, 4) AS BIGINT) % 7 AS VARCHAR) AS cluster, "end" - "start" AS width FROM rois)"""


def _roi_clusters(spark, sf):
    return A.rois(spark, sf).select(
        "roi",
        F.concat(F.lit("c"), (F.substring("chrom", 4, 9).cast("long") % 7).cast("string")).alias("cluster"),
        (F.col("end") - F.col("start")).alias("width"),
    )


@query(
    "cluster_profile_z",
    with_ctes(
        f"""SELECT cluster, {', '.join(f"max(z) FILTER (WHERE track = '{m}_{s}') AS {m}_{s}" for m in MARKS for s in STAGES)} FROM
        (SELECT cluster, track, {r6('(prop - avg(prop) OVER (PARTITION BY mark)) / stddev_samp(prop) OVER (PARTITION BY mark)')} AS z FROM
         (SELECT cluster, mark, mark || '_' || stage AS track, sum(v) / max(total) AS prop FROM roibins JOIN clus USING (roi)
          JOIN (SELECT cluster, round(sum(width) / 200.0) AS total FROM clus GROUP BY cluster) USING (cluster)
          GROUP BY cluster, mark, stage)) GROUP BY cluster""",
        "roibins", extra=(_TOP,),
    ),
)
def cluster_profile_z(spark, sf):
    clusters = _roi_clusters(spark, sf)
    tracks = [f"{m}_{s}" for m in MARKS for s in STAGES]
    masks = A.roi_masks(spark, sf).join(clusters, "roi")
    sums = masks.groupBy("cluster").agg(
        *[F.sum(F.bit_count(F.col(t)).cast("long")).alias(t) for t in tracks],
        F.bround(F.sum("width") / 200).alias("total"),
    )
    long = sums.unpivot(["cluster", "total"], tracks, "track", "hits").select(
        "cluster",
        "track",
        F.element_at(F.split("track", "_"), 1).alias("mark"),
        ratio(F.col("hits"), F.col("total")).alias("prop"),
    )
    z = X.z_within(long, ["mark"], "prop").select("cluster", "track", *r("z"))
    return z.groupBy("cluster").pivot("track", tracks).agg(F.max("z"))


@query(
    "cluster_mark_range",
    with_ctes(
        f"""SELECT cluster, mark, stage, {r6('(v - min(v) OVER (PARTITION BY mark)) / nullif(max(v) OVER (PARTITION BY mark) - min(v) OVER (PARTITION BY mark), 0)')} AS scaled
        FROM (SELECT cluster, mark, stage, avg(coverage) AS v FROM spatial JOIN clus USING (roi) GROUP BY ALL)""",
        "spatial", extra=(_TOP,),
    ),
)
def cluster_mark_range(spark, sf):
    joined = A.roi_features(spark, sf).join(_roi_clusters(spark, sf), "roi")
    tracks = [f"{m}_{s}_coverage" for m in MARKS for s in STAGES]
    means = joined.groupBy("cluster").agg(*[F.avg(t).alias(t) for t in tracks])
    long = means.unpivot(["cluster"], tracks, "track", "v").select(
        "cluster",
        F.element_at(F.split("track", "_"), 1).alias("mark"),
        F.element_at(F.split("track", "_"), 2).alias("stage"),
        "v",
    )
    return X.scaled_to_range(long, ["mark"], "v").select("cluster", "mark", "stage", *r("scaled"))


@query(
    "bivalent_fraction",
    with_ctes(
        f"""SELECT roi, stage, bool_or(b = 1) AS any_bivalent, {r6('avg(b)')} AS fraction FROM
        (SELECT roi, stage, i, min(v) AS b FROM roibins WHERE mark IN ('H3K27ac', 'H3K27me3') GROUP BY ALL) GROUP BY roi, stage""",
        "roibins",
    ),
)
def bivalent_fraction(spark, sf):
    masks = A.roi_masks(spark, sf)
    cells = [
        F.struct(
            F.lit(s).alias("stage"),
            F.bit_count(F.col(f"H3K27ac_{s}").bitwiseAND(F.col(f"H3K27me3_{s}"))).alias("n"),
        )
        for s in STAGES
    ]
    return masks.select("roi", "n_bins", F.explode(F.array(*cells)).alias("_c")).select(
        "roi", "_c.stage", (F.col("_c.n") > 0).alias("any_bivalent"),
        rounded(ratio(F.col("_c.n"), F.col("n_bins"))).alias("fraction"),
    )


@query(
    "coverage_inside_segments",
    with_ctes(
        f"""SELECT m.mark, m.stage, {r6('avg(v)')} AS inside FROM marks m JOIN segs s ON s.chrom = m.chrom AND s.stage = m.stage
        AND m.bin * 200 < s."end" AND s."start" < (m.bin + 1) * 200 GROUP BY m.mark, m.stage""",
        "marks", "segs",
    ),
)
def coverage_inside_segments(spark, sf):
    # Segments are made of marked cells, so the empty tiles of the grid lie in none.
    inside = intervals.windows_met(A.cells(spark, sf), A.segments(spark, sf), on=("stage", "chrom"))
    means = inside.groupBy("stage").agg(*[F.avg(m).alias(m) for m in MARKS])
    return means.unpivot(["stage"], list(MARKS), "mark", "inside").select("mark", "stage", *r("inside"))


@query(
    "length_bands",
    with_ctes(
        f"""SELECT stage, band, count(*) AS n, {r6('count(*) / sum(count(*)) OVER (PARTITION BY stage)')} AS share FROM
        (SELECT stage, CASE WHEN len <= 1 THEN '1' WHEN len <= 5 THEN '2-5' WHEN len <= 10 THEN '6-10' WHEN len <= 20 THEN '11-20' ELSE '>20' END AS band FROM runs)
        GROUP BY stage, band""",
        "runs",
    ),
)
def length_bands(spark, sf):
    banded = A.segments(spark, sf, 1).select("stage", X.length_band(F.col("len")).alias("band"))
    return X.counts_with_share(banded, ["stage", "band"], ["stage"]).select("stage", "band", "n", *r("share"))


@query(
    "density_per_kb",
    with_ctes(
        f"""SELECT cluster, CAST(sum(n) AS BIGINT) AS n, {r6('sum(n) / (sum(w) / 1000.0)')} AS per_kb FROM
        (SELECT rid, cluster, r."end" - r."start" AS w, count(p.pos) AS n FROM regions r LEFT JOIN points p ON p.chrom = r.chrom
         AND p.pos >= r."start" AND p.pos < r."end" GROUP BY ALL) GROUP BY cluster""",
        "regions", "points",
    ),
)
def density_per_kb(spark, sf):
    spots = A.points(spark, sf, ["chrom", "pos"]).select("chrom", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"))
    hits = intervals.count_overlaps(A.regions(spark, sf, ["chrom", "start", "end", "cluster"]), spots, name="n_hits")
    return X.density_per_kb(hits, ["cluster"], "n_hits", F.col("end") - F.col("start")).select("cluster", "n", *r("per_kb"))


@query(
    "composition_complete",
    f"""SELECT f.o_custkey, f.o_orderpriority AS annotation, coalesce(n, 0) AS n, coalesce(covered, 0) AS covered,
    {r6('coalesce(covered, 0) / nullif(sum(coalesce(covered, 0)) OVER (PARTITION BY f.o_custkey), 0)')} AS share FROM
    (SELECT * FROM (SELECT DISTINCT o_custkey FROM orders) CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders)) f LEFT JOIN
    (SELECT o_custkey, o_orderpriority, count(*) AS n, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS covered FROM orders GROUP BY ALL) g
    USING (o_custkey, o_orderpriority)""",
)
def composition_complete(spark, sf):
    orders = A.table(spark, sf, "orders").select(
        "o_custkey", F.col("o_orderpriority").alias("annotation"), F.floor("o_totalprice").cast("long").alias("bp")
    )
    return X.composition(orders, ["o_custkey"], "annotation", orders, F.col("bp")).select(
        "o_custkey", "annotation", "n", "covered", *r("share")
    )


_FC = f"""fc AS (SELECT gene, log2(coalesce(b, 0) + 1) - log2(coalesce(a, 0) + 1) AS lfc, (gene % 100) / 1000.0 AS padj FROM
    (SELECT l_partkey AS gene, sum(l_quantity) FILTER (WHERE {stage('l_orderkey')} = 'd0') AS a,
     sum(l_quantity) FILTER (WHERE {stage('l_orderkey')} = 'd15') AS b FROM lineitem GROUP BY 1))"""


def _fold_changes(spark, sf):
    tpm = lambda s: F.coalesce(F.sum(F.when(F.col("stage") == s, F.col("l_quantity"))), F.lit(0.0))
    genes = _parts(spark, sf).groupBy("gene").agg(tpm("d0").alias("a"), tpm("d15").alias("b"))
    return genes.select(
        "gene", X.log2_fold(F.col("b"), F.col("a")).alias("lfc"), (F.col("gene") % 100 / F.lit(1000.0)).alias("padj")
    )


@query(
    "gene_fate",
    f"""WITH {_FC} SELECT brand, change, count(DISTINCT gene) AS n, {r6('count(DISTINCT gene) / sum(count(DISTINCT gene)) OVER (PARTITION BY brand)')} AS share FROM
    (SELECT p_brand AS brand, gene, CASE WHEN padj < 0.05 AND lfc >= 0.5 THEN 'Up' WHEN padj < 0.05 AND lfc <= -0.5 THEN 'Down' ELSE 'NotSig' END AS change
     FROM fc JOIN part ON p_partkey = gene) GROUP BY brand, change""",
)
def gene_fate(spark, sf):
    brands = A.table(spark, sf, "part").select(F.col("p_partkey").alias("gene"), F.col("p_brand").alias("brand"))
    fate = _fold_changes(spark, sf).join(brands, "gene").select(
        "gene", "brand", X.expression_change(F.col("lfc"), F.col("padj")).alias("change")
    )
    return X.counts_with_share(fate.distinct(), ["brand", "change"], ["brand"]).select("brand", "change", "n", *r("share"))


@query(
    "fate_shares",
    f"""WITH {_FC}, x AS (SELECT gene, max(q) AS top FROM (SELECT l_partkey AS gene, {stage('l_orderkey')} AS st, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) GROUP BY gene),
    g AS (SELECT p_brand AS brand, p_partkey AS gene, padj, lfc, coalesce(top >= 200, false) AS expressed FROM part LEFT JOIN fc ON fc.gene = p_partkey LEFT JOIN x ON x.gene = p_partkey)
    SELECT brand, count(DISTINCT gene) AS n, {r6("count(DISTINCT gene) FILTER (WHERE padj < 0.05 AND lfc <= -0.5) / count(DISTINCT gene)")} AS repressed,
    {r6("count(DISTINCT gene) FILTER (WHERE lfc IS NOT NULL AND NOT coalesce(padj < 0.05 AND abs(lfc) >= 0.5, false)) / count(DISTINCT gene)")} AS unchanged,
    {r6("count(DISTINCT gene) FILTER (WHERE padj < 0.05 AND lfc >= 0.5) / count(DISTINCT gene)")} AS induced,
    {r6("count(DISTINCT gene) FILTER (WHERE NOT expressed) / count(DISTINCT gene)")} AS silent FROM g GROUP BY brand""",
)
def fate_shares(spark, sf):
    genes = A.table(spark, sf, "part").select(F.col("p_partkey").alias("gene"), F.col("p_brand").alias("brand"))
    fates = _fold_changes(spark, sf).filter("lfc IS NOT NULL").select(
        "gene", X.expression_change(F.col("lfc"), F.col("padj")).alias("change")
    )
    sums = _parts(spark, sf).groupBy("gene", "stage").agg(F.sum("l_quantity").alias("q"))
    expressed = sums.groupBy("gene").agg((F.max("q") >= 200).alias("expressed"))
    rows = genes.join(fates, "gene", "left").join(expressed, "gene", "left")
    return X.fate_shares(rows, "brand", "gene", "change", "expressed").select(
        "brand", "n", *r("repressed", "unchanged", "induced", "silent")
    )


@query("last_rows", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 7")
def last_rows(spark, sf):
    """The seven last events by time (a top-k report)."""
    return X.last_rows(A.table(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"], 7)


@query(
    "first_appearance",
    "SELECT o_orderpriority, row_number() OVER (ORDER BY min(o_orderkey), o_orderpriority) AS level FROM orders GROUP BY 1",
)
def first_appearance(spark, sf):
    return X.first_appearance(A.table(spark, sf, "orders"), "o_orderpriority", "o_orderkey")


@query(
    "expression_levels",
    f"""SELECT brand, period, count(*) AS n, {r6('quantile_cont(v, 0)')} AS low, {r6('quantile_cont(v, 0.25)')} AS q25, {r6('median(v)')} AS median,
    {r6('quantile_cont(v, 0.75)')} AS q75, {r6('max(v)')} AS high FROM (SELECT p_brand AS brand, {stage('l_orderkey')} AS period, l_partkey, log2(sum(l_quantity) + 1) AS v
    FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL) GROUP BY brand, period""",
)
def expression_levels(spark, sf):
    brands = A.table(spark, sf, "part").select(F.col("p_partkey").alias("gene"), F.col("p_brand").alias("brand"))
    levels = (
        _parts(spark, sf).groupBy("gene", F.col("stage").alias("period")).agg(F.log2(F.sum("l_quantity") + 1).alias("v"))
        .join(brands, "gene")
    )
    keys = ["brand", "period"]
    five = ranks.quantile_table(levels, keys, "v", {"low": 0, "q25": 0.25, "median": 0.5, "q75": 0.75, "high": 1})
    sizes = levels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return five.join(sizes, keys).select(*keys, "n", *r("low", "q25", "median", "q75", "high"))


@query(
    "replicate_means",
    f"""SELECT l_partkey AS gene, {stage('l_orderkey')} AS period, {r6('avg(log2(l_quantity + 1))')} AS mean_log2 FROM lineitem GROUP BY 1, 2""",
)
def replicate_means(spark, sf):
    return _parts(spark, sf).groupBy("gene", F.col("stage").alias("period")).agg(
        rounded(F.avg(F.log2(F.col("l_quantity") + 1))).alias("mean_log2")
    )


@query(
    "profile_mean_sem",
    f"""SELECT label, pos, count(*) AS n, {r6('avg(v)')} AS mean, {r6('stddev_samp(v)')} AS sd, {r6('stddev_samp(v) / sqrt(count(*))')} AS sem FROM
    (SELECT label, CAST(unnest(range(0, 64)) AS BIGINT) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY label, pos""",
)
def profile_mean_sem(spark, sf):
    long = A.table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v")).select(
        "label", F.col("pos").cast("long").alias("pos"), F.col("v").cast("double").alias("v")
    )
    return X.mean_sem(long, ["label", "pos"], "v").select("label", "pos", "n", *r("mean", "sd", "sem"))


@query("slice_mean", f"SELECT vec_id, {r6('list_avg(list_transform(embedding[17:48], lambda x: CAST(x AS DOUBLE)))')} AS mean FROM embeddings")
def slice_mean(spark, sf):
    window = F.transform(F.slice("embedding", 17, 32), lambda v: v.cast("double"))
    total = F.aggregate(window, F.lit(0.0), lambda s, v: s + v)
    return A.table(spark, sf, "embeddings").select("vec_id", rounded(total / 32).alias("mean"))


@query(
    "length_histogram",
    with_ctes('SELECT stage, ("end" - "start") // 50 AS bin_no, count(*) AS n FROM regions GROUP BY 1, 2', "regions"),
)
def length_histogram(spark, sf):
    return X.histogram(
        A.regions(spark, sf).withColumn("len", F.col("end") - F.col("start")), ["stage"], "len", 50
    )


@query(
    "binned_2d",
    "SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS x, CAST(floor(l_extendedprice / 10000) AS BIGINT) AS y, count(*) AS n FROM lineitem GROUP BY 1, 2",
)
def binned_2d(spark, sf):
    lines = A.table(spark, sf, "lineitem").withColumn("x", F.floor(F.col("l_quantity") / 5).cast("long"))
    return X.histogram(lines, ["x"], "l_extendedprice", 10000).withColumnRenamed("bin_no", "y")


@query("cluster_sizes", with_ctes("SELECT cluster, count(*) AS n FROM regions GROUP BY 1 ORDER BY n DESC", "regions"))
def cluster_sizes(spark, sf):
    return A.regions(spark, sf).groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cluster")


@query(
    "quadrant_share",
    with_ctes(
        f"""SELECT quadrant, change, count(*) AS n, {r6('count(*) / sum(count(*)) OVER ()')} AS share FROM
        (SELECT CASE WHEN x <= 0 THEN 'x-' ELSE 'x+' END || CASE WHEN y <= 0 THEN 'y-' ELSE 'y+' END AS quadrant,
          CASE WHEN round(x, 9) <= -0.2 THEN 'reduced' WHEN round(x, 9) >= 0.2 THEN 'rised' ELSE 'keeped' END AS change FROM
         (SELECT roi, (max(n) FILTER (WHERE mark = 'H3K27ac' AND stage = 'd7') - max(n) FILTER (WHERE mark = 'H3K27ac' AND stage = 'd0')) / max(k) AS x,
          (max(n) FILTER (WHERE mark = 'H3K9ac' AND stage = 'd7') - max(n) FILTER (WHERE mark = 'H3K9ac' AND stage = 'd0')) / max(k) AS y
          FROM (SELECT roi, mark, stage, sum(v) AS n, max(k) AS k FROM roibins GROUP BY ALL) GROUP BY roi)) GROUP BY quadrant, change""",
        "roibins",
    ),
)
def quadrant_share(spark, sf):
    x, y = F.col("H3K27ac_delta_cov_d7_d0"), F.col("H3K9ac_delta_cov_d7_d0")
    labelled = A.roi_features(spark, sf).select(
        X.quadrant(x, y).alias("quadrant"), X.coverage_change(F.round(x, 9)).alias("change")
    )
    return X.counts_with_share(labelled, ["quadrant", "change"]).select("quadrant", "change", "n", *r("share"))


_TERMS = """terms AS (SELECT p_type AS cluster, p_brand AS term, count(*) AS n, avg(p_retailprice) AS m, max(p_size) AS x FROM part GROUP BY ALL)"""


def _terms(spark, sf):
    return A.table(spark, sf, "part").groupBy(F.col("p_type").alias("cluster"), F.col("p_brand").alias("term")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("p_retailprice").alias("m"), F.max("p_size").alias("x")
    )


@query(
    "top1_per_group",
    f"WITH {_TERMS} SELECT cluster, term, n FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, round(m, 6) DESC, x DESC, term) AS rn FROM terms) WHERE rn = 1",
)
def top1_per_group(spark, sf):
    order = [F.desc("n"), F.desc("m6"), F.desc("x"), F.col("term")]
    terms = _terms(spark, sf).withColumn("m6", F.round("m", 6))
    return X.top_per_group(terms, ["cluster"], order).select("cluster", "term", "n")


_P_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


@query(
    "pivot_terms",
    f"""WITH {_TERMS} SELECT *, {" + ".join(f"CAST({v} > 0 AS BIGINT)" for v in _P_TYPES)} AS n_present FROM (SELECT term,
    {", ".join(f"coalesce(max(n) FILTER (WHERE cluster = '{v}'), 0) AS {v}" for v in _P_TYPES)} FROM terms GROUP BY term)""",
)
def pivot_terms(spark, sf):
    wide = _terms(spark, sf).groupBy("term").pivot("cluster", list(_P_TYPES)).agg(F.max("n")).na.fill(0, list(_P_TYPES))
    return wide.withColumn("n_present", sum((F.col(v) > 0).cast("long") for v in _P_TYPES))


@query(
    "string_agg",
    "SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))), '|') AS o_orderpriority FROM orders GROUP BY 1",
)
def string_agg(spark, sf):
    return X.joined_text(A.table(spark, sf, "orders"), ["o_custkey"], "o_orderpriority", "|")


@query(
    "first_match_lookup",
    """SELECT c_custkey, o.o_orderpriority FROM customer LEFT JOIN (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority
    FROM orders GROUP BY 1) o ON o_custkey = c_custkey""",
)
def first_match_lookup(spark, sf):
    customers = A.table(spark, sf, "customer").select("c_custkey")
    orders = A.table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return X.first_match(customers, orders, "c_custkey", "o_orderkey", "o_orderpriority")


@query(
    "keep_first_by_key",
    "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1",
)
def keep_first_by_key(spark, sf):
    orders = A.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return X.keep_first(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    "chrom_names",
    """SELECT s_suppkey, CASE WHEN share > 0.5 THEN 'chr' || s_suppkey ELSE CAST(s_suppkey AS VARCHAR) END AS chrom FROM supplier,
    (SELECT avg(CASE WHEN l_suppkey % 3 > 0 THEN 1 ELSE 0 END) AS share FROM lineitem)""",
)
def chrom_names(spark, sf):
    like = A.table(spark, sf, "lineitem").select(
        F.when(F.col("l_suppkey") % 3 > 0, F.concat(F.lit("chr"), F.col("l_suppkey").cast("string")))
        .otherwise(F.col("l_suppkey").cast("string")).alias("chrom")
    )
    named = A.table(spark, sf, "supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("chrom"))
    return X.harmonise_chrom(named, like)


@query(
    "known_chroms",
    with_ctes("SELECT rid FROM regions WHERE chrom IN (SELECT 'c' || c_custkey FROM customer WHERE c_acctbal > 0)", "regions"),
)
def known_chroms(spark, sf):
    known = A.table(spark, sf, "customer").filter("c_acctbal > 0").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("chrom")
    )
    return X.on_known_chroms(A.regions(spark, sf), known).select("rid")


@query(
    "recode_states",
    "SELECT state, count(*) AS n FROM (SELECT coalesce(n_name, CAST(c_custkey % 40 AS VARCHAR)) AS state FROM customer LEFT JOIN nation ON n_nationkey = c_custkey % 40) GROUP BY 1",
)
def recode_states(spark, sf):
    customers = A.table(spark, sf, "customer").select((F.col("c_custkey") % 40).cast("string").alias("state"))
    codes = A.table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("code"), "n_name")
    return X.recode(customers, "state", codes, "code", "n_name").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query(
    "column_profile",
    with_ctes(
        f"""SELECT mark || '_' || stage || '_com' AS "column", {r6('avg(CASE WHEN com IS NULL THEN 1 ELSE 0 END)')} AS na_fraction,
        {r6('var_samp(com)')} AS variance, count(com) AS n_finite, {r6('avg(CASE WHEN com = 0 THEN 1 WHEN com IS NOT NULL THEN 0 END)')} AS zero_fraction
        FROM spatial GROUP BY mark, stage""",
        "spatial",
    ),
)
def column_profile(spark, sf):
    names = [f"{m}_{s}_com" for m in MARKS for s in STAGES]
    return X.column_profile(A.roi_features(spark, sf), names).select(
        "column", "n_finite", *r("na_fraction", "variance", "zero_fraction")
    )


@query(
    "gene_matched_overlap",
    with_ctes(
        """SELECT r.rid, p.l_orderkey, p.l_linenumber FROM regions r JOIN (SELECT DISTINCT l_orderkey AS rid2, l_partkey AS g FROM lineitem) t ON t.rid2 = r.rid
        JOIN points p ON p.chrom = r.chrom AND p.gene = t.g AND p.pos >= r."start" AND p.pos < r."end\"""",
        "regions", "points",
    ),
)
def gene_matched_overlap(spark, sf):
    links = A.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("rid"), F.col("l_partkey").alias("gene")).distinct()
    linked = A.regions(spark, sf).join(links, "rid")
    spots = A.points(spark, sf).select("chrom", "gene", "pos", "l_orderkey", "l_linenumber")
    spots = spots.withColumn("b_start", F.col("pos")).withColumn("b_end", F.col("pos") + 1)
    return intervals.overlap_join(linked, spots, ["chrom", "gene"], bucket=512).select(
        "rid", "l_orderkey", "l_linenumber"
    )


@query(
    "tau_star",
    f"""SELECT p_brand, {r6('tau')} AS tau_star, {r6('se')} AS tau_star_se, {r6('coef / 2e-9')} AS z, {r6('tau - 1.96 * se')} AS ci_low FROM
    (SELECT p_brand, coef, 5961159 * sqrt(prop * (1 - prop)) / 0.4 * coef AS tau, 5961159 * sqrt(prop * (1 - prop)) / 0.4 * 2e-9 AS se FROM
     (SELECT p_brand, count(*) / (SELECT count(*) FROM part) AS prop, (avg(p_size) - 25) * 1e-9 AS coef FROM part GROUP BY p_brand))""",
)
def tau_star(spark, sf):
    parts = A.table(spark, sf, "part")
    total = parts.agg(F.count(F.lit(1))).scalar()
    rows = parts.groupBy("p_brand").agg(
        (F.count(F.lit(1)) / total).alias("prop_snps"), ((F.avg("p_size") - 25) * 1e-9).alias("coefficient")
    ).withColumn("coefficient_se", F.lit(2e-9)).withColumn("h2", F.lit(0.4))
    return X.tau_star(rows).select("p_brand", *r("tau_star", "tau_star_se", "z", "ci_low"))


@query(
    "signed_log_p",
    f"SELECT event_id, {r6('least(-log10(greatest((event_id % 997 + 1) / 998.0::DOUBLE, 2.2e-16)), 2) * sign(value - 50)')} AS score FROM events",
)
def signed_log_p(spark, sf):
    p = (F.col("event_id") % 997 + 1) / F.lit(998.0)
    return A.table(spark, sf, "events").select("event_id", rounded(X.signed_log_p(p, F.col("value") - 50, cap=2.0)).alias("score"))


@query(
    "set_operations",
    f"""SELECT 'intersect' AS op, count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity > 45)
    UNION ALL SELECT 'setdiff', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_quantity > 45 EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')
    UNION ALL SELECT 'union', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_partkey FROM lineitem WHERE l_quantity > 45)""",
)
def set_operations(spark, sf):
    flags = A.table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.bool_or(F.col("l_returnflag") == "R").alias("a"), F.bool_or(F.col("l_quantity") > 45).alias("b")
    )
    cells = [F.struct(F.lit(n).alias("op"), F.col(n).alias("n")) for n in ("intersect", "setdiff", "union")]
    return flags.agg(
        F.count_if(F.col("a") & F.col("b")).alias("intersect"),
        F.count_if(~F.col("a") & F.col("b")).alias("setdiff"),
        F.count_if(F.col("a") | F.col("b")).alias("union"),
    ).select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


_LETTERS = "length(text) - length(regexp_replace(text, '[{0}]', '', 'gi'))"


@query(
    "letter_composition",
    f"""SELECT doc_id, {r6(f"({_LETTERS.format('GC')}) / nullif({_LETTERS.format('ACGT')}, 0)")} AS gc,
    {r6(f"(length(text) - ({_LETTERS.format('ACGT')})) / nullif(length(text), 0)")} AS other FROM documents""",
)
def letter_composition(spark, sf):
    text = F.col("text")
    return A.table(spark, sf, "documents").select(
        "doc_id", rounded(S.gc_fraction(text)).alias("gc"), rounded(S.other_fraction(text)).alias("other")
    )
