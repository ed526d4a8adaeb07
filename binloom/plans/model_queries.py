"""Queries over validity indices, sampling, over-representation and embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from binloom.functions.columns import rounded
from binloom.operators import controls, intervals, mfa, neighbours, permutations, sampling, spanning, trees, terms, tests, validity
from binloom.params import MARKS
from binloom.plans import adapters as A
from binloom.plans import chain
from binloom.plans.sql import r6, with_ctes
from binloom.session import cut_lineage

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


WIDTH = 64
FEATURES = [f"f{i}" for i in range(WIDTH)]
FAMILIES = {f"g{g}": [f"f{i}" for i in range(WIDTH) if i * 6 // WIDTH == g] for g in range(6)}


def features(spark, sf):
    """Embeddings as a feature matrix (vec_id, label, f0..f63)."""
    return A.table(spark, sf, "embeddings").select(
        "vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(WIDTH)]
    )


_LONG = """e AS (SELECT vec_id, label, CAST(unnest(range(0, 64)) AS BIGINT) AS f, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
    w AS (SELECT f, 1.0 / (6 * count(*) OVER (PARTITION BY f * 6 // 64) * r) AS w FROM (SELECT f, max(x) - min(x) AS r FROM e GROUP BY f)),
    d AS (SELECT a.vec_id AS i, b.vec_id AS j, any_value(a.label) AS li, any_value(b.label) AS lj, sum(abs(a.x - b.x) * w) AS d
      FROM e a JOIN e b ON a.f = b.f AND a.vec_id <> b.vec_id JOIN w ON w.f = a.f GROUP BY 1, 2)"""


@query(
    "gower_silhouette",
    f"""WITH {_LONG}, m AS (SELECT i, li, lj, avg(d) AS d FROM d GROUP BY ALL),
    s AS (SELECT i, li, max(d) FILTER (WHERE li = lj) AS a, min(d) FILTER (WHERE li <> lj) AS b FROM m GROUP BY i, li)
    SELECT li AS label, count(*) AS n, {r6('avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END)')} AS width FROM s GROUP BY li""",
)
def gower_silhouette(spark, sf):
    distances, labels = validity.cluster_distances(features(spark, sf), "vec_id", "label", FAMILIES)
    widths = validity.silhouette_widths(cut_lineage(distances), labels, "vec_id", "label")
    return widths.groupBy("label").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("width")).alias("width"))


@query(
    "db_index",
    f"""WITH {_LONG}, m AS (SELECT li, lj, avg(d) AS d FROM d GROUP BY ALL)
    SELECT {r6('avg(q)')} AS davies_bouldin FROM (SELECT p.li, max((a.d + b.d) / p.d) AS q FROM m p JOIN m a ON a.li = p.li AND a.lj = p.li
    JOIN m b ON b.li = p.lj AND b.lj = p.lj WHERE p.li <> p.lj GROUP BY p.li)""",
)
def db_index(spark, sf):
    distances, labels = validity.cluster_distances(features(spark, sf), "vec_id", "label", FAMILIES)
    value = validity.davies_bouldin(validity.mean_cluster_distances(distances, labels, "label"))
    return spark.createDataFrame([(value,)], "davies_bouldin double").select(*r("davies_bouldin"))


@query(
    "ch_index",
    f"""WITH e AS (SELECT label, CAST(unnest(range(0, 64)) AS BIGINT) AS f, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
    w AS (SELECT f, 1.0 / (6 * count(*) OVER (PARTITION BY f * 6 // 64) * r) AS w FROM (SELECT f, max(x) - min(x) AS r FROM e GROUP BY f)),
    t AS (SELECT count(*) AS n, count(DISTINCT label) AS k FROM embeddings),
    tss AS (SELECT sum(v) AS v FROM (SELECT var_pop(x * w) * count(*) AS v FROM e JOIN w USING (f) GROUP BY f)),
    wss AS (SELECT sum(v) AS v FROM (SELECT var_pop(x * w) * count(*) AS v FROM e JOIN w USING (f) GROUP BY f, label))
    SELECT n, k, {r6('((tss.v - wss.v) / (k - 1)) / (wss.v / (n - k))')} AS calinski_harabasz FROM tss, wss, t""",
)
def ch_index(spark, sf):
    return validity.calinski_harabasz(features(spark, sf), "label", FAMILIES).select("n", "k", *r("calinski_harabasz"))


@query(
    "adjusted_rand",
    f"""WITH c AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) AS n FROM orders GROUP BY ALL),
    x AS (SELECT sum(n * (n - 1) / 2) AS v FROM c), ra AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT a, sum(n)::DOUBLE AS n FROM c GROUP BY a)),
    rb AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT b, sum(n)::DOUBLE AS n FROM c GROUP BY b)), s AS (SELECT CAST(sum(n) AS BIGINT) AS n FROM c)
    SELECT n, {r6('(x.v - ra.v * rb.v / (n * (n - 1.0) / 2)) / ((ra.v + rb.v) / 2 - ra.v * rb.v / (n * (n - 1.0) / 2))')} AS ari FROM x, ra, rb, s""",
)
def adjusted_rand(spark, sf):
    return validity.adjusted_rand(A.table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus").select("n", *r("ari"))


@query(
    "centroid_distances",
    f"""WITH e AS (SELECT label, unnest(range(0, 64)) AS f, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
    m AS (SELECT label, f, avg(x) AS m FROM e GROUP BY ALL)
    SELECT p.label AS a, q.label AS b, {r6('sqrt(sum((p.m - q.m) ** 2))')} AS distance FROM m p JOIN m q ON p.f = q.f AND p.label < q.label GROUP BY ALL""",
)
def centroid_distances(spark, sf):
    return validity.centroid_distances(features(spark, sf), "label", FEATURES).select("a", "b", *r("distance"))



@query(
    "modularity",
    f"""WITH ed AS (SELECT s_suppkey AS src, (s_suppkey * 7 + 3) % (SELECT count(*) FROM supplier) AS dst, 1.0 + s_nationkey AS w FROM supplier),
    t AS (SELECT e.*, a.s_nationkey % 5 AS ls, b.s_nationkey % 5 AS ld FROM ed e JOIN supplier a ON a.s_suppkey = src JOIN supplier b ON b.s_suppkey = dst),
    en AS (SELECT ls AS l, w, 0.0 AS i FROM t UNION ALL SELECT ld, w, CASE WHEN ls = ld THEN w ELSE 0 END FROM t)
    SELECT {r6('sum(i / m - (d / (2 * m)) ** 2)')} AS modularity FROM (SELECT l, CAST(sum(i) AS DOUBLE) AS i, CAST(sum(w) AS DOUBLE) AS d FROM en GROUP BY l), (SELECT CAST(sum(w) AS DOUBLE) AS m FROM ed)""",
)
def modularity(spark, sf):
    suppliers = A.table(spark, sf, "supplier")
    size = suppliers.agg(F.count(F.lit(1))).scalar()
    edges = suppliers.select(
        F.col("s_suppkey").alias("src"),
        ((F.col("s_suppkey") * 7 + 3) % size).alias("dst"),
        (F.col("s_nationkey") + 1.0).alias("weight"),
    )
    labels = suppliers.select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 5).alias("label"))
    return validity.modularity(edges, labels).select(*r("modularity"))


@query(
    "neighbour_enrichment",
    with_ctes(
        f"""SELECT cluster, near, k, n, {r6('sign(k - n * e) * (abs(k - n * e) - least(0.5, abs(k - n * e))) / sqrt(n * e * (1 - e))')} AS z,
        {r6('k / n - e')} AS excess, {r6('n / flanks')} AS hit_ratio FROM
        (SELECT cluster, near, k, CAST(sum(k) OVER (PARTITION BY cluster) AS BIGINT) AS n FROM
          (SELECT f.cluster, b.cluster AS near, count(DISTINCT b.rid) AS k FROM
            (SELECT chrom, cluster, "start" - 200 AS s, "start" - 10 AS e FROM regions UNION ALL
             SELECT chrom, cluster, "end" + 10, "end" + 200 FROM regions) f JOIN regions b ON b.chrom = f.chrom
             AND b."start" < f.e AND f.s < b."end" GROUP BY ALL))
        JOIN (SELECT cluster AS near, count(*) / (SELECT count(*) FROM regions) AS e FROM regions GROUP BY 1) USING (near)
        JOIN (SELECT cluster, 2.0::DOUBLE * count(*) AS flanks FROM regions GROUP BY 1) USING (cluster)""",
        "regions",
    ),
)
def neighbour_enrichment(spark, sf):
    """Clusters of the regions in either flank of each cluster, against their overall share."""
    regions = A.regions(spark, sf)
    clusters = [row[0] for row in regions.select("cluster").distinct().collect()]  # few clusters
    sides = intervals.flanks(regions.select("chrom", "rid", "cluster", "start", "end"))
    flagged = intervals.count_overlaps(
        regions.select("chrom", "rid", "start", "end", F.col("cluster").alias("near")), sides, name="n", by=("cluster", clusters)
    )
    cells = [F.struct(F.lit(c).alias("cluster"), (F.col(f"`n_{c}`") > 0).alias("hit")) for c in clusters]
    hits = (
        flagged.select("near", F.explode(F.array(*cells)).alias("_c")).select("near", "_c.*").filter("hit")
        .groupBy("cluster", "near").agg(F.count(F.lit(1)).alias("k"))
    )
    totals = hits.groupBy("cluster").agg(F.sum("k").alias("n"))
    size = regions.agg(F.count(F.lit(1))).scalar()
    share = regions.groupBy(F.col("cluster").alias("near")).agg((F.count(F.lit(1)) / size).alias("e"))
    flanks = regions.groupBy("cluster").agg((2.0 * F.count(F.lit(1))).alias("flanks"))
    counts = hits.join(totals, "cluster").join(share, "near").join(flanks, "cluster")
    tested = tests.proportion(counts, "k", "n", F.col("e"), p_value=False)
    excess, ratio = F.col("k") / F.col("n") - F.col("e"), F.col("n") / F.col("flanks")
    return tested.withColumns({"excess": excess, "hit_ratio": ratio}).select(
        "cluster", "near", "k", "n", *r("z", "excess", "hit_ratio")
    )


_GO = """ann AS (SELECT DISTINCT p_brand || '-' || p_type AS term, p_partkey AS gene FROM part),
    lists AS (SELECT DISTINCT l_returnflag AS cluster, l_partkey AS gene FROM lineitem),
    sz AS (SELECT term, count(*) AS term_size FROM ann GROUP BY term HAVING count(*) BETWEEN 2 AND 30000000),
    ls AS (SELECT cluster, count(*) AS list_size FROM lists GROUP BY cluster HAVING count(*) >= 10),
    h AS (SELECT cluster, term, count(*) AS n FROM lists JOIN ann USING (gene) GROUP BY ALL),
    b AS (SELECT count(DISTINCT gene) AS background FROM ann)"""


@query(
    "over_representation",
    f"""WITH {_GO}, t AS (SELECT cluster, term, n, term_size, list_size, background FROM h JOIN sz USING (term) JOIN ls USING (cluster), b),
    x AS (SELECT *, unnest(range(n, least(term_size, list_size) + 1)) AS x FROM t),
    p AS (SELECT cluster, term, n, term_size, list_size, least(1, sum(exp(lgamma(term_size + 1) - lgamma(x + 1) - lgamma(term_size - x + 1)
      + lgamma(background - term_size + 1) - lgamma(list_size - x + 1) - lgamma(background - term_size - list_size + x + 1)
      - lgamma(background + 1) + lgamma(list_size + 1) + lgamma(background - list_size + 1))
      ) FILTER (WHERE list_size - x <= background - term_size)) AS p FROM x GROUP BY cluster, term, n, term_size, list_size)
    SELECT cluster, term, n, term_size, list_size, {r6('p')} AS p FROM p""",
)
def over_representation(spark, sf):
    parts = A.table(spark, sf, "part")
    annotation = parts.select(F.concat_ws("-", "p_brand", "p_type").alias("term"), F.col("p_partkey").alias("gene"))
    lines = A.table(spark, sf, "lineitem")
    lists = lines.select(F.col("l_returnflag").alias("cluster"), F.col("l_partkey").alias("gene"))
    tested = terms.over_representation(lists, annotation, annotation, min_size=2, max_size=30_000_000)
    return tested.select("cluster", "term", "n", "term_size", "list_size", *r("p"))


@query("fixed_sample")
def fixed_sample(spark, sf):
    """Sampling operator: a fixed number of regions drawn by hash."""
    return sampling.fixed_sample(A.regions(spark, sf), ["rid"], 4000)


@query("stratified_sample")
def stratified_sample(spark, sf):
    """Sampling operator: up to 200 regions of every cluster."""
    return sampling.stratified_sample(A.regions(spark, sf), ["cluster"], ["rid"], 200)


@query("bootstrap_odds_ratio")
def bootstrap_odds_ratio(spark, sf):
    """Resampled odds ratio of long regions between the first and last stage."""
    rows = A.regions(spark, sf).select("rid", "stage", ((F.col("end") - F.col("start")) > 800).cast("int").alias("flag"))
    return sampling.odds_ratio_intervals(rows, "stage", "flag", {"d0": 1000, "d15": 2000}, reps=1000)


@query("permutation_test")
def permutation_test(spark, sf):
    """Permutation p-value of the spread of mean lengths over clusters."""
    rows = A.regions(spark, sf).select("rid", "cluster", (F.col("end") - F.col("start")).alias("len"))

    def spread(shuffled):
        means = shuffled.groupBy("rep", "cluster").agg(F.avg("len").alias("m"))
        return means.groupBy("rep").agg((F.max("m") - F.min("m")).alias("stat"))

    return sampling.permutation_p(rows, ["rid"], "len", "cluster", spread, reps=20)


@query(
    "permuted_places",
    """SELECT rep, count(*) AS n, count(*) AS n_places, 0::BIGINT AS least, count(*) - 1 AS most
    FROM orders, (SELECT unnest(range(1, 6))::INTEGER AS rep) GROUP BY rep""",
)
def permuted_places(spark, sf):
    """Each replicate sends the rows to places that all differ and leave no gap."""
    rows, n = permutations.numbered(A.table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"])
    return permutations.permuted_rows(rows, n, 5).groupBy("rep").agg(
        F.count("*").alias("n"), F.count_distinct("place").alias("n_places"), F.min("place").alias("least"), F.max("place").alias("most")
    )


@query(
    "permuted_features",
    """SELECT rep, count(*) AS n, sum(l_quantity * 100)::BIGINT AS quantity, sum(l_extendedprice * 100)::BIGINT AS price,
      sum(l_discount * 100)::BIGINT AS discount FROM lineitem, (SELECT unnest(range(1, 4))::INTEGER AS rep) GROUP BY rep""",
)
def permuted_features(spark, sf):
    """Columns of order lines, each in an order of its own: rows stay complete and sums stay the same."""
    cents = lambda c: F.round(F.col(c).cast("double") * 100).alias(c)
    columns = ["l_quantity", "l_extendedprice", "l_discount"]
    rows, n = permutations.numbered(A.table(spark, sf, "lineitem").select(*map(cents, columns)))
    sums = [F.sum(F.col(c).cast("long")).alias(name) for c, name in zip(columns, ("quantity", "price", "discount"))]
    return permutations.permuted_features(rows, n, columns, 3).groupBy("rep").agg(F.count("*").alias("n"), *sums)


@query(
    "permuted_labels",
    """SELECT rep, o_orderpriority AS label, count(*) AS n FROM orders, (SELECT unnest(range(1, 6))::INTEGER AS rep) GROUP BY 1, 2""",
)
def permuted_labels(spark, sf):
    """Each replicate deals every label out as often as it is there."""
    rows, n = permutations.numbered(A.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("label")), ["o_orderkey"])
    return permutations.permuted_labels(cut_lineage(rows), n, "label", 5).groupBy("rep", "label").agg(F.count("*").alias("n"))


@query("mfa_eigenvalues")
def mfa_eigenvalues(spark, sf):
    """Eigenvalues of the multiple factor analysis of the embeddings."""
    return mfa.fit(features(spark, sf), "vec_id", FAMILIES)[0]


@query("mfa_embedding")
def mfa_embedding(spark, sf):
    """Row coordinates up to the dimension that reaches 60 % of the variance."""
    eigen, coordinates = mfa.fit(features(spark, sf), "vec_id", FAMILIES)
    return mfa.reduce_to(eigen, coordinates)


@query(
    "nearest_neighbours",
    f"""WITH e AS (SELECT vec_id, CAST(unnest(range(0, 64)) AS BIGINT) AS f, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
    d AS (SELECT a.vec_id AS src, b.vec_id AS dst, sqrt(sum((a.x - b.x) ** 2)) AS d FROM e a JOIN e b ON a.f = b.f AND a.vec_id <> b.vec_id GROUP BY 1, 2)
    SELECT src, dst, {r6('d')} AS distance FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS rn FROM d) WHERE rn <= 10""",
)
def nearest_neighbours(spark, sf):
    """The ten nearest rows of every row (a top-k report)."""
    return neighbours.nearest_neighbours(vectors(spark, sf), 10).select("src", "dst", *r("distance"))


def vectors(spark, sf):
    return A.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec")
    )


@query("snn_clusters")
def snn_clusters(spark, sf):
    """Communities of the shared-neighbour graph of the embeddings."""
    return neighbours.cluster(vectors(spark, sf), 20, 0.8)


@query(
    "cluster_rows",
    """SELECT count(*) AS n_rows, count(DISTINCT vec_id) AS n_ids, count(DISTINCT embedding) AS n_vectors, 0::BIGINT AS split_vectors
    FROM embeddings WHERE embedding IS NOT NULL""",
)
def cluster_rows(spark, sf):
    """Every row has one label, and rows with one vector share it."""
    points = vectors(spark, sf).filter("vec IS NOT NULL")
    labels = cut_lineage(neighbours.cluster(points, 20, 0.8).join(points, "id"))
    per_vector = labels.groupBy("vec").agg(F.count_distinct("cluster").alias("k"))
    counts = per_vector.agg(F.count(F.lit(1)).alias("n_vectors"), F.count_if(F.col("k") > 1).alias("split_vectors"))
    return labels.agg(F.count("cluster").alias("n_rows"), F.count_distinct("id").alias("n_ids")).join(F.broadcast(counts))


@query("region_clusters")
def region_clusters(spark, sf):
    """Regions with their cluster and switch score, from bins to labels."""
    cells = A.marked_cells(spark, sf).groupBy("chrom", "stage", "bin").agg(*[F.max(m).alias(m) for m in MARKS])
    return chain.run_clustering(chain.run_features(cells, A.SEGMENT_LEN))


@query("matched_controls")
def matched_controls(spark, sf):
    """Passages matched to a target passage of every document with text, and the unmatched targets."""
    documents = A.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("chrom"), F.col("text"), F.length("text").cast("long").alias("length")
    )
    pieces = documents.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / 4096))))
    start = (F.col("chunk") * 4096 + 1).cast("int")
    chunks = cut_lineage(pieces.select("chrom", F.col("chunk").cast("long").alias("chunk"), F.substring("text", start, F.lit(4096)).alias("seq")))
    lengths = documents.select("chrom", "length")
    third = F.floor(F.col("length") / 3)
    targets = lengths.select(
        F.col("chrom").alias("target_id"), "chrom", third.alias("start"), F.least(third + 60, F.col("length")).alias("end")
    ).filter("end > start")
    found, left = controls.matched_controls(
        targets, chunks, lengths, fold=1, max_n_fraction=1.0, strict=False
    )
    return found.withColumn("status", F.lit("matched")).unionByName(
        left.withColumnRenamed("reason", "status").drop("replicate_index"), allowMissingColumns=True
    )


@query(
    "tree_path_distance",
    f"""WITH RECURSIVE ed AS (SELECT c_custkey // 4 AS p, c_custkey AS c, 1.0::DOUBLE + c_custkey % 7 AS w FROM customer WHERE c_custkey > 0),
    t AS (SELECT 0::BIGINT AS node, 0.0::DOUBLE AS d UNION ALL SELECT c, d + w FROM t JOIN ed ON p = node)
    SELECT node, {r6('d')} AS distance FROM t""",
)
def tree_path_distance(spark, sf):
    """Distances from the root of the tree that links customer n to customer n div 4."""
    edges = A.table(spark, sf, "customer").filter("c_custkey > 0").select(
        F.floor(F.col("c_custkey") / 4).cast("long").alias("src"),
        F.col("c_custkey").alias("dst"),
        (F.col("c_custkey") % 7 + 1.0).alias("weight"),
    )
    return trees.tree_distances(edges, 0).select("node", *r("distance"))


@query("feature_chain")
def feature_chain(spark, sf):
    """Cleaned, pruned and standardised feature matrix of the whole chain."""
    return chain.run_features(A.marked_cells(spark, sf).groupBy("chrom", "stage", "bin").agg(*[F.max(m).alias(m) for m in MARKS]), A.SEGMENT_LEN).standard


@query(
    "spanning_forest",
    f"""SELECT c_custkey // 500 AS block, count(*) - 1 AS n_edges, {r6('max(c_acctbal) - min(c_acctbal)')} AS weight
    FROM customer GROUP BY 1 HAVING count(*) > 1""",
)
def spanning_forest(spark, sf):
    """Least forest over customers, linked to the next four of their block of 500 by balance."""
    block = F.floor(F.col("c_custkey") / 500).cast("long").alias("block")
    rows = A.table(spark, sf, "customer").select(block, "c_custkey", F.col("c_acctbal").cast("double").alias("x"))
    order = Window.partitionBy("block").orderBy("x", "c_custkey")  # at most 500 rows
    ahead = [F.struct(F.lead("c_custkey", k).over(order).alias("dst"), (F.lead("x", k).over(order) - F.col("x")).alias("weight")).alias(f"_{k}") for k in range(1, 5)]
    linked = rows.select(F.col("c_custkey").alias("src"), *ahead)
    links = cut_lineage(linked.select("src", F.inline(F.array("_1", "_2", "_3", "_4"))).filter("dst IS NOT NULL"))
    found = spanning.spanning_forest(links.select("src", "dst", "weight"))
    blocks = rows.select(F.col("c_custkey").alias("src"), "block")
    return found.join(blocks, "src").groupBy("block").agg(F.count("*").alias("n_edges"), rounded(F.sum("weight")).alias("weight"))


@query("principal_tree", "SELECT vec_id AS id, TRUE AS in_range FROM embeddings WHERE embedding IS NOT NULL")
def principal_tree(spark, sf):
    """Pseudotime of every embedding along a tree of 32 centres lies in [0, 1]."""
    points = cut_lineage(vectors(spark, sf).filter("vec IS NOT NULL"))
    edges, nodes = spanning.principal_tree(points, centres=32, rounds=2)
    root = trees.root_leaf(edges, nodes.select("node", F.col("vec")[0].alias("x")))
    timed = trees.pseudotime(neighbours.nearest_centre(points, nodes), cut_lineage(trees.tree_distances(edges, root)))
    return timed.select("id", F.col("pseudotime").between(0.0, 1.0).alias("in_range"))
