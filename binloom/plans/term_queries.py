"""Queries over similarity and modules of terms; the terms are kinds of parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from binloom.functions.columns import rounded
from binloom.operators import linkage, ontology
from binloom.plans import adapters as A
from binloom.plans.sql import r6
from binloom.session import cut_lineage

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


_LINKS = """t AS (SELECT DISTINCT p_name AS n, p_brand AS b, p_type AS k, split_part(p_name, ' ', 1) AS u, split_part(p_name, ' ', 2) AS v FROM part),
    links AS (SELECT DISTINCT * FROM (SELECT n || '|' || k || '|' || b AS child, n || '|' || k AS parent, 0.8::DOUBLE AS weight FROM t
      UNION ALL SELECT n || '|' || k || '|' || b, b || ':' || k, 0.6 FROM t UNION ALL SELECT n || '|' || k, n, 0.8 FROM t
      UNION ALL SELECT n || '|' || k, k, 0.6 FROM t UNION ALL SELECT b || ':' || k, b, 0.8 FROM t UNION ALL SELECT b || ':' || k, k, 0.6 FROM t
      UNION ALL SELECT n, u, 0.8 FROM t UNION ALL SELECT n, v, 0.6 FROM t UNION ALL SELECT unnest([u, v, b, k]), 'all', 0.8 FROM t)),
    up AS (SELECT child AS term, child AS ancestor, 1.0::DOUBLE AS weight FROM links UNION SELECT parent, parent, 1.0 FROM links
      UNION ALL SELECT up.term, links.parent, up.weight * links.weight FROM up JOIN links ON links.child = up.ancestor),
    closure AS MATERIALIZED (SELECT term, ancestor, max(weight) AS weight FROM up GROUP BY 1, 2)"""


def _links(spark, sf):
    """Kinds of parts under name and type and under brand and type, those under names, words, brands and types."""
    words = F.split("p_name", " ")
    t = A.table(spark, sf, "part").select(
        F.col("p_name").alias("n"), F.col("p_brand").alias("b"), F.col("p_type").alias("k"), words[0].alias("u"), words[1].alias("v")
    ).distinct()
    kind, named, branded = F.concat_ws("|", "n", "k", "b"), F.concat_ws("|", "n", "k"), F.concat_ws(":", "b", "k")
    whole, some = (ontology.LINK_WEIGHTS[k] for k in ("is_a", "part_of"))
    links = [(kind, named, whole), (kind, branded, some), (named, "n", whole), (named, "k", some), (branded, "b", whole), (branded, "k", some)]
    links += [("n", "u", whole), ("n", "v", some)] + [(c, F.lit("all"), whole) for c in "uvbk"]
    column = lambda c: F.col(c) if isinstance(c, str) else c
    cells = F.array(*[F.struct(column(c).alias("child"), column(p).alias("parent"), F.lit(w).alias("weight")) for c, p, w in links])
    return cut_lineage(t.select(F.inline(cells)).distinct())


@query(
    "ancestor_weights",
    f"WITH RECURSIVE {_LINKS} SELECT term, ancestor, {r6('weight')} AS weight FROM closure",
)
def ancestor_weights(spark, sf):
    """What every ancestor keeps of a term's weight."""
    return ontology.ancestor_weights(_links(spark, sf)).select("term", "ancestor", rounded(F.col("weight")).alias("weight"))


@query(
    "term_similarity",
    f"""WITH RECURSIVE {_LINKS}, k AS MATERIALIZED (SELECT *, sum(weight) OVER (PARTITION BY term) AS total FROM closure WHERE term LIKE '%|%')
    SELECT x.term AS a, y.term AS b, {r6('sum(x.weight + y.weight) / max(x.total + y.total)')} AS similarity
    FROM k x JOIN k y ON x.ancestor = y.ancestor AND x.term < y.term GROUP BY 1, 2 HAVING sum(x.weight + y.weight) / max(x.total + y.total) >= 0.7""",
)
def term_similarity(spark, sf):
    """Kinds of parts that agree to 0.7 and more."""
    weights = cut_lineage(ontology.ancestor_weights(_links(spark, sf)))
    found = ontology.term_similarity(weights, weights.select("term").where("term LIKE '%|%'"), 0.7)
    return found.select("a", "b", rounded(F.col("similarity")).alias("similarity"))


@query("term_modules")
def term_modules(spark, sf):
    """Modules of the kinds of parts named by name and type, with the order of their leaves."""
    weights = cut_lineage(ontology.ancestor_weights(_links(spark, sf)))
    terms = cut_lineage(weights.select("term").where("term LIKE '%|%' AND term NOT LIKE '%|%|%'").distinct())
    return linkage.average_linkage(ontology.term_similarity(weights, terms, 0.3), terms, 0.5)[1]
