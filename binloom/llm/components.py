"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.session import cut_lineage


def _pointed(links: DataFrame) -> DataFrame:
    """Links from the larger to the smaller end, each once."""
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every linked id; ``component`` is the smallest id it is linked with.

    ``links`` has columns a and b. In each round every id hands its smallest neighbour to its
    larger neighbours, then every id points its smaller neighbours to the smallest of them,
    until all ids of a component point straight at its smallest. Smallest neighbours are
    written tables with a row per id, so adaptive execution can split the join of an id with
    many links. No row or label goes to the driver, and rounds go on until nothing changes.
    """
    links = cut_lineage(_pointed(links))
    state = _digest(links)
    while state[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        spread = cut_lineage(_pointed(_spread(both, F.col("b") > F.col("a"))))
        links = cut_lineage(_pointed(_spread(spread, F.lit(True))))
        before, state = state, _digest(links)
        if state == before:
            break
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )


def _spread(links: DataFrame, which) -> DataFrame:
    """Each neighbour ``b`` of an id that ``which`` holds for, and the id itself, with its smallest."""
    least = cut_lineage(links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least")))
    sent = links.where(which).join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return sent.unionByName(least.select("a", F.col("least").alias("b")))


def _digest(links: DataFrame) -> tuple:
    """Number of links and two sums over them, equal when the links are."""
    mark = F.xxhash64("a", "b")
    return tuple(links.select(F.count(F.lit(1)), F.sum(mark.cast("decimal(20,0)")), F.bit_xor(mark)).first())
