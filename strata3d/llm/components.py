"""Connected components of a table of links by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata3d.session import stored


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Hang each node's neighbours (larger ones, or all smaller ones) on its least neighbour.

    The least neighbour is a partial aggregate, written and joined back to the links, so no node's
    neighbours are gathered in one place and the join can split a crowded node.
    """
    if large:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
    hung = both.join(least, "a")
    if large:
        out = hung.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"),
                                                         F.col("m").alias("b"))
    else:
        out = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """`node`, `root` (least node of its component) of every node of `links` (`a`, `b`).

    Rounds go on until nothing changes; each one is written to the shared checkpoint folder. Links
    of a node to itself and repeated links do no harm; nodes without a link are not returned.
    """
    pairs = stored(links.select("a", "b").where(F.col("a") != F.col("b")).distinct())
    if pairs.isEmpty():
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    seen = None
    while True:
        pairs = stored(_star(stored(_star(pairs, True)), False))
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
