"""Connected components of a link table, by alternating large-star and small-star rounds.

Every round is two joins and two aggregates on links, whatever the shape of the
graph; nothing of the graph reaches the driver but a count (Kiveris et al.,
"Connected components in MapReduce and beyond", SoCC 2014).  Each round's links
are stored in the shared folder, so a lost executor repeats one round at most, and
removed when the next round's stand.  Nodes with very many links are joined by
broadcast of their least neighbour, so no task gathers a star.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolens.llm.common import remove_path, spread_join, store


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Connects neighbours of each node to the least of them and itself: the larger ones, or the smaller ones."""
    if large:
        sides = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("s")).select("s.*")
    else:
        sides = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = sides.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("a", "m"))
    joined = spread_join(sides, least, ["a"])
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; root: the least node of its component.

    links: (a bigint, b bigint), in any direction, repeats and loops allowed, no nulls.
    """
    spark = links.sparkSession
    now, at = store(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        before, (now, at) = at, store(_star(_star(now, True), False), "links")
        remove_path(spark, before)
        here = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if here == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        mark = here
