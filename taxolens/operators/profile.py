"""Profiles of groups over a few musical dimensions, each a list of features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxolens.functions.numeric import percent_band


def row_scores(df: DataFrame, key: str, group: str, vector: str, dimensions: dict[str, list[int]]) -> DataFrame:
    """(key, group, dim, score): mean of a row's sample z-scores over each dimension's components."""
    values = df.select(key, group, F.posexplode(vector).alias("pos", "x"))
    stats = values.groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.stddev_samp(F.col("x").cast("double")).alias("s"))
    dim_of = F.create_map(*[F.lit(v) for d, places in dimensions.items() for p in places for v in (p, d)])
    z = (F.col("x").cast("double") - F.col("m")) / F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)
    placed = values.join(F.broadcast(stats), "pos").select(key, group, dim_of[F.col("pos")].alias("dim"), z.alias("z")).where("dim is not null")
    return placed.groupBy(key, group, "dim").agg(F.avg("z").alias("score"))


def profiles(df: DataFrame, key: str, group: str, vector: str, dimensions: dict[str, list[int]]) -> DataFrame:
    """(group, dim, score): the group's mean, placed between the 5th and 95th percentile of all rows, 0 to 100; empty dimensions 50."""
    rows = row_scores(df, key, group, vector, dimensions)
    bounds = rows.groupBy("dim").agg(F.percentile("score", F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
    means = rows.groupBy(group, "dim").agg(F.avg("score").alias("mean")).join(F.broadcast(bounds), "dim")
    done = means.select(group, "dim", percent_band(F.col("mean"), F.col("q")[0], F.col("q")[1]).alias("score"))
    empty = [d for d, places in dimensions.items() if not places]
    if not empty:
        return done
    return done.unionByName(df.select(group).distinct().select(group, F.explode(F.array(*[F.lit(d) for d in empty])).alias("dim"), F.lit(50.0).alias("score")))


def deltas(profile: DataFrame, group: str) -> DataFrame:
    """(g1, g2, delta): mean absolute difference of two groups' profiles."""
    l, r = profile.select(F.col(group).alias("g1"), "dim", F.col("score").alias("a")), profile.select(F.col(group).alias("g2"), "dim", F.col("score").alias("b"))
    return l.join(r, "dim").where("g1 < g2").groupBy("g1", "g2").agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("delta"))


def convergent_pairs(df: DataFrame, key: str, group: str, cluster: str, vector: str, dimensions: dict[str, list[int]], max_delta: float = 15.0, top: int = 4) -> DataFrame:
    """Pairs of groups with near profiles, those that fall into one cluster most often first."""
    from taxolens.operators.contingency import co_cluster

    rate = co_cluster(df, group, cluster).withColumnsRenamed({"a1": "g1", "a2": "g2"})
    near = deltas(profiles(df, key, group, vector, dimensions), group).where(F.col("delta") < max_delta)
    return near.join(rate, ["g1", "g2"]).orderBy(F.desc(F.round("rate", 9)), "g1", "g2").limit(top)


def slices(ranked: DataFrame, score: Column, key: str, width: int = 5) -> DataFrame:
    """(key, part, place): the first and second `width` from the top, and the last and last but one from the end."""
    up, down = Window.orderBy(score.desc(), key), Window.orderBy(score.asc(), F.desc(key))
    p = ranked.select(key, F.row_number().over(up).alias("place"), F.row_number().over(down).alias("back"))
    part = F.when(F.col("place") <= width, "top").when(F.col("place") <= 2 * width, "next").when(F.col("back") <= width, "last").when(F.col("back") <= 2 * width, "before last")
    return p.select(key, part.alias("part"), "place").where("part is not null")
