"""Label-against-cluster operators; every measure derives from one grouped count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxolens.functions.numeric import xlogx


def counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n): non-empty cells. One shuffle of partial counts, whatever the input's size."""
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) with empty cells, from the counts' own keys."""
    cells = counts(df, a, b)
    keys = cells.select(a).distinct().crossJoin(F.broadcast(cells.select(b).distinct()))
    return keys.join(cells, [a, b], "left").select(a, b, F.coalesce("n", F.lit(0)).alias("n"))


def row_share(df: DataFrame, a: str, b: str, scale: float = 1.0) -> DataFrame:
    share = scale * F.col("n") / F.sum("n").over(Window.partitionBy(a))
    return counts(df, a, b).select(a, b, share.alias("pct"))


def fragmentation(df: DataFrame, a: str, b: str) -> DataFrame:
    """How a class spreads over clusters: entropy in bits, clusters touched, share of the largest in percent."""
    p = row_share(df, a, b).withColumnRenamed("pct", "p")
    return p.groupBy(a).agg((-F.sum(xlogx(F.col("p"), "2"))).alias("entropy"), F.count("*").alias("n_clusters"), (100 * F.max("p")).alias("dominant_cluster_pct"))


def purity(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: share of rows that belong to the most frequent class of their cluster."""
    top = counts(df, a, b).groupBy(b).agg(F.max("n").alias("top"), F.sum("n").alias("size"))
    return top.agg((F.sum("top") / F.sum("size")).alias("purity"))


def band(pct: Column) -> Column:
    return F.when(pct >= 70, "very pure").when(pct >= 50, "pure").when(pct >= 35, "mixed").when(pct >= 20, "very mixed").otherwise("scattered")


def purity_by(df: DataFrame, a: str, b: str) -> DataFrame:
    """Each cluster's dominant class (the least of equals), its share in percent, size and band."""
    by = Window.partitionBy(b).orderBy(F.desc("n"), F.asc(a))
    ranked = counts(df, a, b).withColumn("k", F.row_number().over(by)).withColumn("size", F.sum("n").over(Window.partitionBy(b)))
    return ranked.where("k = 1").select(b, F.col(a).alias("dominant"), (100 * F.col("n") / F.col("size")).alias("purity"), "size").withColumn("band", band(F.col("purity")))


def concentration(df: DataFrame, a: str, b: str) -> DataFrame:
    return counts(df, a, b).groupBy(a).agg((100 * F.max("n") / F.sum("n")).alias("concentration"))


def purity_summary(df: DataFrame, a: str, b: str, pure: float = 50.0) -> DataFrame:
    p = purity_by(df, a, b).agg(F.avg("purity").alias("avg_purity"), F.count_if(F.col("purity") >= pure).alias("n_pure"))
    return p.crossJoin(concentration(df, a, b).agg(F.avg("concentration").alias("avg_concentration")))


def size_stats(df: DataFrame, b: str) -> DataFrame:
    """Mean, population deviation, least and largest size over all ids from 0 to the largest, absent ones as 0."""
    sizes = df.groupBy(b).agg(F.count("*").alias("n"))
    ids = sizes.agg(F.max(b).alias("m")).select(F.explode(F.sequence(F.lit(0), F.col("m").cast("int"))).alias(b))
    every = ids.join(sizes, b, "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return every.agg(F.avg("n").alias("mean_size"), F.stddev_pop("n").alias("std_size"), F.min("n").alias("min_size"), F.max("n").alias("max_size"))


def balance(df: DataFrame, b: str, eps: float = 1e-10) -> DataFrame:
    """Natural-log entropy of cluster shares (with eps inside the logarithm and without), and each over ln k."""
    p = df.groupBy(b).agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))
    out = p.agg((-F.sum(F.col("p") * F.log(F.col("p") + eps))).alias("balance"), (-F.sum(xlogx(F.col("p")))).alias("entropy"), F.count("*").alias("k"))
    over = F.when(F.col("k") > 1, F.log(F.col("k").cast("double")))
    return out.select("balance", F.coalesce(F.col("balance") / over, F.lit(0.0)).alias("norm_balance"), "entropy", F.coalesce(F.col("entropy") / over, F.lit(0.0)).alias("norm_entropy"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: mutual information (nats), its normalised form, adjusted Rand index.

    All from the cells and their margins, which windows over the small cell table give.
    """
    c = counts(df, a, b)
    c = c.select(
        F.col("n").cast("double").alias("n"),
        F.sum("n").over(Window.partitionBy(a)).cast("double").alias("na"),
        F.sum("n").over(Window.partitionBy(b)).cast("double").alias("nb"),
        F.count("*").over(Window.partitionBy(a)).alias("ka"),
        F.count("*").over(Window.partitionBy(b)).alias("kb"),
        F.sum("n").over(Window.partitionBy()).cast("double").alias("t"),
    )
    pairs = lambda x: x * (x - 1) / 2
    s = c.agg(
        F.max("t").alias("t"),
        F.sum(F.col("n") / F.col("t") * F.log(F.col("t") * F.col("n") / (F.col("na") * F.col("nb")))).alias("mi"),
        # each class's term comes once, spread over its cells
        (-F.sum(xlogx(F.col("na") / F.col("t")) / F.col("ka"))).alias("ha"),
        (-F.sum(xlogx(F.col("nb") / F.col("t")) / F.col("kb"))).alias("hb"),
        F.sum(pairs(F.col("n"))).alias("s"),
        F.sum(pairs(F.col("na")) / F.col("ka")).alias("pa"),
        F.sum(pairs(F.col("nb")) / F.col("kb")).alias("pb"),
    )
    total = pairs(F.col("t"))
    expected = F.col("pa") * F.col("pb") / F.when(total > 0, total)
    top = (F.col("pa") + F.col("pb")) / 2
    h = F.col("ha") + F.col("hb")
    return s.select(
        F.greatest(F.col("mi"), F.lit(0.0)).alias("mi"),
        F.when(h < 1e-12, F.lit(1.0)).otherwise(2 * F.greatest(F.col("mi"), F.lit(0.0)) / F.when(h < 1e-12, 1.0).otherwise(h)).alias("nmi"),
        F.coalesce(F.when(F.abs(top - expected) > 1e-12, (F.col("s") - expected) / F.when(F.abs(top - expected) > 1e-12, top - expected)), F.lit(1.0)).alias("ari"),
    )


def cluster_sets(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, clusters): ids of the clusters that a class touches; at most one entry a cluster."""
    return df.groupBy(a).agg(F.sort_array(F.collect_set(b)).alias("clusters"))


def jaccard_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a1, a2, overlap) of each pair of classes, by the clusters they touch."""
    s = cluster_sets(df, a, b)
    left, right = s.select(F.col(a).alias("a1"), F.col("clusters").alias("c1")), s.select(F.col(a).alias("a2"), F.col("clusters").alias("c2"))
    shared, every = F.size(F.array_intersect("c1", "c2")), F.size(F.array_union("c1", "c2"))
    return left.join(F.broadcast(right), F.col("a1") < F.col("a2")).select("a1", "a2", (shared / every).alias("overlap"))


def co_cluster(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a1, a2, rate): the share of row pairs of two classes that fall into one cluster."""
    c = counts(df, a, b).withColumn("size", F.sum("n").over(Window.partitionBy(a)))
    l, r = c.select(b, F.col(a).alias("a1"), F.col("n").alias("n1"), F.col("size").alias("s1")), c.select(b, F.col(a).alias("a2"), F.col("n").alias("n2"), F.col("size").alias("s2"))
    sizes = c.select(a, "size").distinct()
    pairs = sizes.select(F.col(a).alias("a1"), F.col("size").alias("s1")).join(F.broadcast(sizes.select(F.col(a).alias("a2"), F.col("size").alias("s2"))), F.col("a1") < F.col("a2"))
    met = l.join(r, b).where("a1 < a2").groupBy("a1", "a2").agg(F.sum(F.col("n1") * F.col("n2")).alias("m"))
    return pairs.join(met, ["a1", "a2"], "left").select("a1", "a2", (F.coalesce("m", F.lit(0)) / (F.col("s1") * F.col("s2"))).alias("rate"))


def matrix_order(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, row, col): cells with the places of classes by concentration and of clusters by purity, largest first."""
    rows = concentration(df, a, b).select(a, F.row_number().over(Window.orderBy(F.desc("concentration"), a)).alias("row"))
    cols = purity_by(df, a, b).select(b, F.row_number().over(Window.orderBy(F.desc("purity"), b)).alias("col"))
    return contingency(df, a, b).join(F.broadcast(rows), a).join(F.broadcast(cols), b).select(a, b, "n", "row", "col")


def value_counts(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, value, n, share, size) of the most frequent value of each group, the least of equals."""
    ranked = counts(df, by, value).withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), value))).withColumn("size", F.sum("n").over(Window.partitionBy(by)))
    return ranked.where("k = 1").select(by, value, "n", (F.col("n") / F.col("size")).alias("share"), "size")
