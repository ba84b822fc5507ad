"""Feature scoring and selection; features are rows of a long table (track, feature, value)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxolens.functions.numeric import clean, unit_range

#: Weight of each score in the ensemble.
WEIGHTS = {"anova": 0.25, "mutual_info": 0.20, "random_forest": 0.20, "extra_trees": 0.15, "variance": 0.10, "cluster_separation": 0.10}
#: Depth of trees that the studied system grows without a limit.
FREE_DEPTH = 20
#: Nodes of a forest that the driver holds at once.
NODES = 1_000_000


def melt(df: DataFrame, key: str, columns: list[str], *keep: str) -> DataFrame:
    """(key, keep..., feature, pos, value)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(i).alias("pos"), clean(F.col(f"`{c}`")).alias("value")) for i, c in enumerate(columns)])
    return df.select(key, *keep, F.explode(pairs).alias("_f")).select(key, *keep, "_f.*")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(f1, p1, f2, p2, r) of each pair of columns; r over the rows that have both, null where either is constant there or no row has both.

    Matrix products of Arrow batches give each task's sums for all pairs at once, of values less the
    column's mean; one row a pair and task is shuffled. Two passes over the table, no join of rows.
    """
    k = len(columns)
    values = [clean(F.col(f"`{c}`")) for c in columns]
    centre = df.agg(F.array(*[F.coalesce(F.avg(v), F.lit(0.0)) for v in values]).alias("m")).first().m
    around = df.sparkSession.sparkContext.broadcast(np.array(centre, float))
    one, two = np.triu_indices(k, 1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, k, k))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float) - around.value
            there = ~np.isnan(x)
            x, there = np.where(there, x, 0.0), there.astype(float)
            # rows with both; sums of the row's column and of its square where the other is there; products
            total += np.stack([there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x])
        if total[0].any():
            n, s, q, p = total
            for lo in range(0, len(one), 50_000):
                i, j = one[lo : lo + 50_000], two[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(pa.array(v) for v in (n[i, j], s[i, j], s[j, i], q[i, j], q[j, i], p[i, j]))], ["p1", "p2", "n", "sx", "sy", "qx", "qy", "xy"])

    parts = df.select(*[v.alias(f"c{i}") for i, v in enumerate(values)]).mapInArrow(sums, "p1 int, p2 int, n double, sx double, sy double, qx double, qy double, xy double")
    t = parts.groupBy("p1", "p2").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "qx", "qy", "xy")])
    n = F.when(F.col("n") > 0, F.col("n"))
    spread = lambda q, s: F.col(q) - F.col(s) * F.col(s) / n
    varied = (spread("qx", "sx") > 1e-12 * F.col("qx")) & (spread("qy", "sy") > 1e-12 * F.col("qy"))
    r = (F.col("xy") - F.col("sx") * F.col("sy") / n) / F.sqrt(F.when(varied, spread("qx", "sx") * spread("qy", "sy")))
    r = F.when(varied, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    names = F.array(*[F.lit(c) for c in columns])
    return t.select(F.get(names, F.col("p1")).alias("f1"), "p1", F.get(names, F.col("p2")).alias("f2"), "p2", r.alias("r"))


def remove_correlated(df: DataFrame, columns: list[str], threshold: float = 0.95) -> DataFrame:
    """(feature, kept): a column goes if it correlates beyond the threshold with any earlier one, kept or not."""
    spark = df.sparkSession
    gone = correlations(df, columns).where((F.abs("r") > threshold) & ~F.isnan("r")).select(F.col("f2").alias("feature")).distinct().withColumn("gone", F.lit(True))
    names = spark.createDataFrame([(c, i) for i, c in enumerate(columns)], "feature string, pos int")
    return names.join(F.broadcast(gone), "feature", "left").select("feature", F.col("gone").isNull().alias("kept"))


def _variation(long: DataFrame, by: str) -> DataFrame:
    """Between and within sums of squares of each feature.

    From each group's size, mean and variance, which are merged without taking one large sum from
    another, so values far from 0 do no harm.
    """
    v = F.col("value")
    groups = long.where("value is not null").groupBy("feature", by).agg(F.count("*").alias("n"), F.avg(v).alias("m"), (F.var_pop(v) * F.count("*")).alias("w"))
    every = Window.partitionBy("feature")
    grand = F.sum(F.col("n") * F.col("m")).over(every) / F.sum("n").over(every)
    groups = groups.withColumn("off", F.col("m") - grand)
    return groups.groupBy("feature").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("off") * F.col("off")).alias("between"), F.sum("w").alias("within"))


def anova(long: DataFrame, by: str) -> DataFrame:
    """(feature, f)."""
    v = _variation(long, by)
    ok = (F.col("k") > 1) & (F.col("n") > F.col("k")) & (F.col("within") > 0)
    return v.select("feature", F.when(ok, (F.col("between") / F.when(ok, F.col("k") - 1)) / (F.when(ok, F.col("within")) / F.when(ok, F.col("n") - F.col("k")))).alias("f"))


def separation(long: DataFrame, cluster: str) -> DataFrame:
    """(feature, separation): between over within, with 1e-6 added below."""
    return _variation(long, cluster).select("feature", (F.col("between") / (F.col("within") + 1e-6)).alias("separation"))


def variance(long: DataFrame) -> DataFrame:
    """(feature, variance): sample variance over the largest; 0.5 for all if every one is 0."""
    v = long.groupBy("feature").agg(F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("v"))
    top = F.max("v").over(Window.partitionBy())
    return v.select("feature", F.when(top > 0, F.col("v") / F.when(top > 0, top)).otherwise(0.5).alias("variance"))


def binned_mi(long: DataFrame, by: str, bins: int = 8) -> DataFrame:
    """(feature, mi) between equal-width bins of a feature and a class; not the neighbour estimator."""
    edge = long.where("value is not null").groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("value") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo"))).otherwise(0.0)
    b = long.where("value is not null").join(F.broadcast(edge), "feature").select("feature", F.col(by).alias("g"), F.least(F.lit(bins - 1), F.floor(width * bins).cast("int")).alias("b"))
    c = b.groupBy("feature", "g", "b").agg(F.count("*").alias("n"))
    over = lambda *k: F.sum("n").over(Window.partitionBy("feature", *k))
    c = c.select("feature", "n", over("g").alias("ng"), over("b").alias("nb"), over().alias("t"))
    return c.groupBy("feature").agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("t") * F.col("n") / (F.col("ng") * F.col("nb")))).alias("mi"))


def _jitter(key: str) -> Column:
    """A number in [-0.5, 0.5) for each row and feature, the same in every run."""
    return F.pmod(F.xxhash64(key, "feature"), F.lit(1 << 40)) / float(1 << 40) - 0.5


def knn_mi(long: DataFrame, by: str, key: str, k: int = 3, jitter: Column | None = None) -> DataFrame:
    """(feature, mi): neighbour estimate of mutual information between a number and a class, held at 0 from below.

    Values are divided by their feature's deviation and moved by a tiny jitter, which parts ties. Classes of one row
    are left out; nulls count as 0. No group holds a column: order statistics come from two range-sorted passes
    whose tasks know what lies beyond their edges (see operators/ordered.py). By feature and class, the k-th neighbour
    inside the class; by feature, how many values lie nearer than that. key: tells a feature's rows apart.
    """
    from taxolens.functions.estimators import digamma
    from taxolens.operators import ordered

    spark = long.sparkSession
    rows = long.select("feature", F.col(by).cast("string").alias("label"), F.col(key).alias("key"), F.coalesce("value", F.lit(0.0)).cast("double").alias("x"), (_jitter(key) if jitter is None else jitter).alias("_j")).where("label is not null")
    facts = rows.groupBy("feature").agg(F.stddev_pop("x").alias("s"), F.avg(F.abs("x")).alias("m"))
    facts = facts.select("feature", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("s"), F.greatest(F.lit(1.0), "m").alias("m")).withColumn("f", F.row_number().over(Window.orderBy("feature")) - 1)
    names = {r.f: (r.feature, r.s, r.m) for r in facts.collect()}
    labels = sorted(r[0] for r in rows.select("label").distinct().collect())
    if not names:
        return spark.createDataFrame([], "feature string, mi double")
    codes = spark.createDataFrame(list(enumerate(labels)), "c int, label string")
    known = spark.createDataFrame([(n, i, s, m) for i, (n, s, m) in names.items()], "feature string, f int, s double, m double")
    made = rows.join(F.broadcast(known), "feature").join(F.broadcast(codes), "label")
    x = F.col("x") / F.col("s") + 1e-10 * F.col("m") * F.col("_j")
    made = made.select((F.col("f").cast("bigint") * len(labels) + F.col("c")).alias("g"), x.alias("at"), F.lit(1).alias("kind"), F.xxhash64("key").alias("id")).persist()
    sizes = {r.g: r.n for r in made.groupBy("g").agg(F.count("*").alias("n")).collect() if r.n > 1}
    near = ordered.counts_within(ordered.radii(made, k, sizes), len(labels))

    @F.pandas_udf("double")
    def psi(n: pd.Series) -> pd.Series:
        return pd.Series(digamma(n.to_numpy(float)))

    got = {r.f: r.s for r in near.groupBy("f").agg(F.sum(psi(F.greatest("n", F.lit(1)))).alias("s")).collect()}
    made.unpersist()
    out = []
    for f, (name, _, _) in names.items():
        n = np.array([sizes.get(f * len(labels) + c, 0) for c in range(len(labels))], float)
        n = n[n > 0]
        total = n.sum()
        mi = float(digamma(total) + ((n * digamma(np.minimum(k, n - 1))).sum() - (n * digamma(n)).sum() - got[f]) / total) if total else 0.0
        out.append((name, max(0.0, mi)))
    return spark.createDataFrame(out, "feature string, mi double")


def ensemble(scores: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(feature, ensemble_score, rank) from a wide score table: each score to its unit range, then the weighted sum.

    Every score that weights names has to be there (the plans pass all six, WEIGHTS). Without weights,
    the table's own scores get theirs.
    """
    weights = {c: w for c, w in WEIGHTS.items() if c in scores.columns} if weights is None else weights
    if lacking := [c for c in weights if c not in scores.columns]:
        raise ValueError(f"no scores {', '.join(lacking)}")
    w = Window.partitionBy()
    unit = [unit_range(F.col(c), F.min(c).over(w), F.max(c).over(w)).alias(c) for c in weights]
    first, *rest = weights
    total = sum((F.col(c) * weights[c] for c in rest), F.col(first) * weights[first])
    out = scores.select("feature", *unit).withColumn("ensemble_score", total)
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("ensemble_score"), "feature")))


def six_scores(df: DataFrame, key: str, label: str, columns: list[str], clusters: DataFrame, alternate: bool = False) -> DataFrame:
    """(feature, anova, mutual_info, random_forest, extra_trees, variance, cluster_separation) of each column; no nulls.

    clusters: (key, cluster). The alternate form grows deeper trees (FREE_DEPTH; the studied system sets no
    limit) and takes the population variance as it is. Nulls count as 0 in trees and neighbours.
    """
    long = melt(df, key, columns, label)
    rows = df.select(F.col(label).alias("_label"), F.array(*[F.coalesce(clean(F.col(f"`{c}`")), F.lit(0.0)) for c in columns]).alias("_v"))
    depth = FREE_DEPTH if alternate else 10
    names = F.array(*[F.lit(c) for c in columns])
    out = anova(long, label).withColumnRenamed("f", "anova").join(knn_mi(long, label, key).withColumnRenamed("mi", "mutual_info"), "feature", "full")
    for name, one in (("random_forest", forest_importance(rows, "_label", "_v", 100, depth)), ("extra_trees", tree_importance(rows, "_label", "_v", 100, depth))):
        out = out.join(one.select(F.get(names, F.col("pos")).alias("feature"), F.col("importance").alias(name)), "feature", "full")
    spread = long.groupBy("feature").agg(F.var_pop("value").alias("variance")) if alternate else variance(long)
    out = out.join(spread, "feature", "full").join(separation(long.join(clusters, key), "cluster").withColumnRenamed("separation", "cluster_separation"), "feature", "full")
    return out.select("feature", *WEIGHTS).na.fill(0.0)


def selected(ranking: DataFrame, n: int) -> DataFrame:
    """The best n, worst first, as the order of the columns they become."""
    return ranking.where(F.col("rank") <= n).orderBy(F.desc("rank"))


def hybrid(first: DataFrame, ranking: DataFrame, extra: int) -> DataFrame:
    """(feature, ord): the features of first (feature, ord), then the best `extra` of the ranking that it lacks."""
    rest = ranking.join(first.select("feature"), "feature", "left_anti").orderBy("rank", "feature").limit(extra)
    more = rest.select("feature", (F.row_number().over(Window.orderBy("rank", "feature")) + F.lit(100_000)).alias("ord"))
    both = first.select("feature", F.col("ord").cast("int").alias("ord")).unionByName(more)
    return both.select("feature", F.row_number().over(Window.orderBy("ord", "feature")).alias("ord"))


def row_sum_rank(scores: DataFrame, columns: list[str], top: int) -> DataFrame:
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return scores.withColumn("total", total).orderBy(F.desc("total"), "feature").limit(top)


def tree_importance(df: DataFrame, label: str, vector: str, trees: int = 100, depth: int = 10, seed: int = 42) -> DataFrame:
    """(pos, importance) by extremely randomised trees, grown over the distributed table (see operators/trees.py)."""
    from taxolens.operators.trees import importances

    return importances(df, label, vector, trees, depth, seed)


def forest_importance(df: DataFrame, label: str, vector: str, trees: int = 100, depth: int = 10, seed: int = 42) -> DataFrame:
    """(pos, importance) by the built-in random forest.

    It keeps its nodes on the driver, so trees are grown in sets of NODES nodes at most (or one tree), each set with the next seed.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector

    data = df.select(array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"), F.col(label).cast("string").alias("y"))
    data = StringIndexer(inputCol="y", outputCol="label").fit(data).transform(data).persist()
    nodes = min(2 * data.count(), 1 << (depth + 1))
    together, total = max(1, NODES // max(nodes, 1)), 0.0
    for i, lo in enumerate(range(0, trees, together)):
        some = min(together, trees - lo)
        model = RandomForestClassifier(numTrees=some, maxDepth=depth, seed=seed + i).fit(data)
        total = total + some / trees * model.featureImportances.toArray()
    data.unpersist()
    return df.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(total)], "pos int, importance double")
