"""Clustering: forced, natural and divisive, Ward's tree of rows and the average-linkage tree of classes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from taxolens.operators import curves, geometry, lloyd, ward
from taxolens.operators.divisive import divisive as divisive  # part of this module's surface

#: Rows from which first centres are drawn; all rows are clustered.
INIT_ROWS = 20_000
#: Rows of each table from which the first centres of the gap statistic and of greedy selection are drawn.
GAP_INIT = 2_000
#: K-means starts and rounds of the studied system.
STARTS, ROUNDS = 50, 300


def _vectors(df: DataFrame, vector: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("_features", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))


def _starts(data: lloyd.Table, ks: list[int], starts: int, seed: int) -> list[list[lloyd.Model]]:
    """Models of every k and start; first centres are drawn from INIT_ROWS rows at most, those with the least hashes.

    A start draws for the largest k; smaller ones take its first k.
    """
    some = lloyd.matrix_of(data.rows.orderBy(F.xxhash64("v"), "v").limit(INIT_ROWS).select("v").toArrow()["v"].combine_chunks())
    drawn = lloyd.first_centres(some - data.middle, max(ks), starts, seed)
    return [[lloyd.Model(c[:k].copy()) for c in drawn] for k in ks]


def _fitted(data: lloyd.Table, ks: list[int], starts: int, rounds: int, seed: int) -> list[lloyd.Model]:
    """For each k the cheapest of all starts, its centres in order."""
    models = _starts(data, ks, starts, seed)
    lloyd.advance(data, [m for some in models for m in some], rounds)
    best = [min(some, key=lambda m: m.cost) for some in models]
    for m in best:
        m.centres = m.centres[np.lexsort(m.centres.T[::-1])]
    return best


def forced(df: DataFrame, vector: str, k: int = 35, starts: int = STARTS, rounds: int = ROUNDS, seed: int = 42, out: str = "cluster") -> DataFrame:
    """df with a cluster id: distributed k-means, the cheapest of several seeded starts.

    All starts advance in the same pass over the rows, one job a round, until their centres rest. Ids are
    numbered by centre, so they don't depend on the start.
    """
    data = lloyd.table(df, vector)
    if not data.spread:
        data.unpersist()
        return df.withColumn(out, F.lit(0))
    best = _fitted(data, [k], starts, rounds, seed)[0].centres
    data.unpersist()
    shared = df.sparkSession.sparkContext.broadcast((best, data.middle))

    @F.pandas_udf("int")
    def label(v: pd.Series) -> pd.Series:
        x = np.array(v.tolist(), float).reshape(len(v), -1)
        return pd.Series(lloyd.nearest(x - shared.value[1], shared.value[0])[0].astype("int32"))

    return df.withColumn(out, label(F.transform(vector, lambda x: x.cast("double"))))


def natural(df: DataFrame, key: str, vector: str, low: int = 15, high: int = 40, starts: int = STARTS, seed: int = 42, out: str = "cluster") -> DataFrame:
    """df with the cluster ids of the k that the elbows of the sweep vote for."""
    k = natural_k(sweep(df, key, vector, list(range(low, high + 1)), starts, seed), low, high).first().k
    return forced(df, vector, k, starts, seed=seed, out=out)


def moments(rows: DataFrame, sizes: list[int], middle: np.ndarray, centres: list[np.ndarray] | None = None, columns: list[list[int]] | None = None) -> tuple[list[np.ndarray], ...]:
    """Of each labelling's clusters: sizes and mean vectors; or, given centres, sums of distances and of their squares. One pass for all labellings.

    rows: codes array<int> and v; columns: places of those that each labelling's distances take, all if not given. What reaches the driver is one row a cluster.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    shared = rows.sparkSession.sparkContext.broadcast(centres)
    width = len(middle) if centres is None else 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = [np.zeros(k) for k in sizes], [np.zeros((k, width)) for k in sizes]
        for batch in batches:
            if not len(batch):
                continue
            x = lloyd.matrix_of(batch.column("v")) - middle
            codes = batch.column("codes").flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
            for i, k in enumerate(sizes):
                there = codes[:, i] >= 0
                code, part = codes[there, i], x[there]
                if shared.value is not None:
                    own = slice(None) if columns is None else columns[i]
                    d = ((part[:, own] - shared.value[i][code][:, own]) ** 2).sum(1)
                    part = np.column_stack([np.sqrt(d), d])
                member = np.zeros((len(part), k))
                member[np.arange(len(part)), code] = 1
                n[i] += member.sum(0)
                sums[i] += member.T @ part
        for i in range(len(sizes)):
            j = np.flatnonzero(n[i])
            each = pa.ListArray.from_arrays(pa.array(np.arange(len(j) + 1) * width, pa.int32()), pa.array(sums[i][j].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(j), pa.int32()), pa.array(j, pa.int32()), pa.array(n[i][j]), each], ["i", "j", "n", "s"])

    parts = rows.select("codes", "v").mapInArrow(run, "i int, j int, n double, s array<double>")
    got = parts.groupBy("i", "j").agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s")).collect()
    n, sums = [np.zeros(k) for k in sizes], [np.zeros((k, width)) for k in sizes]
    for r in got:
        n[r.i][r.j], sums[r.i][r.j] = r.n, r.s
    return n, sums


def spread_measures(n: np.ndarray, centres: np.ndarray, away: np.ndarray) -> tuple[float, float, float] | None:
    """Calinski-Harabasz, Davies-Bouldin and inertia from clusters' sizes, centres and sums of distances and squares; None for fewer than two."""
    j = np.flatnonzero(n)
    if len(j) < 2:
        return None
    c, size, total = centres[j], n[j], n.sum()
    spread, within = away[j, 0] / size, away[j, 1].sum()
    gap = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2))
    np.fill_diagonal(gap, np.inf)
    between = (size * ((c - (size[:, None] * c).sum(0) / total) ** 2).sum(1)).sum()
    return float(between / (len(j) - 1) / max(within / max(total - len(j), 1), 1e-12)), float(((spread[:, None] + spread[None]) / gap).max(1).mean()), float(within)


def sweep(df: DataFrame, key: str, vector: str, ks: list[int], starts: int = STARTS, seed: int = 42) -> DataFrame:
    """(k, silhouette, calinski, davies_bouldin, inertia) of the best of several starts for each k; (-1, 0, inf, inf) for fewer than two clusters.

    One algorithm at every size: all k and starts advance in one scan a round; then one scan labels the rows for every k, two
    give sums by cluster, and one pass over the distances serves the silhouettes of every k.
    """
    spark = df.sparkSession
    data = lloyd.table(df, vector)
    ks = [int(k) for k in ks]
    shape = "k int, silhouette double, calinski double, davies_bouldin double, inertia double"
    total = sum(n for n, _ in data.spread.values())
    if not total:
        return spark.createDataFrame([(k, -1.0, 0.0, math.inf, math.inf) for k in ks], shape)
    models = _fitted(data, ks, starts, ROUNDS, seed)
    sizes = [len(m.centres) for m in models]
    rows = lloyd.labels(data, models).persist()
    n, sums = moments(rows, sizes, data.middle)
    centres = [s / np.maximum(c, 1)[:, None] for s, c in zip(sums, n, strict=True)]
    _, away = moments(rows, sizes, data.middle, centres)
    values = geometry.silhouettes(rows.select(F.struct(F.lit(0).alias("row")).alias("keep"), F.lit(0).alias("grp"), "codes", "v"), sizes, n=total)
    near = {r.pos: r.s for r in values.select(F.posexplode("silhouettes").alias("pos", "s")).groupBy("pos").agg(F.avg("s").alias("s")).collect()}
    out = []
    for i, k in enumerate(ks):
        measured = spread_measures(n[i], centres[i], away[i])
        out.append((k, -1.0, 0.0, math.inf, math.inf) if measured is None else (k, float(near[i]), *measured))
    rows.unpersist()
    data.unpersist()
    return spark.createDataFrame(out, shape)


def natural_k(curve: DataFrame, low: int, high: int) -> DataFrame:
    """(k): the vote of the elbows of all four measures."""
    votes = None
    for y in ("silhouette", "calinski", "davies_bouldin", "inertia"):
        one = curves.elbow(curve, "k", y)
        votes = one if votes is None else votes.unionByName(one)
    return curves.vote(votes, low, high)


def _boxes(spark: SparkSession, n: int, low: np.ndarray, high: np.ndarray, references: int, seed: int) -> DataFrame:
    """(grp, v): n uniform rows in a box for each reference, made on executors; a row depends on the seed, its reference and its place alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            grp, at = ids // n, ids % n
            x = np.empty((len(ids), len(low)))
            for i, (g, r) in enumerate(zip(grp.tolist(), at.tolist(), strict=True)):
                x[i] = np.random.Generator(np.random.Philox(key=[seed, g], counter=[0, 0, 0, r])).random(len(low))
            each = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * len(low), pa.int32()), pa.array((low + x * (high - low)).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(grp + 1, pa.int32()), each], ["grp", "v"])

    return spark.range(0, n * references).mapInArrow(run, "grp int, v array<double>")


def gap_statistic(df: DataFrame, key: str, vector: str, ks: list[int], references: int = 10, seed: int = 42, starts: int = 10) -> DataFrame:
    """(k, gap, s): against uniform boxes around the rows.

    The references are made on executors and clustered with the rows: every pair of k and reference, all starts,
    in one scan a round.
    """
    spark = df.sparkSession
    own = df.where(F.col(vector).isNotNull()).select(F.lit(0).alias("grp"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    edges = own.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n")).orderBy("at").collect()
    shape = "k int, gap double, s double"
    if not edges:
        return spark.createDataFrame([], shape)
    low, high, n = np.array([r.low for r in edges]), np.array([r.high for r in edges]), edges[0].n
    data = lloyd.table(own.union(_boxes(spark, n, low, high, references, seed)), "v", group="grp")
    hashed = data.rows.withColumn("at", F.row_number().over(Window.partitionBy("grp").orderBy(F.xxhash64("v"), "v"))).where(F.col("at") <= GAP_INIT)
    got = hashed.orderBy("grp", "at").select("grp", "v").toArrow()
    groups, some = got["grp"].to_numpy(), lloyd.matrix_of(got["v"].combine_chunks()) - data.middle
    models = {(g, k): [] for g in range(references + 1) for k in ks}
    for g in range(references + 1):
        for c in lloyd.first_centres(some[groups == g], max(ks), starts, seed):
            for k in ks:
                models[g, k].append(lloyd.Model(c[:k].copy(), g))
    lloyd.advance(data, [m for each in models.values() for m in each], ROUNDS)
    data.unpersist()
    out = []
    for k in ks:
        w = np.log(np.maximum([min(m.cost for m in models[g, k]) for g in range(references + 1)], 1e-300))
        out.append((int(k), float(w[1:].mean() - w[0]), float(w[1:].std() * math.sqrt(1 + 1 / references))))
    return spark.createDataFrame(out, shape)


def tree(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(step, kept, gone, distance, size): merges of the Ward tree in order of height; rows are named by their place in order of the key."""
    found = ward.tree(df, key, vector)[1]
    return found.select(F.col("step").cast("int").alias("step"), "kept", "gone", F.sqrt("d").alias("distance"), "size")


def tree_labels(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(key, cluster): the Ward tree cut into k parts."""
    return ward.labels(df, key, vector, k)


def cophenetic(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(cophenetic): correlation of distances and heights of the Ward tree."""
    return ward.cophenetic(df, key, vector)


def class_tree(similarity: DataFrame, families: dict | None = None) -> DataFrame:
    """(step, left, right, distance, size, family): average linkage of classes from (genre1, genre2, similarity).

    Leaves are numbered in order of the class. family: that of all classes below a merge, from a map of
    class to family; mixed where they differ, null for classes without one.
    """
    from taxolens.functions.estimators import linkage

    square = similarity.toPandas().pivot(index="genre1", columns="genre2", values="similarity").sort_index().sort_index(axis=1)
    m = square.to_numpy(float).copy()
    np.fill_diagonal(m, 1.0)
    d = 1 - m / m.max()
    d = (d + d.T) / 2
    np.fill_diagonal(d, 0.0)
    below = [(families or {}).get(c) for c in square.index]
    rows = []
    for i, (a, b, h, n) in enumerate(linkage(d, "average")):
        one, two = below[int(a)], below[int(b)]
        below.append(one if one == two else "mixed")
        rows.append((i, int(a), int(b), float(h), int(n), below[-1]))
    return similarity.sparkSession.createDataFrame(rows, "step int, left int, right int, distance double, size int, family string")


def _tried(data: lloyd.Table, sample: np.ndarray, chosen: list[int], some: list[int], k: int, starts: int, rounds: int, seed: int) -> list[tuple[int, float]]:
    """(column, mean silhouette) of k clusters on the chosen columns and each one of some, best first.

    Every candidate's starts are models of the same scans; the best ones' silhouettes come from one pass over the distances.
    """
    models = []
    for p in some:
        own = np.array([*chosen, p])
        spread = float(data.variances[0][own].mean())
        models.append([lloyd.Model(c, 0, own, spread=spread) for c in lloyd.first_centres(sample[:, own], k, starts, seed)])
    lloyd.advance(data, [m for each in models for m in each], rounds)
    best = [min(each, key=lambda m: m.cost) for each in models]
    sizes = [len(m.centres) for m in best]
    rows = lloyd.labels(data, best).select(F.struct(F.lit(0).alias("row")).alias("keep"), "grp", "codes", "v")
    got = geometry.silhouettes(rows, sizes, columns=(list(chosen), list(some)), n=data.spread[0][0])
    mean = {r.pos: float(r.s) for r in got.select(F.posexplode("silhouettes").alias("pos", "s")).groupBy("pos").agg(F.avg("s").alias("s")).collect()}
    if any(s == 0 for s in mean.values()):  # one cluster, or a rare draw
        kinds = rows.select(F.posexplode("codes").alias("pos", "code")).groupBy("pos").agg(F.count_distinct("code").alias("n")).collect()
        mean |= {r.pos: -1.0 for r in kinds if r.n < 2}
    return sorted(((some[pos], s) for pos, s in mean.items()), key=lambda r: (-r[1], r[0]))


def greedy_silhouette(df: DataFrame, key: str, vector: str, n: int = 20, k: int = 35, pool: int = 80, seed: int = 42) -> DataFrame:
    """(ord, pos, silhouette): columns picked one by one so that the clusters' silhouette is largest.

    The pool is of the best single columns. All candidates of a step share its scans; no bound on rows. First centres are
    drawn from GAP_INIT rows at most, those with the least hashes.
    """
    spark = df.sparkSession
    shape = "ord int, pos int, silhouette double"
    data = lloyd.table(df, vector)
    if not data.spread:
        return spark.createDataFrame([], shape)
    sample = lloyd.matrix_of(data.rows.orderBy(F.xxhash64("v"), "v").limit(GAP_INIT).select("v").toArrow()["v"].combine_chunks()) - data.middle
    # fixed values: starts and rounds for single columns and for steps
    alone = _tried(data, sample, [], list(range(len(data.middle))), k, 5, 50, seed)[:pool]
    picked = alone[:1]
    while len(picked) < min(n, len(alone)):
        taken = [p for p, _ in picked]
        picked.append(_tried(data, sample, taken, [p for p, _ in alone if p not in taken], k, 10, 100, seed)[0])
    data.unpersist()
    return spark.createDataFrame([(i + 1, p, s) for i, (p, s) in enumerate(picked)], shape)


def projection(df: DataFrame, vector: str, *keep: str) -> DataFrame:
    """keep, px, py: the first two principal components. A linear stand-in; distances mean other things than in a neighbour embedding."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    data = _vectors(df, vector)
    return PCA(k=2, inputCol="_features", outputCol="_p").fit(data).transform(data).select(*keep, vector_to_array("_p")[0].alias("px"), vector_to_array("_p")[1].alias("py"))
