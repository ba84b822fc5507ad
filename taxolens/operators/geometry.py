"""Centroids, similarities and internal clustering measures over vectors in an array column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxolens.functions.estimators import added_distance_sums, distance_sums
from taxolens.functions.numeric import dot, norm


def long(df: DataFrame, vector: str, *keep: str) -> DataFrame:
    """(keep..., dim, x): one row a component."""
    return df.select(*keep, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def centroids(df: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, centroid, size): mean vector, by one aggregate of whole vectors; nothing but a vector a group and task is shuffled."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    g = df.select(by, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("_v")).groupBy(by)
    return g.agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("centroid"), F.count("*").alias("size"))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / F.when(n > 0, n)).otherwise(F.lit(0.0))


def _centres(df: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, centroid, similarity) in one pass: mean vector, and mean cosine over all pairs of a group, 1 for a single row.

    The pairs' sum follows from the sum of unit vectors: (|sum u|^2 - sum |u|^2) / 2, so the cost is
    linear in the group.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = df.select(by, F.transform(vector, lambda x: x.cast("double")).alias("_v")).withColumn("_n", norm(F.col("_v")))
    unit = F.transform("_v", lambda x: F.when(F.col("_n") > 0, x / F.when(F.col("_n") > 0, F.col("_n"))).otherwise(0.0))
    rows = rows.select(by, array_to_vector("_v").alias("_v"), array_to_vector(unit).alias("_u"), "_n")
    g = rows.groupBy(by).agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("centroid"), vector_to_array(Summarizer.sum(F.col("_u"))).alias("s"), F.count("*").alias("n"), F.count_if(F.col("_n") > 0).alias("m"))
    similarity = F.when(F.col("n") > 1, (dot(F.col("s"), F.col("s")) - F.col("m")) / F.when(F.col("n") > 1, F.col("n") * (F.col("n") - 1))).otherwise(1.0)
    return g.select(by, "centroid", similarity.alias("similarity"))


def inner_similarity(df: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, similarity): mean cosine over all pairs of a group, 1 for a single row."""
    return _centres(df, by, vector).select(by, "similarity")


def convergence(df: DataFrame, by: str, vector: str) -> DataFrame:
    """(genre1, genre2, similarity): the full matrix; inside a class mean pair cosine, between classes that of centroids in [0, 1]."""
    c = _centres(df, by, vector)
    l, r = c.select(F.col(by).alias("genre1"), F.col("centroid").alias("c1"), "similarity"), c.select(F.col(by).alias("genre2"), F.col("centroid").alias("c2"))
    between = F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(F.col("c1"), F.col("c2"))))
    return l.crossJoin(F.broadcast(r)).select("genre1", "genre2", F.when(F.col("genre1") == F.col("genre2"), F.col("similarity")).otherwise(between).alias("similarity"))


def converging_pairs(df: DataFrame, by: str, vector: str, top: int | None = None) -> DataFrame:
    pairs = convergence(df, by, vector).where("genre1 < genre2")
    return pairs.orderBy(F.desc("similarity"), "genre1", "genre2").limit(top) if top else pairs


def convergence_stats(df: DataFrame, by: str, vector: str) -> DataFrame:
    off = convergence(df, by, vector).where("genre1 != genre2")
    return off.agg(F.min("similarity").alias("min_sim"), F.max("similarity").alias("max_sim"), F.avg("similarity").alias("mean_sim"), F.stddev_pop("similarity").alias("std_sim"))


def phantoms(df: DataFrame, by: str, vector: str, cluster: str, min_similarity: float = 0.5, max_overlap: float = 0.3) -> DataFrame:
    """Pairs of classes that sound alike but don't share clusters; score = similarity (1 - overlap)."""
    from taxolens.operators.contingency import jaccard_pairs

    overlap = jaccard_pairs(df, by, cluster).withColumnsRenamed({"a1": "genre1", "a2": "genre2"})
    both = converging_pairs(df, by, vector).join(overlap, ["genre1", "genre2"]).where((F.col("similarity") > min_similarity) & (F.col("overlap") < max_overlap))
    return both.select("genre1", "genre2", F.col("similarity").alias("acoustic_similarity"), F.col("overlap").alias("clustering_overlap"), (F.col("similarity") * (1 - F.col("overlap"))).alias("phantom_score"))


def distances_to_own(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """(cluster, d2): squared distance of each row to its cluster's centroid; the centroid table is joined, not collected."""
    c = centroids(df, cluster, vector)
    joined = df.select(cluster, F.transform(vector, lambda x: x.cast("double")).alias("_v")).join(c, cluster)
    return joined.select(cluster, F.aggregate(F.zip_with("_v", "centroid", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x).alias("d2"))


def inertia(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    return distances_to_own(df, cluster, vector).agg(F.sum("d2").alias("inertia"))


def calinski_harabasz(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """One row; null for fewer than two clusters or as many clusters as rows. From sizes, means and variances, so vectors far from 0 do no harm."""
    by = long(df, vector, cluster).groupBy(cluster, "dim").agg(F.avg("x").alias("m"), (F.var_pop("x") * F.count("*")).alias("w"), F.count("*").alias("n"))
    every = Window.partitionBy("dim")
    by = by.withColumn("off", F.col("m") - F.sum(F.col("n") * F.col("m")).over(every) / F.sum("n").over(every))
    dims = by.groupBy("dim").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("off") * F.col("off")).alias("between"), F.sum("w").alias("within"))
    t = dims.agg(F.sum("between").alias("between"), F.sum("within").alias("within"), F.max("n").alias("n"), F.max("k").alias("k"))
    ok = (F.col("k") > 1) & (F.col("n") > F.col("k")) & (F.col("within") > 0)
    return t.select(F.when(ok, (F.col("between") / F.when(ok, F.col("k") - 1)) / (F.when(ok, F.col("within")) / F.when(ok, F.col("n") - F.col("k")))).alias("calinski_harabasz"))


def davies_bouldin(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    scatter = distances_to_own(df, cluster, vector).groupBy(cluster).agg(F.avg(F.sqrt("d2")).alias("s"))
    c = centroids(df, cluster, vector).join(scatter, cluster)
    l, r = (c.select(F.col(cluster).alias(f"k{i}"), F.col("centroid").alias(f"c{i}"), F.col("s").alias(f"s{i}")) for i in (1, 2))
    gap = F.sqrt(F.aggregate(F.zip_with("c1", "c2", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    worst = l.join(F.broadcast(r), F.col("k1") != F.col("k2")).groupBy("k1").agg(F.max((F.col("s1") + F.col("s2")) / F.when(gap > 0, gap)).alias("w"))
    return worst.agg(F.avg(F.coalesce("w", F.lit(0.0))).alias("davies_bouldin"))


#: Rows of a block of the distance work, rows that a block meets in one task, and bytes of its sums.
BLOCK, STRIP, SUM_BYTES = 2048, 1 << 20, 32 << 20


def _silhouette(codes: np.ndarray, sums: np.ndarray, counts: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Silhouettes of rows from their distance sums to every cluster of every labelling; 0 for rows alone, without a label or with no other cluster."""
    out = np.zeros(codes.shape)
    at = 0
    for i, k in enumerate(sizes):
        n, s, own = counts[at : at + k], sums[:, at : at + k], codes[:, i]
        at += k
        ok = np.flatnonzero((own >= 0) & (n[np.maximum(own, 0)] > 1))
        if not len(ok) or (n > 0).sum() < 2:
            continue
        a = s[ok, own[ok]] / (n[own[ok]] - 1)
        other = np.where(n > 0, s[ok] / np.maximum(n, 1), np.inf)
        other[np.arange(len(ok)), own[ok]] = np.inf
        b = other.min(1)
        top = np.maximum(a, b)
        out[ok, i] = np.where(top > 0, (b - a) / np.where(top > 0, top, 1), 0.0)
    return out


def silhouettes(rows: DataFrame, sizes: list[int], block: int | None = None, strip: int | None = None, columns: tuple[list[int], list[int]] | None = None, n: int | None = None) -> DataFrame:
    """(keep, silhouettes): exact Euclidean silhouettes of every row for several labellings at once.

    rows: keep (a struct), grp int, codes array<int> (its cluster in each labelling, from 0; -1: none), v array<double>;
    sizes: clusters of each labelling.  Rows are compared inside their group.  columns: places of the columns that all labellings
    measure by, and of one more for each labelling; squared distances add over columns, so the first ones' are worked out once. Else all columns count.  n: how many rows there are, if known.

    All distances are needed: quadratic in time by definition.  Rows are packed into blocks, stored once.  A task
    takes some blocks and one strip of all rows; while a block meets the strip's blocks, each a matrix product, its distance sums by
    cluster are kept, and one row a block and strip leaves.  Up to STRIP rows there is one strip, and sums never
    leave their task.  No pair becomes a row, nothing passes the driver.
    """
    from taxolens.sources.sinks import bound_batches, scratch

    spark = rows.sparkSession
    kinds = sum(sizes)
    n = rows.count() if n is None else n
    cores = spark.sparkContext.defaultParallelism
    block = max(64, min(block or BLOCK, -(-n // (4 * cores)), SUM_BYTES // (8 * max(kinds, 1))))
    keep = rows.schema["keep"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column("grp").to_numpy()
            for g in np.unique(groups).tolist():
                own = batch.filter(pa.array(groups == g))
                for lo in range(0, len(own), block):
                    part = own.slice(lo, block)
                    points = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(float)
                    code = part.column("codes").flatten().to_numpy(zero_copy_only=False).astype("<i4")
                    each = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column("keep"))
                    yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), each, pa.array([code.tobytes()], pa.binary()), pa.array([points.tobytes()], pa.binary())], ["grp", "keep", "codes", "points"])

    bound_batches(spark)
    path = scratch(spark, "blocks")
    made = rows.select("grp", "keep", "codes", "v").mapInArrow(pack, f"grp int, keep array<{keep}>, codes binary, points binary")
    made.withColumn("block", F.monotonically_increasing_id()).write.parquet(path)
    packed = spark.read.parquet(path)
    strips = max(1, -(-n // (strip or STRIP)))
    left = packed.repartition(max(1, min(-(-n // block), 4 * cores)))
    right = packed.select(F.col("grp").alias("grp2"), F.col("block").alias("block2"), F.col("codes").alias("codes2"), F.col("points").alias("points2"))
    right = right.repartition(strips) if strips > 1 else right.coalesce(1)

    def members(codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), kinds))
        at = 0
        for i, k in enumerate(sizes):
            some = np.flatnonzero(codes[:, i] >= 0)
            out[some, at + codes[some, i]] = 1
            at += k
        return out

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, sums, counts = None, None, None, None
        for batch in batches:
            for i in range(len(batch)):
                if batch.column("block")[i].as_py() != now:
                    if held is not None:
                        yield leaving(held, sums, counts)
                    now, held = batch.column("block")[i].as_py(), batch.slice(i, 1)
                    x = np.frombuffer(batch.column("points")[i].as_buffer(), float)
                    x = x.reshape(len(batch.column("keep")[i]), -1)
                    sums, counts = np.zeros((len(x), kinds)), np.zeros(kinds)
                if batch.column("grp")[i].as_py() != batch.column("grp2")[i].as_py():
                    continue
                codes = np.frombuffer(batch.column("codes2")[i].as_buffer(), "<i4").reshape(-1, len(sizes))
                y = np.frombuffer(batch.column("points2")[i].as_buffer(), float).reshape(len(codes), -1)
                member, middle = members(codes), y.mean(0)
                a, b = x - middle, y - middle
                same = batch.column("block2")[i].as_py() == now
                if columns is None:
                    sums += distance_sums(a, b, member, same)
                else:
                    sums += added_distance_sums(a[:, columns[0]], b[:, columns[0]], x[:, columns[1]], y[:, columns[1]], member, sizes, same)
                counts += member.sum(0)
        if held is not None:
            yield leaving(held, sums, counts)

    def leaving(held: pa.RecordBatch, sums: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        if strips == 1:
            return finished(held, sums, counts)
        return pa.RecordBatch.from_arrays([held.column("block"), held.column("keep"), held.column("codes"), pa.array([sums.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())], ["block", "keep", "codes", "sums", "counts"])

    def finished(held: pa.RecordBatch, sums: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        codes = np.frombuffer(held.column("codes")[0].as_buffer(), "<i4").reshape(len(sums), -1)
        value = _silhouette(codes, sums, counts, sizes)
        each = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1) * len(sizes), pa.int32()), pa.array(value.ravel()))
        return pa.RecordBatch.from_arrays([held.column("keep")[0].values, each], ["keep", "silhouettes"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums, counts = None, None, None
        for batch in batches:
            for i in range(len(batch)):
                s = np.frombuffer(batch.column("sums")[i].as_buffer(), float).reshape(-1, kinds)
                c = np.frombuffer(batch.column("counts")[i].as_buffer(), float)
                if held is not None and batch.column("block")[i] == held.column("block")[0]:
                    sums, counts = sums + s, counts + c
                    continue
                if held is not None:
                    yield finished(held, sums, counts)
                held, sums, counts = batch.slice(i, 1), s, c
        if held is not None:
            yield finished(held, sums, counts)

    pairs = left.crossJoin(right)
    if strips == 1:
        return pairs.mapInArrow(meet, f"keep {keep}, silhouettes array<double>")
    parts = pairs.mapInArrow(meet, f"block bigint, keep array<{keep}>, codes binary, sums binary, counts binary")
    return parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge, f"keep {keep}, silhouettes array<double>")


def silhouette_rows(df: DataFrame, key: str, cluster: str, vector: str, block: int | None = None, strip: int | None = None) -> DataFrame:
    """(key, cluster, silhouette) of every row, Euclidean, exact; 0 in a cluster of one, without a cluster, or where there is no other."""
    names = sorted((r[0] for r in df.select(cluster).where(F.col(cluster).isNotNull()).distinct().collect()), key=str)
    code = df.sparkSession.createDataFrame(list(enumerate(names)), f"_code int, _own {df.schema[cluster].dataType.simpleString()}") if names else None
    rows = df.select(F.struct(F.col(key).alias("key"), F.col(cluster).alias("own")).alias("keep"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    rows = rows.join(F.broadcast(code), F.col("keep.own") == F.col("_own"), "left") if names else rows.withColumn("_code", F.lit(None).cast("int"))
    rows = rows.select("keep", F.lit(0).alias("grp"), F.array(F.coalesce("_code", F.lit(-1))).alias("codes"), "v")
    got = silhouettes(rows, [max(len(names), 1)], block, strip)
    return got.select(F.col("keep.key").alias(key), F.col("keep.own").alias(cluster), F.get("silhouettes", F.lit(0)).alias("silhouette"))


def silhouette(df: DataFrame, key: str, cluster: str, vector: str, block: int | None = None) -> DataFrame:
    return silhouette_rows(df, key, cluster, vector, block).agg(F.avg("silhouette").alias("silhouette"))


def standardised(df: DataFrame, vector: str, *keep: str) -> DataFrame:
    """Vectors with each component's mean taken off and divided by its population deviation (1 where that is 0)."""
    stats = long(df, vector).groupBy("dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    packed = stats.agg(F.sort_array(F.collect_list(F.struct("dim", "m", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("s")))).alias("_p"))
    return df.crossJoin(F.broadcast(packed)).select(*keep, F.zip_with(vector, "_p", lambda x, p: (x.cast("double") - p["m"]) / p["s"]).alias(vector))


def ranked(df: DataFrame, by: str, *order: Column, top: int | None = None) -> DataFrame:
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return out.where(F.col("rank") <= top) if top else out
