"""Whole analyses: from a feature table to clusters, comparisons and a report; the benchmark; the grid."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxolens.functions.estimators import table_agreement
from taxolens.functions.numeric import eps_range
from taxolens.operators import cluster, contingency, engineer, geometry, lloyd, select
from taxolens.plans.models import FeatureEngineer
from taxolens.sources import sinks


def evaluate(df: DataFrame, key: str, label: str, cluster_col: str, vector: str, trees: bool = False) -> DataFrame:
    """One row of internal and external measures; the internal ones are null for one cluster.

    trees: with the cophenetic correlation of the rows' Ward tree, whose time is quadratic in rows.
    """
    out = geometry.silhouette(df, key, cluster_col, vector)
    parts = [
        geometry.calinski_harabasz(df, cluster_col, vector),
        geometry.davies_bouldin(df, cluster_col, vector),
        geometry.inertia(df, cluster_col, vector),
        contingency.purity(df, label, cluster_col),
        contingency.balance(df, cluster_col),
        contingency.agreement(df, label, cluster_col),
    ]
    for one in [*parts, cluster.cophenetic(df, key, vector)] if trees else parts:
        out = out.crossJoin(one)
    return out


def benchmark(df: DataFrame, key: str, label: str, vector: str, ks: list[int], forced_k: int = 35, starts: int = cluster.STARTS) -> DataFrame:
    """(clustering, k, measures..., verdict): forced and natural clusters of standardised vectors."""
    z = geometry.standardised(df, vector, key, label)
    natural = cluster.natural_k(cluster.sweep(z, key, vector, ks, starts), min(ks), max(ks)).first().k
    out = None
    for name, k in (("forced", forced_k), ("natural", natural)):
        one = evaluate(cluster.forced(z, vector, k, starts), key, label, "cluster", vector)
        one = one.select(F.lit(name).alias("clustering"), F.lit(k).alias("k"), "*", F.lit("overspecified" if natural < 30 else "consistent").alias("verdict"))
        out = one if out is None else out.unionByName(one)
    return out


#: Totals, extra features, bounds of the greedy part and numbers of clusters of the grid.
GRID_TOTALS, GRID_EXTRAS, GRID_GREEDY, GRID_KS = (20, 25, 30, 35, 40, 45), (0, 5, 10), (15, 35), (20, 35)


def feature_count_grid(
    df: DataFrame, key: str, label: str, vector: str, greedy: list[int], ranked: list[int],
    totals: tuple[int, ...] = GRID_TOTALS, extras: tuple[int, ...] = GRID_EXTRAS, greedy_range: tuple[int, int] = GRID_GREEDY, ks: tuple[int, ...] = GRID_KS, seed: int = 42,
) -> DataFrame:
    """(total, n_greedy, extra, k, silhouette, davies_bouldin, calinski, nmi, ari, composite): every feature count.

    A configuration takes the first n_greedy of one list and the best `extra` of the other that it lacks. The starts of
    all configurations advance in the same scans, and sums by cluster come from two; configurations of equal columns share a pass over the distances.
    composite: the sum of the five measures, each to its unit range, Davies-Bouldin turned round. No bound on rows.
    """
    spark = df.sparkSession
    configs = []
    for total in totals:
        for extra in extras:
            n = total - extra
            if greedy_range[0] <= n <= greedy_range[1]:
                first = greedy[:n]
                configs += [(total, n, extra, k, [*first, *[p for p in ranked if p not in first][:extra]]) for k in ks]
    data = lloyd.table(df.select(F.col(label).cast("string").alias("y"), F.col(vector).alias("v")), "v", ("y",))
    sample = lloyd.matrix_of(data.rows.orderBy(F.xxhash64("v"), "v").limit(cluster.GAP_INIT).select("v").toArrow()["v"].combine_chunks()) - data.middle
    models = [[lloyd.Model(c, 0, np.array(p), spread=float(data.variances[0][p].mean())) for c in lloyd.first_centres(sample[:, p], k, 10, seed)] for _, _, _, k, p in configs]
    lloyd.advance(data, [m for each in models for m in each], 100)
    best = [min(each, key=lambda m: m.cost) for each in models]
    sizes, columns = [len(m.centres) for m in best], [c[-1] for c in configs]
    rows = lloyd.labels(data, best, "y").persist()
    n, sums = cluster.moments(rows, sizes, data.middle)
    centres = [s / np.maximum(c, 1)[:, None] for s, c in zip(sums, n, strict=True)]
    _, away = cluster.moments(rows, sizes, data.middle, centres, columns)
    names = {r.y: i for i, r in enumerate(rows.select("y").distinct().orderBy("y").collect())}
    counts = [np.zeros((size, len(names))) for size in sizes]
    for r in rows.select("y", F.posexplode("codes").alias("pos", "code")).groupBy("pos", "code", "y").agg(F.count("*").alias("n")).collect():
        counts[r.pos][r.code, names[r.y]] = r.n
    near: dict[int, float] = {}
    for own in {tuple(c): None for c in columns}:
        at = [i for i, c in enumerate(columns) if tuple(c) == own]
        some = rows.select(F.struct(F.lit(0).alias("row")).alias("keep"), "grp", F.array(*[F.col("codes")[i] for i in at]).alias("codes"), F.array(*[F.col("v")[c] for c in own]).alias("v"))
        got = geometry.silhouettes(some, [sizes[i] for i in at], n=data.spread[0][0]).select(F.posexplode("silhouettes").alias("pos", "s")).groupBy("pos").agg(F.avg("s").alias("s")).collect()
        near |= {at[r.pos]: float(r.s) for r in got}
    out = []
    for i, (total, first, extra, k, own) in enumerate(configs):
        measured = cluster.spread_measures(n[i], centres[i][:, own], away[i])
        calinski, davies, _ = measured or (0.0, math.inf, 0.0)
        out.append((total, first, extra, k, near[i] if measured else -1.0, davies, calinski, *table_agreement(counts[i])))
    rows.unpersist()
    data.unpersist()
    got = spark.createDataFrame(out, "total int, n_greedy int, extra int, k int, silhouette double, davies_bouldin double, calinski double, nmi double, ari double")
    w = Window.partitionBy()
    unit = lambda c, turned=False: eps_range(F.col(c), F.min(c).over(w), F.max(c).over(w), turned)
    return got.withColumn("composite", unit("silhouette") + unit("calinski") + unit("nmi") + unit("ari") + unit("davies_bouldin", True))


def run_analysis(features: DataFrame, key: str, label: str, out: str, n_features: int = 20, forced_k: int = 35, low: int = 15, high: int = 30) -> dict:
    """The main batch: engineer, drop correlated, score, keep the best, cluster three ways, compare, write tables and a report.

    features: key, label and numeric columns. Returns the figures of the report.
    """
    spark = features.sparkSession
    paths = sinks.paths(out)
    columns = [c for c in engineer.numeric_columns(features) if c not in (key, label)]
    wide = FeatureEngineer((key, label), scaling="power").fit_transform(features, columns).persist()
    made = [c for c in wide.columns if c not in (key, label)]
    kept = [r.feature for r in select.remove_correlated(wide, made).where("kept").collect()]
    vectors = wide.select(key, F.array(*[F.col(f"`{c}`").cast("double") for c in kept]).alias("v"))
    first = cluster.forced(geometry.standardised(vectors, "v", key), "v", forced_k, 10).select(key, "cluster")
    ranking = select.ensemble(select.six_scores(wide, key, label, kept, first), select.WEIGHTS).persist()
    sinks.write_table(ranking, paths["feature_scores"])
    chosen = [r.feature for r in select.selected(ranking, n_features).collect()]
    rows = wide.select(key, label, F.array(*[F.col(f"`{c}`").cast("double") for c in chosen]).alias("v"))
    sinks.write_table(geometry.standardised(rows, "v", key, label), paths["feature_matrix"])
    matrix = spark.read.parquet(paths["feature_matrix"])
    curve = cluster.sweep(matrix, key, "v", list(range(low, high + 1)))
    sinks.write_table(curve, paths["sweep"])
    natural = cluster.natural_k(spark.read.parquet(paths["sweep"]), low, high).first().k
    labelled = cluster.forced(matrix, "v", forced_k, out="forced").select(key, label, "v", "forced")
    labelled = labelled.join(cluster.forced(matrix, "v", natural, out="natural").select(key, "natural"), key)
    labelled = labelled.join(cluster.divisive(matrix, key, "v", forced_k).withColumnRenamed("cluster", "divisive"), key)
    sinks.write_table(labelled, paths["clusters"])
    done = spark.read.parquet(paths["clusters"])
    sinks.write_table(geometry.convergence(done, label, "v"), paths["convergence_matrix"])
    sinks.write_table(geometry.converging_pairs(done, label, "v", 50), paths["converging_pairs"])
    sinks.write_table(geometry.phantoms(done, label, "v", "forced"), paths["phantom_pairs"])
    sinks.write_table(contingency.fragmentation(done, label, "forced"), paths["fragmentation"])
    agree = {n: contingency.agreement(done, a, b).first() for n, a, b in (("natural_label", "natural", label), ("forced_label", "forced", label), ("natural_forced", "natural", "forced"))}
    metrics = {"rows": done.count(), "original_features": len(columns), "engineered_features": len(made), "scored_features": len(kept), "selected_features": len(chosen), "natural_k": natural, "excess_categories": forced_k - natural}
    metrics |= {f"nmi_{n}": float(r.nmi) for n, r in agree.items()} | {f"ari_{n}": float(r.ari) for n, r in agree.items()}
    sinks.report(spark, metrics, paths["report"])
    for df in (wide, ranking):
        df.unpersist()
    return metrics
