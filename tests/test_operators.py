"""Operators on small hand-made frames: definitions, edge cases, invariants."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from taxolens.functions import estimators
from taxolens.operators import audio, cluster, contingency, curves, engineer, frames, geometry, profile, select
from taxolens.sources import readers, sinks

LABELS = "g string, c int"


def one(df):
    return df.first().asDict()


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame([("a", 0)] * 3 + [("a", 1)] + [("b", 1)] * 2 + [("b", 3)] * 2, LABELS)


def test_contingency_has_empty_cells(cells):
    got = {(r.g, r.c): r.n for r in contingency.contingency(cells, "g", "c").collect()}
    assert got == {("a", 0): 3, ("a", 1): 1, ("a", 3): 0, ("b", 0): 0, ("b", 1): 2, ("b", 3): 2}


def test_fragmentation(cells):
    got = {r.g: r for r in contingency.fragmentation(cells, "g", "c").collect()}
    assert got["b"].entropy == pytest.approx(1.0) and got["b"].n_clusters == 2 and got["b"].dominant_cluster_pct == 50
    assert got["a"].entropy == pytest.approx(-(0.75 * math.log2(0.75) + 0.25 * math.log2(0.25)))
    assert all(r.entropy <= math.log2(r.n_clusters) + 1e-12 for r in got.values())


def test_purity_and_sizes(cells):
    assert one(contingency.purity(cells, "g", "c"))["purity"] == pytest.approx(7 / 8)
    got = one(contingency.size_stats(cells, "c"))  # id 2 is absent and counts as 0
    assert (got["min_size"], got["max_size"], got["mean_size"]) == (0, 3, 2.0)
    by = {r.c: (r.dominant, r.band) for r in contingency.purity_by(cells, "g", "c").collect()}
    assert by[0] == ("a", "very pure") and by[1] == ("b", "pure")


def test_agreement_bounds(spark, cells):
    same = one(contingency.agreement(cells.select("g", F.col("g").alias("h")), "g", "h"))
    assert same["nmi"] == pytest.approx(1) and same["ari"] == pytest.approx(1)
    swap = one(contingency.agreement(cells.withColumn("c", F.lit(9) - F.col("c")), "g", "c"))
    plain = one(contingency.agreement(cells, "g", "c"))
    back = one(contingency.agreement(cells, "c", "g"))
    for k in ("mi", "nmi", "ari"):
        assert swap[k] == pytest.approx(plain[k]) == pytest.approx(back[k])
    alone = one(contingency.agreement(spark.createDataFrame([("a", 1)], LABELS), "g", "c"))
    assert alone["nmi"] == 1.0


def test_overlap_and_rate(cells):
    assert one(contingency.jaccard_pairs(cells, "g", "c"))["overlap"] == pytest.approx(1 / 3)
    assert one(contingency.co_cluster(cells, "g", "c"))["rate"] == pytest.approx(2 / 16)


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    rows = [(i, f"g{i % 3}", i % 3 if i < 29 else 7, [float(v) for v in rng.normal(3 * (i % 3), 1, 5)]) for i in range(30)]
    return spark.createDataFrame(rows, "id int, g string, c int, v array<double>")


def dense(points):
    p = points.orderBy("id").toPandas()
    return np.array(p.v.tolist()), p.c.to_numpy(), p.g.to_numpy()


def test_convergence(points):
    x, _, g = dense(points)
    got = {(r.genre1, r.genre2): r.similarity for r in geometry.convergence(points, "g", "v").collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = (u[g == "g0"] @ u[g == "g0"].T)[np.triu_indices(10, 1)].mean()
    assert got["g0", "g0"] == pytest.approx(s)
    a, b = x[g == "g1"].mean(0), x[g == "g2"].mean(0)
    assert got["g1", "g2"] == got["g2", "g1"] == pytest.approx(min(1, max(0, a @ b / np.linalg.norm(a) / np.linalg.norm(b))))


def test_convergence_degenerate(spark):
    rows = [("a", [0.0, 0.0]), ("b", [0.0, 0.0]), ("c", [1.0, 2.0])]
    got = {(r.genre1, r.genre2): r.similarity for r in geometry.convergence(spark.createDataFrame(rows, "g string, v array<double>"), "g", "v").collect()}
    assert got["c", "c"] == 1.0 and got["a", "b"] == 0.0


def test_phantoms(points):
    got = geometry.phantoms(points, "g", "v", "c", -1.0, 1.1).collect()
    assert got and all(r.phantom_score == pytest.approx(r.acoustic_similarity * (1 - r.clustering_overlap)) for r in got)


@pytest.mark.parametrize("block", [4096, 7])
def test_silhouette(points, block):
    x, c, _ = dense(points)
    got = one(geometry.silhouette(points, "id", "c", "v", block))["silhouette"]
    assert got == pytest.approx(estimators.silhouette_mean(x, c)) and -1 <= got <= 1


def test_internal_measures(points):
    x, c, _ = dense(points)
    mean = {k: x[c == k].mean(0) for k in set(c)}
    within = sum(((x[i] - mean[c[i]]) ** 2).sum() for i in range(30))
    between = sum((c == k).sum() * ((mean[k] - x.mean(0)) ** 2).sum() for k in mean)
    assert one(geometry.inertia(points, "c", "v"))["inertia"] == pytest.approx(within)
    assert one(geometry.calinski_harabasz(points, "c", "v"))["calinski_harabasz"] == pytest.approx((between / 3) / (within / 26))
    assert geometry.davies_bouldin(points, "c", "v").first()[0] > 0
    assert one(geometry.calinski_harabasz(points.withColumn("c", F.lit(1)), "c", "v"))["calinski_harabasz"] is None


def test_correlated_drop_is_not_greedy(spark):
    rng = np.random.default_rng(3)
    a, e, f = rng.normal(size=400), rng.normal(size=400), rng.normal(size=400)
    b = a + 0.3 * e
    c = b + 0.3 * f  # near b, less near a
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "c": c, "k": 1.0}))
    r = {(x.f1, x.f2): x.r for x in select.correlations(df, ["a", "b", "c"]).collect()}
    t = (max(r["a", "c"], 0) + min(r["a", "b"], r["b", "c"])) / 2
    assert r["a", "c"] < t < min(r["a", "b"], r["b", "c"])
    kept = {x.feature: x.kept for x in select.remove_correlated(df, ["a", "b", "c"], t).collect()}
    assert kept == {"a": True, "b": False, "c": False}
    assert all(x.kept for x in select.remove_correlated(df, ["a", "k"], t).collect())


def test_ensemble_weights_and_flat_scores(spark):
    s = spark.createDataFrame([("x", 1.0, 5.0), ("y", 3.0, 5.0), ("z", 2.0, 5.0)], "feature string, anova double, variance double")
    got = {r.feature: (r.ensemble_score, r.rank) for r in select.ensemble(s).collect()}
    assert got["y"] == (pytest.approx(0.25 + 0.05), 1) and got["x"] == (pytest.approx(0.05), 3)


def test_engineering_gates(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, 0.0, -1.0, 2.0, nan, 1.0, None), (2, 3.0, 2.0, 5.0, inf, 1.0, None)], "k int, zero double, neg double, pos double, bad double, flat double, none double")
    cols = [c for c in df.columns if c != "k"]
    assert set(engineer.log_columns(df, cols)) == {"pos_log", "flat_log"}
    assert set(engineer.log_columns(df, cols, strict=False)) == {"zero_log", "pos_log", "flat_log"}
    out = engineer.engineer(df, cols, ("neg",), keep=("k",))
    assert {"flat", "none", "bad", "flat_log"}.isdisjoint(out.columns) and {"neg_squared", "neg_sqrt", "pos_log"} <= set(out.columns)
    assert out.where("neg_sqrt = 1.0").count() == 1


def test_imputation(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, float("nan")), (4, 4.0)], "k int, x double")
    assert [r.x for r in engineer.impute_mean(df, ["x"]).orderBy("k").collect()] == [2.0, 3.0, 3.0, 4.0]


def test_scalers_on_constants(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0)], "k int, x double")
    want = {engineer.scale_standard: 0, engineer.scale_robust: 0, engineer.scale_minmax: 0.5, engineer.scale_percent: 50, engineer.scale_sample: 0}
    for f, v in want.items():
        assert [r.scaled for r in f(df, "x").collect()] == [v, v], f.__name__


def test_power_fit_recovers_exponent():
    x = np.exp(np.random.default_rng(0).normal(size=4000)) - 1
    y = estimators.yeo_johnson_values(x, estimators.yeo_johnson_exponent(x))
    skew = lambda a: ((a - a.mean()) ** 3).mean() / a.std() ** 3
    assert abs(skew(y)) < 0.2 < abs(skew(x))


@pytest.mark.parametrize(("ys", "k"), [([10, 5, 2, 1.5, 1.2], 3), ([1, 1, 1, 1], 2), ([3, 1], 1), ([5, float("inf"), 1, 0], 2)])
def test_elbow(spark, ys, k):
    df = spark.createDataFrame([(i + 1, float(y)) for i, y in enumerate(ys)], "k int, y double")
    assert curves.elbow(df).first().k == k


def test_vote_and_gap(spark):
    v = spark.createDataFrame([(20,), (20,), (17,), (17,), (99,), (None,)], "k int")
    assert curves.vote(v, 15, 30).first().k == 17
    assert curves.vote(v.where("k = 99"), 15, 30).first().k == 15
    g = spark.createDataFrame([(1, 0.1, 0.01), (2, 0.5, 0.01), (3, 0.505, 0.01)], "k int, gap double, s double")
    assert curves.gap_choice(g).first().k == 2
    assert curves.gap_choice(g.withColumn("gap", F.col("k") * 1.0)).first().k == 3


def test_profiles(points):
    got = profile.profiles(points, "id", "g", "v", {"low": [0, 1], "none": []}).collect()
    assert {r.dim for r in got} == {"low", "none"} and all(0 <= r.score <= 100 for r in got) and all(r.score == 50 for r in got if r.dim == "none")


def test_frames(spark):
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate([1.0, -1.0, 1.0, -1.0, 0.0])] + [("b", i, 0.0) for i in range(5)], "k string, t int, v double")
    s = frames.ordered(df, "k", ["t"], "v")
    zcr = {r.k: r.zcr for r in frames.zero_crossings(s, "k").collect()}
    assert zcr == {"a": pytest.approx((2 + 2 + 2 + 1) / 10), "b": 0.0}
    assert {r.k: r.crest_factor for r in frames.crest(s, "k").collect()}["b"] == 0.0
    m = {r.k: r for r in frames.moments(s, "k").collect()}
    assert m["b"].skew == 0.0 and m["b"].kurtosis == 0.0
    assert {(r.k, r.frame) for r in frames.energy(frames.frame(s, "k", 2), "k", "frame").collect()} == {(k, f) for k in "ab" for f in (0, 1)}
    assert {r.k: r.variance for r in frames.window_variance(s, "k", 4).collect()} == {"a": 0.0, "b": 0.0}


def test_audio_extraction_tolerates_bad_tracks(spark):
    rows = [(1, [math.sin(i / 5) for i in range(4000)]), (2, None), (3, []), (4, [0.0] * 3)]
    got = {r.id: r for r in audio.extract(spark.createDataFrame(rows, "id int, y array<double>"), "id", "y", 8000.0).collect()}
    assert len(got[1].features) == 194 and got[1].error is None
    assert len(got) == 4 and all((r.features is None) != (r.error is None) for r in got.values())


def test_trees_match_a_plain_version():
    x = np.random.default_rng(5).normal(size=(12, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    z = estimators.linkage(d, "average")
    parts = [[i] for i in range(12)]
    for _, _, h, _ in z:
        i, j, best = min(((i, j, d[np.ix_(parts[i], parts[j])].mean()) for i in range(len(parts)) for j in range(i)), key=lambda t: t[2])
        assert h == pytest.approx(best)
        parts = [p for k, p in enumerate(parts) if k not in (i, j)] + [parts[i] + parts[j]]
    w = estimators.linkage(d, "ward")
    assert (np.diff(w[:, 2]) >= -1e-9).all() and -1 <= estimators.cophenetic(w, d) <= 1


def test_divisive_and_kmeans_are_repeatable(points):
    a, b = (sorted(map(tuple, cluster.divisive(points, "id", "v", 3, 4).collect())) for _ in range(2))
    assert a == b and {c for _, c in a} == {0, 1, 2}
    assert cluster.forced(points.drop("c"), "v", 3, 1, 20).select("cluster").distinct().count() == 3


def test_neighbour_information_orders_features():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 600)
    assert estimators.knn_mutual_information(y * 4 + rng.normal(size=600), y) > 0.4 > 0.1 > estimators.knn_mutual_information(rng.normal(size=600), y)


def test_metadata(spark):
    df = spark.createDataFrame([("a", 1, '{"bpm": 120, "length_ms": 5}'), ("a", 2, '{"bpm": 121, "duration_ms": 7}'), ("b", 1, "{broken"), ("c", 1, "{}")], "k string, t int, j string")
    got = {r.k: (r.bpm, r.length_ms) for r in readers.metadata(df, ["k"], "j", "t").collect()}
    assert got == {"a": (121.0, 7.0), "c": (None, None)}
    joined = readers.attach_metadata(spark.createDataFrame([("a",), ("z",), ("a",)], "k string"), readers.metadata(df, ["k"], "j", "t"), ["k"])
    assert joined.count() == 3 and joined.where("bpm is null").count() == 1


def test_walk_audio(spark, tmp_path):
    for p in ("House-Top100-19_03_2025/1 - One/preview.mp3", "House-Top100-19_03_2025/2 - Two - Mix/in/preview.mp3", "Techno-Top100-19_03_2025/3 - Three/other.mp3"):
        (tmp_path / p).parent.mkdir(parents=True)
        (tmp_path / p).write_bytes(b"x")
    got = [(r.genre, r.song) for r in readers.walk_audio(spark, str(tmp_path)).collect()]
    assert got == [("House", "One.mp3"), ("House", "Two - Mix.mp3")]


def test_csv_names_and_sinks(spark, tmp_path):
    (tmp_path / "f.csv").write_text("genre,78-beats_loudness.mean,meta.Bpm\nx,1.5,120\ny,2.5,\n")
    df, names = readers.read_csv(spark, str(tmp_path / "f.csv"))
    assert names["78_beats_loudness_mean"] == "78-beats_loudness.mean" and df.agg(F.sum("78_beats_loudness_mean")).first()[0] == 4.0
    wide = sinks.square(spark.createDataFrame([("a", "a", 1.0), ("a", "b", 0.5), ("b", "a", 0.5), ("b", "b", 1.0)], "r string, c string, v double"), "r", "c", "v")
    assert wide.columns == ["r", "a", "b"] and wide.first().b == 0.5
    with pytest.raises(FileNotFoundError):
        readers.read_matrix(spark, str(tmp_path / "none"))
    built = [readers.cached(spark, str(tmp_path / "c"), lambda: spark.range(3)).count() for _ in range(2)]
    assert built == [3, 3]


def test_streaming_counts(spark, tmp_path):
    from taxolens.streaming.live import windowed_counts

    rows = spark.createDataFrame([("2024-01-01 00:10:00", "x"), ("2024-01-01 00:20:00", "x"), ("2024-01-01 01:10:00", "y")], "ts string, kind string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "ts", "kind")
    q = stream.writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.kind, r.n) for r in spark.table("live").collect()) == [("x", 2), ("y", 1)]


def test_whole_analysis(spark, tmp_path):
    from taxolens.plans.analysis import run_analysis

    rng = np.random.default_rng(2)
    n = 120
    data = pd.DataFrame({"track_id": range(n), "genre": [f"g{i % 4}" for i in range(n)]} | {f"f{j}_bpm": rng.normal(i % 4 if (i := j) else 0, 1, n) + np.arange(n) % 4 * (j % 3) for j in range(8)})
    got = run_analysis(spark.createDataFrame(data), "track_id", "genre", str(tmp_path), 5, 6, 2, 6)
    assert got["selected_features"] == 5 and 2 <= got["natural_k"] <= 6 and 0 <= got["nmi_natural_label"] <= 1
    assert spark.read.parquet(str(tmp_path / "tables/clusters")).count() == n


def test_names_cover_all_features(spark):
    from collections import Counter

    from taxolens.functions import names, signal

    every = list(signal.extract(np.zeros(3000)))
    assert len(set(every)) == 194
    got = Counter(names.dimension(n) for n in [*every, "meta.Bpm"])
    assert got == {"energy": 16, "danceability": 4, "tempo": 19, "harmonic": 28, "rhythmic": 69, "texture": 59}
    assert sum(map(len, names.FAMILIES.values())) == 32


def test_engineering_adds_tempogram_summaries(spark):
    row = {"fourier_peak1_bpm": 140.0, "fourier_peak1_mean": 3.0, "fourier_peak2_bpm": 90.0, "fourier_peak2_mean": 1.5, "cyclic_auto_entropy": 2.0}
    df = spark.createDataFrame([{"k": 1, **row}, {"k": 2, **{n: v / 2 for n, v in row.items()}}])
    out = engineer.engineer(df, sorted(row), keep=("k",)).where("k = 1").first()
    assert out.tempogram_fast_slow_ratio == pytest.approx(3 / (1.5 + 1e-6)) and out.fourier_peak_concentration == pytest.approx(3 / (4.5 + 1e-6))
    assert out.tempo_features_max == 140.0 and out.tempo_features_std == pytest.approx(np.std(list(row.values()), ddof=1))


def test_fitted_steps(spark):
    from taxolens.plans.models import FeatureEngineer, FeatureSelector, NotFitted

    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(i, f"g{i % 3}", float(i % 3 + rng.normal(0, 0.1)), float(rng.normal()), float(rng.normal())) for i in range(90)], "k int, genre string, good double, noise double, more double")
    with pytest.raises(NotFitted):
        FeatureSelector("k", "genre").transform(df)
    s = FeatureSelector("k", "genre", 2).fit(df)
    assert s.selected[-1] == "good" and s.transform(df.drop("genre")).columns == ["k", *s.selected] and s.info()["n_selected"] == 2
    e = FeatureEngineer(("k", "genre"))
    e.fit_transform(df)
    assert e.info()["n_original"] == 3 and e.info()["n_total"] == len(e.made)
