"""Figures far from 0, many columns, fitted scaling, distributed clustering, and what the plans refuse."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from taxolens.functions import estimators
from taxolens.operators import cluster, divisive, engineer, geometry, lloyd, select
from taxolens.operators import trees as tree_module
from taxolens.plans.models import FeatureEngineer, FeatureSelector, NotFitted, Scaler
from taxolens.sources import readers


def vectors(spark, x, **more):
    return spark.createDataFrame(pd.DataFrame({"id": range(len(x)), "v": x.tolist()} | more))


def blobs(n=160, k=4, d=3, seed=1):
    rng = np.random.default_rng(seed)
    label = np.arange(n) % k
    return rng.normal(size=(k, d))[label] * 6 + rng.normal(size=(n, d)), label


@pytest.mark.parametrize("offset", [1e6, 1e9])
def test_sums_of_squares_far_from_zero(spark, offset):
    rng = np.random.default_rng(4)
    g = np.arange(3000) % 5
    x = rng.normal(size=3000) * 50 + g * 20
    near, far = (spark.createDataFrame(pd.DataFrame({"feature": "a", "g": g, "value": x + o})) for o in (0.0, offset))
    for f in (select.anova, select.separation):
        a, b = f(near, "g").first()[1], f(far, "g").first()[1]
        assert a > 0 and b == pytest.approx(a, rel=1e-5)
    means = np.array([x[g == j].mean() for j in range(5)])
    within = sum(((x[g == j] - means[j]) ** 2).sum() for j in range(5))
    assert select.anova(far, "g").first().f == pytest.approx(600 * ((means - x.mean()) ** 2).sum() / 4 / (within / 2995), rel=1e-5)
    v, c = blobs()
    a, b = (geometry.calinski_harabasz(vectors(spark, v + o, c=c), "c", "v").first()[0] for o in (0.0, offset))
    assert b == pytest.approx(a, rel=1e-4) and a == pytest.approx(estimators.partition_measures(v, c)[1])
    rows = vectors(spark, v + offset, c=c)
    assert geometry.silhouette(rows, "id", "c", "v", 50).first()[0] == pytest.approx(estimators.silhouette_mean(v, c), rel=1e-4)


def test_correlations_of_many_columns(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 200)) + 1e5
    x[:, 1] = x[:, 0] * 3 - 7
    x[:, 2] = 4.0
    x[::3, 5] = np.nan
    x[:, 6] = np.nan
    x[:, 7] = np.where(np.arange(300) < 150, np.nan, 9.0)
    columns = [f"c{i}" for i in range(200)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=columns)).repartition(5)
    got = {(r.p1, r.p2): r.r for r in select.correlations(df, columns).collect()}
    want = pd.DataFrame(x).corr()
    for (i, j), r in got.items():
        if 7 in (i, j) or 2 in (i, j) or 6 in (i, j):
            assert r is None
        else:
            assert r == pytest.approx(want[j][i], abs=1e-9)
    assert len(got) == 200 * 199 / 2
    kept = {r.feature: r.kept for r in select.remove_correlated(df, columns).collect()}
    assert len(kept) == 200 and [c for c, k in kept.items() if not k] == ["c1"]


def test_stated_weights_have_to_be_there(spark):
    s = spark.createDataFrame([("x", 1.0)], "feature string, anova double")
    with pytest.raises(ValueError, match="variance"):
        select.ensemble(s, select.WEIGHTS)
    assert select.ensemble(s).first().ensemble_score == pytest.approx(0.125)


def test_spreads_of_the_power_transform_meet_from_all_tasks(spark):
    """Variances of batches and tasks put together are those of the whole column, also for exponents 0 and 2 and values far from 0."""
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"c0": rng.normal(50, 20, 3000), "c1": 1e6 + rng.random(3000), "c2": -rng.lognormal(size=3000)})
    df = spark.createDataFrame(pdf).repartition(5)
    lams = np.array([-1.5, 0.0, 0.7, 1.0, 2.0, 3.0])
    got = engineer._spreads(df, dict.fromkeys(range(3), lams))
    for i in range(3):
        assert np.allclose(got[i], [estimators.yeo_johnson_values(pdf[f"c{i}"].to_numpy(), lam).var() for lam in lams], rtol=1e-5)


def test_exponents_and_scalers(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"up": rng.lognormal(size=400), "down": -rng.lognormal(size=400), "both": rng.normal(size=400) ** 3, "flat": 2.0, "none": np.nan})
    pdf.loc[3, "up"] = np.nan
    df = spark.createDataFrame(pdf.assign(k=range(400)))
    fitted = engineer.fit_exponents(df, ["up", "down", "both", "flat", "none"])
    for c in ("up", "down", "both"):
        assert fitted[c] == pytest.approx(estimators.yeo_johnson_exponent(pdf[c].to_numpy()), abs=1e-4)
    assert fitted["flat"] == fitted["none"] == 1.0
    columns = ["up", "both", "flat", "none"]
    x = pdf["both"].to_numpy()
    y = estimators.yeo_johnson_values(x, fitted["both"])
    q = np.percentile(x, [25, 50, 75])
    power, robust, plain = (y - y.mean()) / y.std(), (x - q[1]) / (q[2] - q[0]), (x - x.mean()) / x.std()
    for method, want in (("power", power), ("robust", robust), ("standard", plain), ("ensemble", 0.5 * robust + 0.3 * power + 0.2 * plain)):
        out = Scaler(method).fit(df, columns).transform(df).orderBy("k").toPandas()
        assert np.allclose(out["both"], want, atol=1e-4) and np.allclose(out["flat"], 0) and out["none"].isna().all() and out["up"].isna().sum() == 1
        assert out.columns.tolist() == df.columns
    with pytest.raises(NotFitted):
        Scaler().transform(df)
    made = FeatureEngineer(("k",), scaling="power").fit_transform(df, ["up", "both"]).toPandas()
    assert all(abs(made[c].mean()) < 1e-6 and made[c].std(ddof=0) == pytest.approx(1) for c in made.columns if c != "k")


def test_forced_finds_the_best_of_all_starts(spark):
    x, label = blobs(400, 6, 4)
    df = vectors(spark, x).repartition(5)
    got = cluster.forced(df, "v", 6, 10).toPandas().sort_values("id")
    assert estimators.agreement(got["cluster"].to_numpy(), label)[1] > 0.95
    cost = sum(((x[got["cluster"] == c] - x[got["cluster"] == c].mean(0)) ** 2).sum() for c in range(6))
    assert cost == pytest.approx(estimators.kmeans(x, 6, 42, 10)[1], rel=1e-3)
    again = cluster.forced(df.repartition(3), "v", 6, 10).toPandas().sort_values("id")
    assert (again["cluster"].to_numpy() == got["cluster"].to_numpy()).all()
    assert cluster.forced(df.limit(0), "v", 6).count() == 0
    assert cluster.forced(vectors(spark, np.ones((4, 2))), "v", 3, 2).select("cluster").distinct().count() == 1


def measures_of(x, label):
    kinds = np.unique(label)
    davies, calinski = estimators.partition_measures(x, label)
    return estimators.silhouette_mean(x, label), calinski, davies, sum(((x[label == c] - x[label == c].mean(0)) ** 2).sum() for c in kinds)


@pytest.mark.parametrize("block", [4096, 50])
def test_sweep_has_one_result_however_rows_are_tiled(spark, monkeypatch, block):
    """All measures are those of the labels that forced gives, whether a tile holds all rows or rounds need a scan each."""
    monkeypatch.setattr(lloyd, "BLOCK", block)
    x, _ = blobs(300, 4, 3)
    df = vectors(spark, x)
    got = {r.k: r for r in cluster.sweep(df, "id", "v", [2, 3, 4, 5], 8).collect()}
    for k in got:
        label = cluster.forced(df, "v", k, 8).toPandas().sort_values("id")["cluster"].to_numpy()
        for name, want in zip(("silhouette", "calinski", "davies_bouldin", "inertia"), measures_of(x, label)):
            assert got[k][name] == pytest.approx(want, rel=1e-6), (k, name)
    assert cluster.natural(df, "id", "v", 2, 6, 4).select("cluster").distinct().count() == cluster.natural_k(cluster.sweep(df, "id", "v", [2, 3, 4, 5, 6], 4), 2, 6).first().k


def test_tiles_of_any_size_give_equal_sweeps(spark, monkeypatch):
    x, _ = blobs(400, 5, 6)
    df = vectors(spark, x).repartition(3)
    results = []
    for block, most in ((4096, 64 << 20), (64, 64 << 20), (64, 4000)):
        monkeypatch.setattr(lloyd, "BLOCK", block)
        monkeypatch.setattr(lloyd, "CENTRE_BYTES", most)
        results.append(cluster.sweep(df, "id", "v", [3, 5, 8], 4).toPandas().sort_values("k").to_numpy())
    assert np.allclose(results[0], results[1], rtol=1e-9) and np.allclose(results[0], results[2], rtol=1e-9)


def test_the_driver_gets_one_set_of_sums_a_round(spark, monkeypatch):
    """What reaches it in a round is one row a live model, however many tiles there are."""
    monkeypatch.setattr(lloyd, "BLOCK", 16)
    x, _ = blobs(400, 5, 6)
    data = lloyd.table(vectors(spark, x).repartition(8), "v")
    got, plain = [], type(data.rows).toArrow
    monkeypatch.setattr(type(data.rows), "toArrow", lambda df: (got.append(plain(df)), got[-1])[1])
    models = [lloyd.Model(c) for c in lloyd.first_centres(x - data.middle, 5, 6, 1)]
    sums = lloyd._pass(data, models, 10)
    data.unpersist()
    assert data.tiles.rdd.getNumPartitions() > 1 and got[0].num_rows == len(models) == len(sums)
    assert all(s[:, 0].sum() == 400 and s[:, 1].sum() == pytest.approx(lloyd.nearest(x - data.middle, m.centres)[1].sum()) for m, (_, s) in zip(models, (sums[i] for i in range(6)), strict=True))


def test_ten_thousand_rows_take_one_scan(spark, monkeypatch):
    passes, plain = [], lloyd._pass
    monkeypatch.setattr(lloyd, "_pass", lambda *a: (passes.append(1), plain(*a))[1])
    x, y = blobs(10_000, 3, 2)
    got = cluster.forced(vectors(spark, x), "v", 3, 4).toPandas().sort_values("id")["cluster"].to_numpy()
    assert len(passes) == 1 and len(np.unique(got)) == 3


def test_forests_grow_in_sets_of_bounded_nodes(spark, monkeypatch):
    """Ten trees in sets of four, four and two with different seeds: shares that add to 1, the telling column first."""
    from pyspark.ml import classification

    asked, plain = [], classification.RandomForestClassifier.fit
    monkeypatch.setattr(classification.RandomForestClassifier, "fit", lambda f, df: (asked.append((f.getNumTrees(), f.getSeed())), plain(f, df))[1])
    monkeypatch.setattr(select, "NODES", 32, raising=False)
    x = np.random.default_rng(2).normal(size=(60, 3))
    df = spark.createDataFrame([(int(v[1] > 0), v.tolist()) for v in x], "y int, v array<double>")
    got = {r.pos: r.importance for r in select.forest_importance(df, "y", "v", 10, 2, 5).collect()}
    assert asked == [(4, 5), (4, 6), (2, 7)] and sum(got.values()) == pytest.approx(1) and max(got, key=got.get) == 1


def test_sweeps_of_odd_tables(spark):
    flat = vectors(spark, np.ones((6, 2)))
    assert [tuple(r) for r in cluster.sweep(flat, "id", "v", [2], 2).collect()] == [(2, -1.0, 0.0, float("inf"), float("inf"))]
    assert cluster.sweep(flat.limit(0), "id", "v", [2, 3], 2).count() == 2
    assert cluster.divisive(flat, "id", "v", 3, 1).toPandas()["cluster"].tolist() == [0] * 6
    assert cluster.divisive(flat.limit(0), "id", "v", 3, 1).count() == 0 and cluster.gap_statistic(flat.limit(0), "id", "v", [2]).count() == 0


@pytest.mark.parametrize(("exact", "accuracy"), [(10_000, 10_000), (40, 50)])
def test_quantiles_against_numpy(spark, monkeypatch, exact, accuracy):
    """By one exact aggregate, and by bounds that close in; with ties, half of all rows equal, and lost values."""
    monkeypatch.setattr(engineer, "EXACT", exact)
    monkeypatch.setattr(engineer, "ACCURACY", accuracy)
    monkeypatch.setattr(engineer, "TOGETHER", 2)
    rng = np.random.default_rng(3)
    n = 1500
    columns = {"even": rng.normal(size=n), "ties": rng.integers(0, 9, n).astype(float), "half": np.where(np.arange(n) % 2 == 0, 5.0, rng.normal(size=n) * 100), "flat": np.full(n, 2.5), "holes": np.where(rng.random(n) < 0.3, np.nan, rng.exponential(size=n))}
    df = spark.createDataFrame([(i, *(float(v[i]) for v in columns.values())) for i in range(n)], "id int, " + ", ".join(f"`{c}` double" for c in columns)).withColumn("none", F.lit(None).cast("double")).repartition(3)
    at = [0.0, 0.05, 0.5, 1.0]
    got = engineer.quantiles(df, [*columns, "none"], at)
    for c, v in columns.items():
        assert got[c] == pytest.approx(np.quantile(v[~np.isnan(v)], at).tolist()), c
    assert got["none"] == [None] * len(at)


@pytest.mark.parametrize("block", [4096, 64])
def test_greedy_picks_against_every_candidate(spark, monkeypatch, block):
    """Each step's pick is the column whose clusters, worked out by plain k-means, have the largest silhouette."""
    monkeypatch.setattr(lloyd, "BLOCK", block)
    x, _ = blobs(240, 3, 2)
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.normal(size=240), x[:, 0], rng.normal(size=240) * 3, x[:, 1], np.ones(240)])
    got = cluster.greedy_silhouette(vectors(spark, x), "id", "v", 3, 3, 4).collect()
    assert [r.ord for r in got] == [1, 2, 3]
    chosen = []
    for r in got:
        tried = {p: estimators.silhouette_mean(x[:, [*chosen, p]], estimators.kmeans(x[:, [*chosen, p]], 3, 1, 30)[0]) for p in range(4) if p not in chosen}
        assert r.pos == max(tried, key=tried.get) and r.silhouette == pytest.approx(tried[r.pos], abs=0.02)
        chosen.append(r.pos)


def test_silhouettes_by_columns_of_each_labelling(spark):
    rng = np.random.default_rng(6)
    x, codes = rng.normal(size=(150, 4)), rng.integers(0, 3, (150, 2))
    rows = spark.createDataFrame([(int(i), 0, [int(c) for c in codes[i]], x[i].tolist()) for i in range(150)], "i int, grp int, codes array<int>, v array<double>")
    got = geometry.silhouettes(rows.select(F.struct("i").alias("keep"), "grp", "codes", "v"), [3, 3], 64, 70, ([0, 2], [1, 3])).toPandas()
    both = np.array(got["silhouettes"].tolist())
    assert both[:, 0].mean() == pytest.approx(estimators.silhouette_mean(x[:, [0, 2, 1]], codes[:, 0])) and both[:, 1].mean() == pytest.approx(estimators.silhouette_mean(x[:, [0, 2, 3]], codes[:, 1]))


def divided(x, k, min_size):
    """The plain rule: every leaf judged again in every round by exhaustive starts, the best one split."""
    leaves = [np.arange(len(x))]

    def judge(rows):
        if len(rows) < 2 * min_size:
            return -1.0, None
        label, _ = estimators.kmeans(x[rows], 2, 1, 25, 300)
        if len(np.unique(label)) < 2:
            return -1.0, None
        return x[rows].var(0).mean() * (1 + estimators.silhouette_mean(x[rows], label)) * np.log(len(rows) + 1), label

    while len(leaves) < k:
        judged = [judge(rows) for rows in leaves]
        at = max(range(len(leaves)), key=lambda i: (judged[i][0], -i))
        if judged[at][0] <= 0:
            break
        rows = leaves.pop(at)
        leaves += [rows[judged[at][1] == 0], rows[judged[at][1] == 1]]
    out = np.zeros(len(x), int)
    for i, rows in enumerate(leaves):
        out[rows] = i
    return out


@pytest.mark.parametrize("leaf", [4096, 60, 0])
def test_divisive_against_the_plain_rule(spark, monkeypatch, leaf):
    """Whether a task takes a whole leaf or scans judge all leaves of a level."""
    monkeypatch.setattr(divisive, "LEAF", leaf)
    x, _ = blobs(360, 7, 3)
    got = cluster.divisive(vectors(spark, x).repartition(4), "id", "v", 7, 10).toPandas().sort_values("id")["cluster"].to_numpy()
    assert len(got) == 360 and estimators.agreement(got, divided(x, 7, 10))[1] == pytest.approx(1)


def test_queue_takes_nodes_by_their_least_score():
    scores = {"": 9.0, "0": 2.0, "1": 8.0, "10": 7.0, "11": 1.0, "00": 5.0, "01": -1.0}
    assert divisive._queue(3, scores) == (["0", "10", "11"], True)
    assert divisive._queue(4, scores) == (["0", "11", "100", "101"], True)
    assert divisive._queue(5, scores)[1] is False  # the score of 100 isn't known
    assert divisive._wanted(3, scores) == [] and divisive._wanted(4, scores) == ["100", "101"]


def test_gap_against_a_closed_form(spark):
    """One cluster: the log of the sum of squares around the mean, against those of the seeded boxes."""
    x, _ = blobs(80, 2, 3)
    got = cluster.gap_statistic(vectors(spark, x), "id", "v", [1, 2, 3], 4).toPandas().set_index("k")
    boxes = cluster._boxes(spark, 80, x.min(0), x.max(0), 4, 42).toPandas()
    assert boxes.groupby("grp").size().tolist() == [80] * 4
    logs = [np.log(((b - b.mean(0)) ** 2).sum()) for b in (np.array(g["v"].tolist()) for _, g in boxes.groupby("grp"))]
    assert got.loc[1, "gap"] == pytest.approx(np.mean(logs) - np.log(((x - x.mean(0)) ** 2).sum()), rel=1e-9)
    assert got.loc[1, "s"] == pytest.approx(np.std(logs) * np.sqrt(1.25), rel=1e-6) and got.loc[2, "gap"] > got.loc[1, "gap"]


def test_tree_of_rows(spark):
    x, label = blobs(60)
    got = cluster.tree(vectors(spark, x, y=label), "id", "v").toPandas().sort_values("step")
    assert len(got) == 59 and (np.diff(got.distance) >= -1e-12).all() and got["size"].iloc[-1] == 60 and got.gone.is_unique


def plain_trees(x, y, trees, depth, seed):
    """Trees grown node by node, with the same draws."""
    shape = tree_module.Shape(x.shape[1], int(y.max()) + 1, seed)
    gini = lambda c: 1 - ((c / c.sum()) ** 2).sum() if c.sum() else 0.0
    out = np.zeros(x.shape[1])
    for t in range(trees):
        own = np.zeros(x.shape[1])
        stack = [(1, np.arange(len(x)), 0)]
        while stack:
            node, rows, level = stack.pop()
            counts = np.bincount(y[rows], minlength=shape.classes)
            if level == depth or len(rows) < 2 or counts.max() == len(rows):
                continue
            best, tried = None, 0
            for c in shape.candidates(t, np.array([node]))[0]:
                v = x[rows, c]
                if v.min() == v.max() or tried == shape.tried:
                    continue
                tried += 1
                cut = v.min() + tree_module._uniform(seed, t, np.array(node), np.array(c), 1) * (v.max() - v.min())
                left = v <= cut
                if left.all() or not left.any():
                    continue
                one = np.bincount(y[rows[left]], minlength=shape.classes)
                gain = gini(counts) - (left.sum() * gini(one) + (~left).sum() * gini(counts - one)) / len(rows)
                if best is None or gain > best[0] + 1e-12:
                    best = gain, c, left
            if best:
                own[best[1]] += best[0] * len(rows) / len(x)
                stack += [(2 * node, rows[best[2]], level + 1), (2 * node + 1, rows[~best[2]], level + 1)]
        out += own / own.sum() if own.sum() else 0
    return out / trees


@pytest.mark.parametrize(("block", "most"), [(4096, 64 << 20), (40, 64 << 20), (40, 5000)])
def test_extra_trees_against_plain_growth(spark, monkeypatch, block, most):
    monkeypatch.setattr(lloyd, "BLOCK", block)
    monkeypatch.setattr(tree_module, "SUM_BYTES", most)
    rng = np.random.default_rng(4)
    y = np.arange(150) % 3
    x = np.column_stack([y + rng.normal(0, 0.4, 150), rng.normal(size=150), np.zeros(150), np.round(rng.normal(size=150)), y * rng.normal(size=150)])
    got = select.tree_importance(vectors(spark, x, y=y), "y", "v", 6, 4).toPandas().sort_values("pos")["importance"].to_numpy()
    assert got == pytest.approx(plain_trees(x, y, 6, 4, 42)) and got.sum() == pytest.approx(1) and got[2] == 0 and got.argmax() == 0


def test_extra_trees_of_odd_tables(spark):
    x = np.arange(6.0).reshape(3, 2)
    assert select.tree_importance(vectors(spark, x, y=np.zeros(3, int)), "y", "v", 3, 3).toPandas()["importance"].tolist() == [0.0, 0.0]
    assert select.tree_importance(vectors(spark, x, y=np.zeros(3, int)).limit(0), "y", "v").count() == 0


@pytest.mark.parametrize("rows", [10**6, 17])
def test_neighbour_information_against_the_kernel(spark, monkeypatch, rows):
    """Whether a task holds a column or a few rows of it, across classes smaller than k and runs over many tasks."""
    from taxolens.operators import ordered

    monkeypatch.setattr(ordered, "LEAST", rows)
    monkeypatch.setattr(ordered, "ROWS", rows)
    rng = np.random.default_rng(9)
    n = 120
    label = np.where(np.arange(n) < 3, np.arange(n), 10 + np.arange(n) % 2)  # three classes of one row
    label[3:5] = 7  # and one of two
    columns = {"a": label + rng.normal(0, 0.3, n), "b": rng.normal(size=n), "c": np.full(n, 2.0), "d": rng.normal(size=n) * 1e6}
    long = spark.createDataFrame([(i, int(label[i]), f, float(v[i])) for f, v in columns.items() for i in range(n)], "id int, y int, feature string, value double")
    got = {r.feature: r.mi for r in select.knn_mi(long, "y", "id").collect()}
    for f in ("a", "b", "d"):
        assert got[f] == pytest.approx(estimators.knn_mutual_information(columns[f], label.astype(str)), abs=1e-9)
    assert got["a"] > 0.3 and got["c"] >= 0 and select.knn_mi(long.limit(0), "y", "id").count() == 0


def test_silhouette_blocks_of_any_size(spark):
    x, label = blobs(90, 4)
    label = np.where(np.arange(90) == 7, 9, label)  # a cluster of one
    rows = vectors(spark, x, c=label).repartition(4)
    want = {r.id: r.silhouette for r in geometry.silhouette_rows(rows, "id", "c", "v").collect()}
    for block, strip in ((64, None), (64, 40)):
        got = {r.id: r.silhouette for r in geometry.silhouette_rows(rows, "id", "c", "v", block, strip).collect()}
        assert len(got) == 90 and got[7] == 0 and all(got[i] == pytest.approx(want[i]) for i in got)
    assert np.mean(list(got.values())) == pytest.approx(estimators.silhouette_mean(x, label))


def test_second_form_of_the_selector(spark):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(i, f"g{i % 3}", float(i % 3 + rng.normal(0, 0.1)), float(rng.normal()), float(rng.normal())) for i in range(90)], "k int, genre string, good double, noise double, more double")
    s = FeatureSelector("k", "genre", 10, alternate=True).fit(df)
    assert s.selected[-1] == "good" and len(s.ranking) == 3


def test_class_tree_families(spark):
    pairs = [("a", "b", 0.9), ("a", "c", 0.2), ("b", "c", 0.3)]
    rows = [(x, y, s) for x, y, s in pairs] + [(y, x, s) for x, y, s in pairs] + [(x, x, 1.0) for x in "abc"]
    tree = cluster.class_tree(spark.createDataFrame(rows, "genre1 string, genre2 string, similarity double"), {"a": "one", "b": "one", "c": "two"}).orderBy("step").collect()
    assert [(r.left, r.right, r.family) for r in tree] == [(0, 1, "one"), (2, 3, "mixed")]


def test_grid_has_all_configurations(spark):
    from taxolens.plans.analysis import feature_count_grid

    rng = np.random.default_rng(8)
    x = rng.normal(size=(80, 50))
    got = feature_count_grid(vectors(spark, x, y=np.arange(80) % 4), "id", "y", "v", list(range(35)), list(range(49, -1, -1)), ks=(3, 5)).toPandas()
    one = got[(got["total"] == 20) & (got["extra"] == 5) & (got["k"] == 3)].iloc[0]
    own = x[:, [*range(15), *range(49, 44, -1)]]
    label, _ = estimators.kmeans(own, 3, 1, 40)
    davies, calinski = estimators.partition_measures(own, label)
    for name, want in (("silhouette", estimators.silhouette_mean(own, label)), ("davies_bouldin", davies), ("calinski", calinski)):
        assert one[name] == pytest.approx(want, rel=0.25), name
    assert len(got) == 28 and got["composite"].between(0, 5 + 1e-9).all() and (got["n_greedy"] + got["extra"] == got["total"]).all()


def test_sources_count_and_cache(spark, tmp_path):
    df = spark.createDataFrame([('{"bpm": 1}',), ("{broken",), (None,)], "j string")
    assert tuple(readers.unread(df, "j").first()) == (1, 1)
    path = str(tmp_path / "c")
    assert readers.cached(spark, path, lambda: spark.range(3), {"n": 3}).count() == 3
    assert readers.cached(spark, path, lambda: spark.range(5), {"n": 5}).count() == 5
    assert readers.cached(spark, path, lambda: spark.range(9), {"n": 3}).count() == 3
    files = spark.createDataFrame([(f"f{i}", bytes([i])) for i in range(7)], "path string, content binary").coalesce(1)
    sizes = []

    def model(contents):
        if b"\x03" in contents:
            raise OSError("broken")
        return [[float(c[0])] * 2 for c in contents]

    got = {r.path: r for r in readers.embed(files, model, 2, 3).collect()}
    assert got["f3"].failed and list(got["f3"].embedding) == [0.0, 0.0] and list(got["f4"].embedding) == [4.0, 4.0] and sum(r.failed for r in got.values()) == 1
    assert not sizes


def test_folders_without_a_preview(spark, tmp_path):
    for p in ("House-Top100-19_03_2025/1 - One/preview.mp3", "House-Top100-19_03_2025/2 - Two/in/preview.mp3", "House-Top100-19_03_2025/3 - Three/other.mp3", "Techno-Top100-19_03_2025/4 - Four/in/cover.jpg"):
        (tmp_path / p).parent.mkdir(parents=True)
        (tmp_path / p).write_bytes(b"x")
    assert [tuple(r) for r in readers.missing_previews(spark, str(tmp_path)).collect()] == [("House", "Three.mp3"), ("Techno", "Four.mp3")]


def test_signals_for_models_and_features_with_metadata(spark, tmp_path):
    from taxolens.operators import audio

    t = np.arange(4000) / 4000
    tone = np.sin(2 * np.pi * 50 * t)
    df = spark.createDataFrame([(1, tone.tolist()), (2, None), (3, [])], "id int, y array<double>")
    got = {r.id: np.array(r.y) for r in audio.prepared(df, "id", "y", 4000.0, 1000.0, 0.5).collect()}
    assert len(got[1]) == 500 and len(got[2]) == len(got[3]) == 0
    assert np.abs(got[1][20:-20] - np.sin(2 * np.pi * 50 * np.arange(500) / 1000)[20:-20]).max() < 0.02
    both = (tone + np.sin(2 * np.pi * 1500 * t)).tolist()
    low = np.array(audio.prepared(spark.createDataFrame([(1, both)], "id int, y array<double>"), "id", "y", 4000.0, 1000.0, 1.0).first().y)
    assert np.abs(low[20:-20] - np.sin(2 * np.pi * 50 * np.arange(1000) / 1000)[20:-20]).max() < 0.02
    meta = spark.createDataFrame([(1, 120.0), (9, 1.0)], "id int, bpm double")
    out = audio.with_metadata(audio.extract(df, "id", "y", 4000.0), "id", ["1-ZCRm", "rms_mean"], meta, str(tmp_path / "out")).collect()
    assert {r.id: r.bpm for r in out}[1] == 120.0 and set(out[0].asDict()) == {"id", "1-ZCRm", "rms_mean", "bpm"}


def test_streaming_moments(spark, tmp_path):
    from taxolens.streaming.live import windowed_moments

    rows = spark.createDataFrame([("2024-01-01 00:10:00", "x", 1.0), ("2024-01-01 00:20:00", "x", -3.0), ("2024-01-01 01:10:00", "y", 5.0)], "ts string, kind string, value double").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = windowed_moments(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "ts", "kind", "value")
    q = stream.writeStream.format("memory").queryName("moments").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.kind, r.n, r.mean, r["std"], r.peak) for r in spark.table("moments").collect()) == [("x", 2, -1.0, 2.0, 3.0), ("y", 1, 5.0, 0.0, 5.0)]


def test_distance_sums_in_pieces(monkeypatch):
    from taxolens.functions import estimators

    monkeypatch.setattr(estimators, "PIECE_BYTES", 1 << 12)
    x = np.random.default_rng(4).normal(size=(150, 5))
    member = np.eye(2)[np.arange(150) % 2]
    want = np.sqrt(((x[:, None] - x) ** 2).sum(2)) @ member
    assert np.allclose(estimators.distance_sums(x, x, member, True), want, rtol=0, atol=1e-9)


def plain_rounds(x, centres, rounds, spread):
    """Lloyd's rounds with all distances: centres, and the cost before their last move."""
    for _ in range(rounds):
        label, d = lloyd.nearest(x, centres)
        now = np.array([x[label == j].mean(0) if (label == j).any() else c for j, c in enumerate(centres)])
        moved, centres = ((now - centres) ** 2).sum(), now
        if not moved > lloyd.REST * spread:
            break
    return centres, d.sum()


@pytest.mark.parametrize("scale", [1.0, 1e-30, 1e25])
def test_rounds_by_bounds_are_those_of_all_distances(scale):
    """Noise, repeated rows, ties on a grid, equal centres, far clusters, one centre, some columns, rounds that run out."""
    rng = np.random.default_rng(7)
    noise = rng.normal(size=(5000, 12))
    grid = rng.integers(0, 4, (3000, 3)).astype(float)
    far = rng.normal(size=(2500, 5)) * 1e-4 + rng.integers(0, 3, (2500, 1)) * 1e3
    for x, k, rounds in ((noise, 17, 300), (noise, 1, 5), (noise, 9, 3), (np.repeat(noise[:40], 60, 0), 30, 100), (grid, 8, 100), (far, 6, 100)):
        x = (x - x.mean(0)) * scale
        for columns in (None, np.array([2, 0])):
            own = x if columns is None else x[:, columns]
            first = own[rng.integers(0, len(x), k)]
            m, spread = lloyd.Model(first.copy(), 0, columns), float(own.var(0).mean())
            lloyd.settle(x, [m], rounds, [spread])
            centres, cost = plain_rounds(own, first, rounds, spread)
            if x.shape[1] == 3:  # rounding breaks the grid's ties
                after = lloyd.nearest(own, m.centres)[1].sum()
                assert after <= m.cost * (1 + 1e-9) < 1.2 * max(after, cost)
                continue
            assert np.allclose(m.centres, centres, rtol=1e-9, atol=1e-9 * scale) and m.cost == pytest.approx(cost, rel=1e-6, abs=1e-6 * scale**2 * len(x))


def test_twenty_thousand_rows_take_one_scan_in_bounded_tiles(spark, monkeypatch):
    passes, plain = [], lloyd._pass
    monkeypatch.setattr(lloyd, "_pass", lambda *a: (passes.append(1), plain(*a))[1])
    x, _ = blobs(20_000, 3, 2)
    df = vectors(spark, x)
    got = cluster.forced(df, "v", 3, 4).toPandas().sort_values("id")["cluster"].to_numpy()
    assert len(passes) == 1
    monkeypatch.setattr(lloyd, "TILE_BYTES", 64 << 10)
    data = lloyd.table(df, "v")
    assert max(len(r.points) for r in data.tiles.select("points").collect()) <= 64 << 10 and data.blocks >= 5
    data.unpersist()
    assert (cluster.forced(df, "v", 3, 4).toPandas().sort_values("id")["cluster"].to_numpy() == got).all() and len(passes) > 2


def test_distance_sums_of_added_columns_take_bounded_pieces(monkeypatch):
    """Sums by cluster of every labelling against plain distances; no array of all pairs of rows is made."""
    import tracemalloc

    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 6))
    codes = rng.integers(0, 4, (900, 2))
    member = np.hstack([np.eye(4)[codes[:, 0]], np.eye(4)[codes[:, 1]]])
    for piece in (1 << 20, 4096):
        monkeypatch.setattr(estimators, "PIECE_BYTES", piece)
        tracemalloc.start()
        got = estimators.added_distance_sums(x[:, [1, 3]], x[:, [1, 3]], x[:, [0, 5]], x[:, [0, 5]], member, [4, 4], True)
        assert tracemalloc.get_traced_memory()[1] < 900 * 900 * 8
        tracemalloc.stop()
        for i, c in enumerate((0, 5)):
            own = x[:, [1, 3, c]]
            assert np.allclose(got[:, 4 * i : 4 * i + 4], np.sqrt(((own[:, None] - own[None]) ** 2).sum(2)) @ member[:, 4 * i : 4 * i + 4])


def test_a_split_of_many_rows_takes_one_scan_for_its_rounds(spark, monkeypatch):
    passes, plain = [], lloyd._pass
    monkeypatch.setattr(lloyd, "_pass", lambda *a: (passes.append(1), plain(*a))[1])
    x, y = blobs(18_000, 2, 2)
    got = cluster.divisive(vectors(spark, x), "id", "v", 2).toPandas().sort_values("id")["cluster"].to_numpy()
    assert len(passes) == 1 and len(np.unique(got)) == 2
