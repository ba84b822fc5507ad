"""The query catalogue over the provided tables, and an independent SQL for each where SQL can say it.

Keys name operators.  Numbers are rounded to six places on both sides, as the order
of sums differs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taxolens.functions import names
from taxolens.functions import numeric as N
from taxolens.operators import audio, cluster, contingency, curves, engineer, frames, geometry, profile, select
from taxolens.sources import readers, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[(F.round(F.col(f"`{c}`"), places) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])


def query(key: str, sql: str | None = None, doubles: str = ""):
    """Registers a query; doubles names the columns of its SQL that are rounded."""

    def add(f: Query) -> Query:
        QUERIES[key] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            columns = doubles.split()
            swap = ", ".join(f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in columns)
            ORACLES[key] = f"SELECT * {f'REPLACE ({swap})' if columns else ''} FROM ({sql})"
        return f

    return add


# ---------------------------------------------------------------- vectors with classes and clusters


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track_id, genre, v, cluster (largest of the first 8 components), cluster64 (of all), half (of the first 4)."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    df = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("track_id"), F.col("label").alias("genre"), v.alias("v"))
    return df.select("*", N.argmax(F.slice("v", 1, 8)).alias("cluster"), N.argmax(F.col("v")).alias("cluster64"), N.argmax(F.slice("v", 1, 4)).alias("half"))


E = """WITH e0 AS (SELECT vec_id AS track_id, label AS genre, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
e AS (SELECT *, CAST(list_position(v[1:8], list_max(v[1:8])) - 1 AS INTEGER) AS cluster, CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS cluster64, CAST(list_position(v[1:4], list_max(v[1:4])) - 1 AS INTEGER) AS half FROM e0),
c AS (SELECT genre, cluster, count(*) AS n FROM e GROUP BY ALL)"""


@query("contingency", f"{E} SELECT g.genre, k.cluster, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM (SELECT DISTINCT genre FROM c) g CROSS JOIN (SELECT DISTINCT cluster FROM c) k LEFT JOIN c ON c.genre = g.genre AND c.cluster = k.cluster")
def _(s, d):
    return contingency.contingency(embeddings(s, d), "genre", "cluster")


@query("contingency_documents", "SELECT l.lang, s.source, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT DISTINCT lang FROM documents) l CROSS JOIN (SELECT DISTINCT source FROM documents) s LEFT JOIN (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) c ON c.lang = l.lang AND c.source = s.source")
def _(s, d):
    return contingency.contingency(read(s, d, "documents"), "lang", "source")


@query("contingency_row_pct", f"{E} SELECT genre, cluster, 100.0 * n / sum(n) OVER (PARTITION BY genre) AS pct FROM c", "pct")
def _(s, d):
    return contingency.row_share(embeddings(s, d), "genre", "cluster", 100.0)


@query("fragmentation", f"{E}, p AS (SELECT genre, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY genre) AS p FROM c) SELECT genre, -sum(p * log2(p)) AS entropy, CAST(count(*) AS BIGINT) AS n_clusters, 100 * max(p) AS dominant_cluster_pct FROM p GROUP BY genre", "entropy dominant_cluster_pct")
def _(s, d):
    return contingency.fragmentation(embeddings(s, d), "genre", "cluster")


@query("purity_global", f"{E} SELECT sum(top) / sum(size) AS purity FROM (SELECT cluster, max(n) AS top, sum(n) AS size FROM c GROUP BY cluster)", "purity")
def _(s, d):
    return contingency.purity(embeddings(s, d), "genre", "cluster")


BAND = "CASE WHEN purity >= 70 THEN 'very pure' WHEN purity >= 50 THEN 'pure' WHEN purity >= 35 THEN 'mixed' WHEN purity >= 20 THEN 'very mixed' ELSE 'scattered' END AS band"
PURE = "q AS (SELECT cluster, genre, n, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, genre) AS k, sum(n) OVER (PARTITION BY cluster) AS size FROM c), pur AS (SELECT cluster, genre AS dominant, 100.0 * n / size AS purity, CAST(size AS BIGINT) AS size FROM q WHERE k = 1)"
CONC = "con AS (SELECT genre, 100.0 * max(n) / sum(n) AS concentration FROM c GROUP BY genre)"


@query("purity_by_cluster", f"{E}, {PURE} SELECT *, {BAND} FROM pur", "purity")
def _(s, d):
    return contingency.purity_by(embeddings(s, d), "genre", "cluster")


@query("concentration", f"{E}, {CONC} SELECT * FROM con", "concentration")
def _(s, d):
    return contingency.concentration(embeddings(s, d), "genre", "cluster")


@query("purity_summary", f"{E}, {PURE}, {CONC} SELECT (SELECT avg(purity) FROM pur) AS avg_purity, (SELECT CAST(count(*) AS BIGINT) FROM pur WHERE purity >= 50) AS n_pure, (SELECT avg(concentration) FROM con) AS avg_concentration", "avg_purity avg_concentration")
def _(s, d):
    return contingency.purity_summary(embeddings(s, d), "genre", "cluster")


@query("cluster_size_stats", f"{E}, z AS (SELECT i, count(e.cluster) AS n FROM range(0, (SELECT max(cluster) + 1 FROM e)) t(i) LEFT JOIN e ON e.cluster = i GROUP BY i) SELECT avg(n) AS mean_size, stddev_pop(n) AS std_size, CAST(min(n) AS BIGINT) AS min_size, CAST(max(n) AS BIGINT) AS max_size FROM z", "mean_size std_size")
def _(s, d):
    return contingency.size_stats(embeddings(s, d), "cluster")


@query("cluster_balance", f"{E}, p AS (SELECT CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM e) AS p FROM e GROUP BY cluster) SELECT -sum(p * ln(p + 1e-10)) AS balance, -sum(p * ln(p + 1e-10)) / ln(count(*)) AS norm_balance, -sum(p * ln(p)) AS entropy, -sum(p * ln(p)) / ln(count(*)) AS norm_entropy FROM p", "balance norm_balance entropy norm_entropy")
def _(s, d):
    return contingency.balance(embeddings(s, d), "cluster")


def agree_sql(cells: str, name: str) -> str:
    """One row of agreement measures of cells (a, b, n), each by its own subquery."""
    return f"""SELECT '{name}' AS what, mi, CASE WHEN ha + hb < 1e-12 THEN 1 ELSE 2 * mi / (ha + hb) END AS nmi, CASE WHEN abs((pa + pb) / 2 - pa * pb / pt) < 1e-12 THEN 1 ELSE (s - pa * pb / pt) / ((pa + pb) / 2 - pa * pb / pt) END AS ari FROM (
 WITH x AS ({cells}), t AS (SELECT CAST(sum(n) AS DOUBLE) AS t FROM x), ra AS (SELECT a, CAST(sum(n) AS DOUBLE) AS n FROM x GROUP BY a), rb AS (SELECT b, CAST(sum(n) AS DOUBLE) AS n FROM x GROUP BY b)
 SELECT (SELECT greatest(0, sum(x.n / t * ln(t * x.n / (ra.n * rb.n)))) FROM x JOIN ra USING (a) JOIN rb USING (b), t) AS mi, (SELECT -sum(n / t * ln(n / t)) FROM ra, t) AS ha, (SELECT -sum(n / t * ln(n / t)) FROM rb, t) AS hb,
 (SELECT sum(n * (n - 1) / 2.0) FROM x) AS s, (SELECT sum(n * (n - 1) / 2) FROM ra) AS pa, (SELECT sum(n * (n - 1) / 2) FROM rb) AS pb, (SELECT t * (t - 1) / 2 FROM t) AS pt)"""


def _agree(parts: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, one in parts.items():
        one = one.select(F.lit(name).alias("what"), "mi", "nmi", "ari")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "agreement",
    " UNION ALL ".join([agree_sql(f"{E} SELECT genre AS a, cluster AS b, n FROM c", "embeddings"), agree_sql("SELECT lang AS a, source AS b, count(*) AS n FROM documents GROUP BY ALL", "documents"), agree_sql("SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY ALL", "labels")]),
    "mi nmi ari",
)
def _(s, d):
    return _agree({"embeddings": contingency.agreement(embeddings(s, d), "genre", "cluster"), "documents": contingency.agreement(read(s, d, "documents"), "lang", "source"), "labels": contingency.agreement(read(s, d, "labels"), "quality", "toxic")})


for _key, _measure in (("mutual_info", "mi"), ("nmi", "nmi"), ("ari", "ari")):
    query(_key, f"SELECT {_measure} FROM ({agree_sql(f'{E} SELECT genre AS a, cluster AS b, n FROM c', 'x')})", _measure)(lambda s, d, m=_measure: contingency.agreement(embeddings(s, d), "genre", "cluster").select(m))


@query(
    "natural_vs_forced",
    f"SELECT what, nmi, ari, CAST(35 - (SELECT count(DISTINCT half) FROM ({E} SELECT half FROM e)) AS BIGINT) AS k_difference FROM ("
    + " UNION ALL ".join(agree_sql(f"{E} SELECT {a} AS a, {b} AS b, count(*) AS n FROM e GROUP BY ALL", n) for a, b, n in (("half", "genre", "natural_genre"), ("cluster", "genre", "forced_genre"), ("half", "cluster", "natural_forced")))
    + ")",
    "nmi ari",
)
def _(s, d):
    e = embeddings(s, d)
    out = _agree({n: contingency.agreement(e, a, b) for a, b, n in (("half", "genre", "natural_genre"), ("cluster", "genre", "forced_genre"), ("half", "cluster", "natural_forced"))})
    return out.crossJoin(e.agg((F.lit(35) - F.countDistinct("half")).alias("k_difference"))).drop("mi")


@query("class_jaccard", f"{E}, s AS (SELECT genre, list(DISTINCT cluster64) AS k FROM e GROUP BY genre) SELECT x.genre AS a1, y.genre AS a2, CAST(len(list_intersect(x.k, y.k)) AS DOUBLE) / len(list_distinct(list_concat(x.k, y.k))) AS overlap FROM s x JOIN s y ON x.genre < y.genre", "overlap")
def _(s, d):
    return contingency.jaccard_pairs(embeddings(s, d), "genre", "cluster64")


@query("cluster_sets", f"{E} SELECT genre, array_to_string(list_sort(list(DISTINCT cluster64)), ',') AS clusters FROM e GROUP BY genre")
def _(s, d):
    return contingency.cluster_sets(embeddings(s, d), "genre", "cluster64").select("genre", F.array_join(F.col("clusters").cast("array<string>"), ",").alias("clusters"))


@query("co_cluster_rate", f"{E}, s AS (SELECT genre, sum(n) AS n FROM c GROUP BY genre) SELECT x.genre AS a1, y.genre AS a2, coalesce((SELECT sum(p.n * q.n) FROM c p JOIN c q ON p.cluster = q.cluster WHERE p.genre = x.genre AND q.genre = y.genre), 0) / CAST(x.n * y.n AS DOUBLE) AS rate FROM s x JOIN s y ON x.genre < y.genre", "rate")
def _(s, d):
    return contingency.co_cluster(embeddings(s, d), "genre", "cluster")


@query("value_counts", f"{E}, q AS (SELECT cluster, genre, n, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, genre) AS k, sum(n) OVER (PARTITION BY cluster) AS size FROM c) SELECT cluster, genre, n, CAST(n AS DOUBLE) / size AS share, CAST(size AS BIGINT) AS size FROM q WHERE k = 1", "share")
def _(s, d):
    return contingency.value_counts(embeddings(s, d), "cluster", "genre")


@query("matrix_order", f"{E}, {PURE}, {CONC}, r AS (SELECT genre, row_number() OVER (ORDER BY concentration DESC, genre) AS row FROM con), l AS (SELECT cluster, row_number() OVER (ORDER BY purity DESC, cluster) AS col FROM pur) SELECT r.genre, l.cluster, CAST(coalesce(c.n, 0) AS BIGINT) AS n, CAST(r.row AS INTEGER) AS row, CAST(l.col AS INTEGER) AS col FROM r CROSS JOIN l LEFT JOIN c ON c.genre = r.genre AND c.cluster = l.cluster")
def _(s, d):
    return contingency.matrix_order(embeddings(s, d), "genre", "cluster")


@query("exclude_class", f"{E} SELECT CAST(count(*) FILTER (genre != 3) AS BIGINT) AS n_kept, CAST(count(*) FILTER (genre = 3) AS BIGINT) AS n_excluded FROM e")
def _(s, d):
    return embeddings(s, d).agg(F.count_if(F.col("genre") != 3).alias("n_kept"), F.count_if(F.col("genre") == 3).alias("n_excluded"))


# ---------------------------------------------------------------- convergence

CENTRE = f"""{E}, l AS (SELECT track_id, genre, cluster, unnest(range(1, 65)) AS dim, unnest(v) AS x FROM e),
m AS (SELECT genre, list(x ORDER BY dim) AS w FROM (SELECT genre, dim, avg(x) AS x FROM l GROUP BY genre, dim) GROUP BY genre),
inn AS (SELECT a.genre, coalesce(avg(list_cosine_similarity(a.v, b.v)), 1) AS sim FROM e a LEFT JOIN e b ON a.genre = b.genre AND a.track_id < b.track_id WHERE b.track_id IS NOT NULL GROUP BY a.genre),
conv AS (SELECT x.genre AS genre1, y.genre AS genre2, CASE WHEN x.genre = y.genre THEN inn.sim ELSE greatest(0, least(1, list_cosine_similarity(x.w, y.w))) END AS similarity FROM m x CROSS JOIN m y JOIN inn ON inn.genre = x.genre)"""


@query("centroids", f"{CENTRE} SELECT genre, dim, x FROM (SELECT genre, CAST(unnest(range(0, 64)) AS INTEGER) AS dim, unnest(w) AS x FROM m)", "x")
def _(s, d):
    return geometry.centroids(embeddings(s, d), "genre", "v").select("genre", F.posexplode("centroid").alias("dim", "x"))


@query("convergence_matrix", f"{CENTRE} SELECT * FROM conv", "similarity")
def convergence_matrix(s, d):
    return geometry.convergence(embeddings(s, d), "genre", "v")


@query("convergence_pairs", f"{CENTRE} SELECT genre1, genre2, similarity FROM conv WHERE genre1 < genre2 ORDER BY similarity DESC, genre1, genre2 LIMIT 50", "similarity")
def _(s, d):
    return geometry.converging_pairs(embeddings(s, d), "genre", "v", 50)


@query("convergence_square", f"{CENTRE} SELECT genre1, max(similarity) FILTER (genre2 = 0) AS g0, max(similarity) FILTER (genre2 = 3) AS g3 FROM conv GROUP BY genre1", "g0 g3")
def _(s, d):
    wide = sinks.square(geometry.convergence(embeddings(s, d), "genre", "v"), "genre1", "genre2", "similarity")
    return wide.select("genre1", F.col("0").alias("g0"), F.col("3").alias("g3"))


@query("convergence_stats", f"{CENTRE} SELECT min(similarity) AS min_sim, max(similarity) AS max_sim, avg(similarity) AS mean_sim, stddev_pop(similarity) AS std_sim FROM conv WHERE genre1 != genre2", "min_sim max_sim mean_sim std_sim")
def _(s, d):
    return geometry.convergence_stats(embeddings(s, d), "genre", "v")


@query(
    "phantom_distinctions",
    f"{CENTRE}, s AS (SELECT genre, list(DISTINCT cluster64) AS k FROM e GROUP BY genre), o AS (SELECT x.genre AS genre1, y.genre AS genre2, CAST(len(list_intersect(x.k, y.k)) AS DOUBLE) / len(list_distinct(list_concat(x.k, y.k))) AS overlap FROM s x JOIN s y ON x.genre < y.genre) SELECT genre1, genre2, similarity AS acoustic_similarity, overlap AS clustering_overlap, similarity * (1 - overlap) AS phantom_score FROM conv JOIN o USING (genre1, genre2) WHERE similarity > 0.05 AND overlap < 0.55",
    "acoustic_similarity clustering_overlap phantom_score",
)
def _(s, d):
    return geometry.phantoms(embeddings(s, d), "genre", "v", "cluster64", 0.05, 0.55)


# ---------------------------------------------------------------- internal measures

KM = f"{E}, l AS (SELECT cluster, unnest(range(1, 65)) AS dim, unnest(v) AS x FROM e), m AS (SELECT cluster, list(x ORDER BY dim) AS w FROM (SELECT cluster, dim, avg(x) AS x FROM l GROUP BY cluster, dim) GROUP BY cluster), g AS (SELECT list(x ORDER BY dim) AS w FROM (SELECT dim, avg(x) AS x FROM l GROUP BY dim)), o AS (SELECT e.cluster, list_distance(e.v, m.w) AS r FROM e JOIN m USING (cluster))"


@query("inertia", f"{KM} SELECT sum(r * r) AS inertia FROM o", "inertia")
def _(s, d):
    return geometry.inertia(embeddings(s, d), "cluster", "v")


@query("calinski_harabasz", f"{KM}, n AS (SELECT cluster, count(*) AS n FROM e GROUP BY cluster) SELECT (SELECT sum(n.n * list_distance(m.w, g.w) ** 2) FROM m JOIN n USING (cluster), g) / ((SELECT count(*) FROM n) - 1) / ((SELECT sum(r * r) FROM o) / ((SELECT count(*) FROM e) - (SELECT count(*) FROM n))) AS calinski_harabasz", "calinski_harabasz")
def _(s, d):
    return geometry.calinski_harabasz(embeddings(s, d), "cluster", "v")


@query("davies_bouldin", f"{KM}, s AS (SELECT cluster, avg(r) AS s FROM o GROUP BY cluster) SELECT avg(w) AS davies_bouldin FROM (SELECT x.cluster, max((sx.s + sy.s) / list_distance(x.w, y.w)) AS w FROM m x JOIN m y ON x.cluster != y.cluster JOIN s sx ON sx.cluster = x.cluster JOIN s sy ON sy.cluster = y.cluster GROUP BY x.cluster)", "davies_bouldin")
def _(s, d):
    return geometry.davies_bouldin(embeddings(s, d), "cluster", "v")


SIL = f"{E}, p AS (SELECT a.track_id, a.cluster, b.cluster AS other, sum(list_distance(a.v, b.v)) AS s, count(*) AS n FROM e a CROSS JOIN e b GROUP BY ALL), ab AS (SELECT track_id, cluster, max(CASE WHEN cluster = other AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN cluster != other THEN s / n END) AS b FROM p GROUP BY ALL), si AS (SELECT track_id, cluster, CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS silhouette FROM ab)"


@query("silhouette", f"{SIL} SELECT avg(silhouette) AS silhouette FROM si", "silhouette")
def _(s, d):
    return geometry.silhouette(embeddings(s, d), "track_id", "cluster", "v")


@query("silhouette_rows", f"{SIL} SELECT * FROM si", "silhouette")
def _(s, d):
    return geometry.silhouette_rows(embeddings(s, d), "track_id", "cluster", "v")


# ---------------------------------------------------------------- scaling

PART = "SELECT p_partkey AS key, CAST(p_size AS DOUBLE) AS x FROM part"
CUST = "SELECT c_custkey AS key, c_acctbal AS x FROM customer"
YJ = "CASE WHEN x >= 0 THEN (pow(x + 1, 0.7) - 1) / 0.7 ELSE -(pow(1 - x, 1.3) - 1) / 1.3 END"


def part(s, d):
    return read(s, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").cast("double").alias("x"))


def customer(s, d):
    return read(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("x"))


for _key, _f, _table, _sql in (
    ("scale_standard", engineer.scale_standard, "part", f"SELECT key, x, (x - m) / CASE WHEN s > 0 THEN s ELSE 1 END AS scaled FROM ({PART}), (SELECT avg(x) AS m, stddev_pop(x) AS s FROM ({PART}))"),
    ("scale_zscore_sample", engineer.scale_sample, "part", f"SELECT key, x, (x - m) / s AS scaled FROM ({PART}), (SELECT avg(x) AS m, stddev_samp(x) AS s FROM ({PART}))"),
    ("scale_robust", engineer.scale_robust, "customer", f"SELECT key, x, (x - q[2]) / (q[3] - q[1]) AS scaled FROM ({CUST}), (SELECT quantile_cont(x, [0.25, 0.5, 0.75]) AS q FROM ({CUST}))"),
    ("scale_minmax", engineer.scale_minmax, "customer", f"SELECT key, x, (x - l) / (h - l) AS scaled FROM ({CUST}), (SELECT min(x) AS l, max(x) AS h FROM ({CUST}))"),
    ("scale_p5_p95", engineer.scale_percent, "customer", f"SELECT key, x, greatest(0, least(100, 100 * (x - q[1]) / (q[2] - q[1]))) AS scaled FROM ({CUST}), (SELECT quantile_cont(x, [0.05, 0.95]) AS q FROM ({CUST}))"),
    ("scale_power", lambda f, c: engineer.scale_power(f, c, 0.7), "customer", f"SELECT key, x, (y - m) / s AS scaled FROM (SELECT key, x, {YJ} AS y FROM ({CUST})), (SELECT avg(y) AS m, stddev_pop(y) AS s FROM (SELECT {YJ} AS y FROM ({CUST})))"),
    ("scale_blend", lambda f, c: engineer.scale_blend(f, c, 0.7), "customer", f"SELECT key, x, 0.5 * (x - q[2]) / (q[3] - q[1]) + 0.3 * (y - ym) / ys + 0.2 * (x - xm) / xs AS scaled FROM (SELECT key, x, {YJ} AS y FROM ({CUST})), (SELECT avg(y) AS ym, stddev_pop(y) AS ys, avg(x) AS xm, stddev_pop(x) AS xs, quantile_cont(x, [0.25, 0.5, 0.75]) AS q FROM (SELECT x, {YJ} AS y FROM ({CUST})))"),
):
    query(_key, _sql, "x scaled")(lambda s, d, f=_f, t=_table: f({"part": part, "customer": customer}[t](s, d), "x"))


@query("yeo_johnson_apply", f"SELECT key, {YJ} AS y FROM ({CUST})", "y")
def _(s, d):
    return customer(s, d).select("key", N.yeo_johnson(F.col("x"), 0.7).alias("y"))


@query("scale_minmax_eps", "SELECT p_brand AS brand, (avg(p_retailprice) - min(avg(p_retailprice)) OVER ()) / (max(avg(p_retailprice)) OVER () - min(avg(p_retailprice)) OVER () + 1e-12) AS up, 1 - (avg(p_size) - min(avg(p_size)) OVER ()) / (max(avg(p_size)) OVER () - min(avg(p_size)) OVER () + 1e-12) AS down FROM part GROUP BY p_brand", "up down")
def _(s, d):
    g = read(s, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.avg("p_retailprice").alias("a"), F.avg("p_size").alias("b"))
    w = Window.partitionBy()
    return g.select("brand", N.eps_range(F.col("a"), F.min("a").over(w), F.max("a").over(w)).alias("up"), N.eps_range(F.col("b"), F.min("b").over(w), F.max("b").over(w), True).alias("down"))


# ---------------------------------------------------------------- feature engineering


def part_features(s, d):
    """part as a feature table: names that the engineering rules look for."""
    p = read(s, d, "part")
    return p.select("p_partkey", F.col("p_type").alias("genre"), F.col("p_size").cast("double").alias("69-BPM"), F.col("p_retailprice").alias("2-Energym"), (F.col("p_size") % 5).cast("double").alias("beat_strength"), F.lit(1.0).alias("constant"))


PF = 'SELECT p_partkey, p_type AS genre, CAST(p_size AS DOUBLE) AS bpm, p_retailprice AS energy, CAST(p_size % 5 AS DOUBLE) AS beat FROM part'


@query("engineer_log_gate", f"SELECT p_partkey, ln(1 + bpm) AS bpm_log, ln(1 + energy) AS energy_log FROM ({PF})", "bpm_log energy_log")
def _(s, d):
    f = part_features(s, d)
    made = engineer.log_columns(f, ["69-BPM", "2-Energym", "beat_strength"])
    return f.select("p_partkey", *[c.alias({"69-BPM_log": "bpm_log", "2-Energym_log": "energy_log"}.get(n, n)) for n, c in made.items()])


@query("engineer_poly", "SELECT c_custkey, c_acctbal * c_acctbal AS squared, sqrt(abs(c_acctbal)) AS root FROM customer", "squared root")
def _(s, d):
    made = engineer.power_columns(["c_acctbal"])
    return read(s, d, "customer").select("c_custkey", made["c_acctbal_squared"].alias("squared"), made["c_acctbal_sqrt"].alias("root"))


@query("engineer_product", f"SELECT p_partkey, bpm * energy AS bpm_energy, bpm * beat AS bpm_beat, beat * energy AS beat_energy FROM ({PF})", "bpm_energy bpm_beat beat_energy")
def _(s, d):
    f = part_features(s, d)
    made = engineer.product_columns(["69-BPM", "2-Energym", "beat_strength"])
    plain = {"69-BPM_x_2-Energym": "bpm_energy", "69-BPM_x_beat_strength": "bpm_beat", "beat_strength_x_2-Energym": "beat_energy"}
    return f.select("p_partkey", *[c.alias(plain[n]) for n, c in made.items()])


@query("engineer_ratio", f"SELECT p_partkey, energy / (beat + 1e-6) AS energy_beat FROM ({PF})", "energy_beat")
def _(s, d):
    f = part_features(s, d)
    return f.select("p_partkey", engineer.ratio_columns({"energy_beat": ("2-Energym", "beat_strength")}, f.columns)["energy_beat"].alias("energy_beat"))


@query("engineer_row_stats", f"{E} SELECT track_id, list_avg(v[1:10]) AS t_mean, list_stddev_samp(v[1:10]) AS t_std, list_max(v[1:10]) AS t_max FROM e", "t_mean t_std t_max")
def _(s, d):
    wide = embeddings(s, d).select("track_id", *[F.col("v")[i].alias(f"c{i}") for i in range(10)])
    return wide.select("track_id", *[c.alias(n) for n, c in engineer.row_stats([f"c{i}" for i in range(10)], "t").items()])


@query(
    "engineer_fast_slow",
    f"{E}, p AS (SELECT track_id, list_transform(v[1:5], lambda x: 60 + 400 * abs(x)) AS b, list_transform(v[6:10], lambda x: abs(x)) AS m FROM e), q AS (SELECT track_id, m[1] AS first, list_sum(m) AS total, list_sum(list_transform(range(1, 6), lambda i: CASE WHEN b[i] > 130 THEN m[i] ELSE 0 END)) AS fast, list_sum(list_transform(range(1, 6), lambda i: CASE WHEN b[i] <= 100 THEN m[i] ELSE 0 END)) AS slow FROM p) SELECT track_id, fast / (slow + 1e-6) AS ratio, first / (total + 1e-6) AS concentration FROM q",
    "ratio concentration",
)
def _(s, d):
    e = embeddings(s, d)
    wide = e.select("track_id", *[(60 + 400 * F.abs(F.col("v")[i])).alias(f"b{i}") for i in range(5)], *[F.abs(F.col("v")[5 + i]).alias(f"m{i}") for i in range(5)])
    made = engineer.fast_slow([f"b{i}" for i in range(5)], [f"m{i}" for i in range(5)])
    return wide.select("track_id", made["tempogram_fast_slow_ratio"].alias("ratio"), made["fourier_peak_concentration"].alias("concentration"))


@query("engineer_full", f"SELECT p_partkey, bpm, energy, beat, ln(1 + bpm) AS bpm_log, ln(1 + energy) AS energy_log, bpm * bpm AS bpm_squared, sqrt(bpm) AS bpm_sqrt, bpm * energy AS bpm_energy FROM ({PF})", "bpm energy beat bpm_log energy_log bpm_squared bpm_sqrt bpm_energy")
def _(s, d):
    out = engineer.engineer(part_features(s, d), ["69-BPM", "2-Energym", "beat_strength", "constant"], ("69-BPM",), keep=("p_partkey",))
    plain = {"69-BPM": "bpm", "2-Energym": "energy", "beat_strength": "beat", "69-BPM_log": "bpm_log", "2-Energym_log": "energy_log", "69-BPM_squared": "bpm_squared", "69-BPM_sqrt": "bpm_sqrt", "69-BPM_x_2-Energym": "bpm_energy"}
    return out.select("p_partkey", *[F.col(f"`{k}`").alias(v) for k, v in plain.items()])


@query("engineer_alternate", f"SELECT p_partkey, bpm, energy, ln(1 + beat) AS beat_log, bpm * energy AS drive, energy / (bpm + 1e-6) AS energy_ratio FROM ({PF})", "bpm energy beat_log drive energy_ratio")
def _(s, d):
    out = engineer.engineer_alternate(part_features(s, d), ["69-BPM", "2-Energym", "beat_strength"], ("69-BPM",), {"drive": ("69-BPM", "2-Energym"), "energy_ratio": ("2-Energym", "69-BPM")}, ("p_partkey",))
    return out.select("p_partkey", F.col("`69-BPM`").alias("bpm"), F.col("`2-Energym`").alias("energy"), F.col("beat_strength_log").alias("beat_log"), "drive", "energy_ratio")


HOLES = "SELECT d.doc_id, CAST(l.quality AS DOUBLE) AS q FROM documents d LEFT JOIN labels l USING (doc_id)"


def holes(s, d):
    return read(s, d, "documents").select("doc_id").join(read(s, d, "labels").select("doc_id", F.col("quality").cast("double").alias("q")), "doc_id", "left")


@query("impute_zero", f"SELECT doc_id, coalesce(q, 0) AS q FROM ({HOLES})", "q")
def _(s, d):
    return holes(s, d).select("doc_id", F.coalesce(N.clean(F.col("q")), F.lit(0.0)).alias("q"))


@query("impute_mean", f"SELECT doc_id, coalesce(q, (SELECT avg(q) FROM ({HOLES}))) AS q FROM ({HOLES})", "q")
def _(s, d):
    return engineer.impute_mean(holes(s, d), ["q"])


@query("drop_constant", "SELECT f AS feature, CAST(n AS BIGINT) AS n_distinct FROM (SELECT 'p_size' AS f, count(DISTINCT p_size) AS n FROM part UNION ALL SELECT 'p_retailprice', count(DISTINCT p_retailprice) FROM part)")
def _(s, d):
    p = read(s, d, "part").select("p_size", "p_retailprice", F.lit(3).alias("same"))
    left = engineer.drop_constant(p, p.columns).columns
    return p.agg(*[F.countDistinct(c).alias(c) for c in left]).select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("n_distinct")) for c in left])).alias("x")).select("x.*")


@query("numeric_columns", "SELECT * FROM (VALUES ('p_partkey'), ('p_size'), ('p_retailprice')) t(name)")
def _(s, d):
    return s.createDataFrame([(c,) for c in engineer.numeric_columns(read(s, d, "part"))], "name string")


# ---------------------------------------------------------------- selection

DERIVED = "SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, CAST(p_size * p_size AS DOUBLE) AS size_sq, sqrt(p_size) AS size_rt, p_retailprice AS price, ln(1 + p_retailprice) AS price_log FROM part"
DCOLS = ["size", "size_sq", "size_rt", "price", "price_log"]


def derived(s, d):
    p = read(s, d, "part")
    x = F.col("p_size").cast("double")
    return p.select("p_partkey", x.alias("size"), (x * x).alias("size_sq"), F.sqrt(x).alias("size_rt"), F.col("p_retailprice").alias("price"), F.log1p("p_retailprice").alias("price_log"))


CORR = " UNION ALL ".join(f"SELECT '{a}' AS f1, '{b}' AS f2, corr({a}, {b}) AS r FROM ({DERIVED})" for i, a in enumerate(DCOLS) for b in DCOLS[i + 1 :])


@query("corr_pairs", CORR, "r")
def _(s, d):
    return select.correlations(derived(s, d), DCOLS).select("f1", "f2", "r")


@query("corr_dedup", f"SELECT f.feature, f.feature NOT IN (SELECT f2 FROM ({CORR}) WHERE abs(r) > 0.95) AS kept FROM (VALUES {', '.join(f'({c!r})' for c in DCOLS)}) f(feature)")
def _(s, d):
    return select.remove_correlated(derived(s, d), DCOLS)


def long_embeddings(s, d):
    return geometry.long(embeddings(s, d), "v", "track_id", "genre", "cluster").select("track_id", "genre", "cluster", F.format_string("f%02d", "dim").alias("feature"), F.col("x").alias("value"))


LONG = f"{E}, l AS (SELECT track_id, genre, cluster, printf('f%02d', i) AS feature, x AS value FROM (SELECT track_id, genre, cluster, unnest(range(0, 64)) AS i, unnest(v) AS x FROM e))"


def var_sql(by: str, out: str, expr: str) -> str:
    return f"SELECT feature, {expr} AS {out} FROM (SELECT feature, sum(n) AS n, count(*) AS k, sum(n * (m - gm) ** 2) AS b, sum(w) AS w FROM (SELECT feature, {by}, count(*) AS n, avg(value) AS m, var_pop(value) * count(*) AS w FROM l GROUP BY feature, {by}) JOIN (SELECT feature, avg(value) AS gm FROM l GROUP BY feature) USING (feature) GROUP BY feature)"


ANOVA, SEP = var_sql("genre", "f", "(b / (k - 1)) / (w / (n - k))"), var_sql("cluster", "separation", "b / (w + 1e-6)")
VARIANCE = "SELECT feature, v / max(v) OVER () AS variance FROM (SELECT feature, var_samp(value) AS v FROM l GROUP BY feature)"


@query("anova_f", f"{LONG} {ANOVA}", "f")
def _(s, d):
    return select.anova(long_embeddings(s, d), "genre")


@query("cluster_separation", f"{LONG} {SEP}", "separation")
def _(s, d):
    return select.separation(long_embeddings(s, d), "cluster")


OFF = "WITH l AS (SELECT l_linenumber % 3 AS genre, unnest(['price', 'quantity']) AS feature, unnest([l_extendedprice + 1e6, l_quantity + 1e6]) AS value FROM lineitem)"


@query("anova_f_offset", f"{OFF} SELECT feature, round(f, 3) AS f FROM ({ANOVA})", "f")
def _(s, d):
    """ANOVA of values far from 0, where sums of squares less squared sums fail."""
    x = read(s, d, "lineitem").select((F.col("l_linenumber") % 3).alias("genre"), (F.col("l_extendedprice").cast("double") + 1e6).alias("price"), (F.col("l_quantity").cast("double") + 1e6).alias("quantity"))
    long = x.select("genre", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in ("price", "quantity")])).alias("f")).select("genre", "f.*")
    return select.anova(long, "genre").withColumn("f", F.round("f", 3))


@query("variance_score", f"{LONG} {VARIANCE}", "variance")
def _(s, d):
    return select.variance(long_embeddings(s, d))


@query("mutual_info_binned", f"{LONG}, h AS (SELECT feature, genre, least(7, CAST(floor((value - lo) / (hi - lo) * 8) AS INTEGER)) AS b FROM l JOIN (SELECT feature, min(value) AS lo, max(value) AS hi FROM l GROUP BY feature) USING (feature)), k AS (SELECT feature, genre, b, count(*) AS n FROM h GROUP BY ALL), q AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature, genre) AS ng, sum(n) OVER (PARTITION BY feature, b) AS nb, sum(n) OVER (PARTITION BY feature) AS t FROM k) SELECT feature, sum(CAST(n AS DOUBLE) / t * ln(CAST(t AS DOUBLE) * n / (ng * nb))) AS mi FROM q GROUP BY feature", "mi")
def _(s, d):
    return select.binned_mi(long_embeddings(s, d), "genre")


#: The three scores that SQL can work out, with their weights.
THREE = {c: select.WEIGHTS[c] for c in ("anova", "variance", "cluster_separation")}
MI = f"SELECT feature, sum(CAST(n AS DOUBLE) / t * ln(CAST(t AS DOUBLE) * n / (ng * nb))) AS mi FROM (SELECT feature, n, sum(n) OVER (PARTITION BY feature, genre) AS ng, sum(n) OVER (PARTITION BY feature, b) AS nb, sum(n) OVER (PARTITION BY feature) AS t FROM (SELECT feature, genre, least(7, CAST(floor((value - lo) / (hi - lo) * 8) AS INTEGER)) AS b, count(*) AS n FROM l JOIN (SELECT feature, min(value) AS lo, max(value) AS hi FROM l GROUP BY feature) USING (feature) GROUP BY ALL)) GROUP BY feature"


def ens_sql(scores: dict[str, float]) -> str:
    unit = ", ".join(f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) AS {c}" for c in scores)
    total = " + ".join(f"{w} * {c}" for c, w in scores.items())
    return f"{LONG}, a AS ({ANOVA}), s AS ({SEP}), va AS ({VARIANCE}), mi AS ({MI}), sc AS (SELECT feature, f AS anova, mi AS mutual_info, f / sum(f) OVER () AS random_forest, sqrt(separation) AS extra_trees, variance, separation AS cluster_separation FROM a JOIN s USING (feature) JOIN va USING (feature) JOIN mi USING (feature)), un AS (SELECT feature, {unit} FROM sc), en AS (SELECT *, {total} AS ensemble_score FROM un), rk AS (SELECT *, CAST(row_number() OVER (ORDER BY ensemble_score DESC, feature) AS INTEGER) AS rank FROM en)"


ENS, ENS3 = ens_sql(select.WEIGHTS), ens_sql(THREE)


def score_table(s, d):
    """Six score columns of each feature that SQL can work out too; two of them stand for the importances of trees."""
    long = long_embeddings(s, d)
    scores = select.anova(long, "genre").withColumnRenamed("f", "anova").join(select.separation(long, "cluster").withColumnRenamed("separation", "cluster_separation"), "feature").join(select.variance(long), "feature")
    scores = scores.join(select.binned_mi(long, "genre").withColumnRenamed("mi", "mutual_info"), "feature")
    return scores.withColumn("random_forest", F.col("anova") / F.sum("anova").over(Window.partitionBy())).withColumn("extra_trees", F.sqrt("cluster_separation"))


def ensemble_scores(s, d):
    return select.ensemble(score_table(s, d), select.WEIGHTS)


@query("ensemble_rank_three", f"{ENS3} SELECT feature, anova, variance, cluster_separation, ensemble_score, rank FROM rk", "anova cluster_separation variance ensemble_score")
def _(s, d):
    return select.ensemble(score_table(s, d), THREE)


@query("ensemble_rank_six", f"{ENS} SELECT feature, {', '.join(select.WEIGHTS)}, ensemble_score, rank FROM rk", " ".join(select.WEIGHTS) + " ensemble_score")
def _(s, d):
    """The six-score ensemble of given score columns."""
    return ensemble_scores(s, d)


def wide_embeddings(s, d):
    return embeddings(s, d).select("track_id", "genre", "cluster", *[F.col("v")[i].alias(f"f{i:02d}") for i in range(64)])


@query("ensemble_rank")
def _(s, d):
    """The ensemble of all six scores, forests and neighbours included."""
    w = wide_embeddings(s, d)
    return select.ensemble(select.six_scores(w, "track_id", "genre", [f"f{i:02d}" for i in range(64)], w.select("track_id", "cluster")), select.WEIGHTS)


@query("ensemble_rank_alternate")
def _(s, d):
    """The second form of the ensemble: deeper trees, population variance as it is."""
    w = wide_embeddings(s, d)
    return select.ensemble(select.six_scores(w, "track_id", "genre", [f"f{i:02d}" for i in range(64)], w.select("track_id", "cluster"), True), select.WEIGHTS)


@query("selected_features", f"{ENS} SELECT feature, CAST(21 - rank AS INTEGER) AS ord FROM rk WHERE rank <= 20")
def _(s, d):
    return select.selected(ensemble_scores(s, d), 20).select("feature", (F.lit(21) - F.col("rank")).alias("ord"))


FIRST = ["f63", "f05", "f11", "f40"]


@query("hybrid_union", f"{ENS}, h AS (SELECT * FROM (VALUES {', '.join(f'({c!r}, {i})' for i, c in enumerate(FIRST))}) t(feature, o) UNION ALL SELECT feature, 100 + rank FROM (SELECT feature, rank FROM rk WHERE feature NOT IN ({', '.join(map(repr, FIRST))}) ORDER BY rank LIMIT 5)) SELECT feature, CAST(row_number() OVER (ORDER BY o) AS INTEGER) AS ord FROM h")
def _(s, d):
    first = s.createDataFrame([(c, i) for i, c in enumerate(FIRST)], "feature string, ord int")
    return select.hybrid(first, ensemble_scores(s, d).select("feature", "rank"), 5)


@query("score_row_sum", f"{ENS} SELECT feature, {' + '.join(select.WEIGHTS)} AS total, anova / 6 AS anova_part FROM un ORDER BY total DESC, feature LIMIT 20", "total anova_part")
def _(s, d):
    return select.row_sum_rank(ensemble_scores(s, d), list(select.WEIGHTS), 20).select("feature", "total", (F.col("anova") / 6).alias("anova_part"))


WIDE3 = f"{E}, w AS (SELECT track_id, list_concat(list_concat(v, list_transform(v, lambda x: x * x)), list_transform(v, lambda x: abs(x) + 0.1 * x)) AS v FROM e), l AS (SELECT track_id, unnest(range(0, 192)) AS i, unnest(v) AS x FROM w), r AS (SELECT a.i AS p1, b.i AS p2, corr(a.x, b.x) AS r FROM l a JOIN l b ON a.track_id = b.track_id AND a.i < b.i GROUP BY ALL)"


@query("corr_dedup_wide", f"{WIDE3} SELECT printf('c%03d', i) AS feature, i NOT IN (SELECT p2 FROM r WHERE abs(r) > 0.8) AS kept FROM range(0, 192) t(i)")
def _(s, d):
    """192 columns, 18,336 pairs."""
    w = embeddings(s, d).select("track_id", F.concat("v", F.transform("v", lambda x: x * x), F.transform("v", lambda x: F.abs(x) + 0.1 * x)).alias("v"))
    columns = [f"c{i:03d}" for i in range(192)]
    return select.remove_correlated(w.select(*[F.col("v")[i].alias(c) for i, c in enumerate(columns)]), columns, 0.8)


@query("set_union_difference", f"{E} SELECT DISTINCT cluster AS id, cluster IN (SELECT half FROM e) AS shared FROM e")
def _(s, d):
    e = embeddings(s, d)
    both = e.select(F.col("cluster").alias("id")).intersect(e.select("half")).withColumn("shared", F.lit(True))
    return both.unionByName(e.select(F.col("cluster").alias("id")).subtract(e.select("half")).withColumn("shared", F.lit(False)))


# ---------------------------------------------------------------- curves

CURVE = "SELECT l_linenumber AS k, sum(l_extendedprice * (8 - l_linenumber) ** 3) AS y FROM lineitem GROUP BY 1"


def curve(s, d):
    return read(s, d, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(F.sum(F.col("l_extendedprice") * F.pow(8 - F.col("l_linenumber"), F.lit(3))).alias("y"))


@query("elbow_a", f"WITH c AS ({CURVE}), z AS (SELECT k, (k - min(k) OVER ()) / CAST(max(k) OVER () - min(k) OVER () AS DOUBLE) AS u, (y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) AS v FROM c), p AS (SELECT arg_min(u, k) AS u1, arg_min(v, k) AS v1, arg_max(u, k) AS u2, arg_max(v, k) AS v2, min(k) AS a, max(k) AS b FROM z) SELECT k FROM z, p WHERE k > a AND k < b ORDER BY abs((v2 - v1) * (u1 - u) - (v1 - v) * (u2 - u1)) DESC, k LIMIT 1")
def _(s, d):
    return curves.elbow(curve(s, d))


@query("elbow_b", f"WITH c AS ({CURVE}), p AS (SELECT min(k) AS k1, max(k) AS k2, arg_min(y, k) AS y1, arg_max(y, k) AS y2 FROM c) SELECT k FROM c, p ORDER BY abs((k - k1) / CAST(k2 - k1 AS DOUBLE) - (y - y1) / (y2 - y1)) DESC, k LIMIT 1")
def _(s, d):
    return curves.elbow_endpoints(curve(s, d))


@query("consensus_vote", "SELECT CAST(k AS INTEGER) AS k FROM (SELECT p_size AS k, count(*) AS n FROM part WHERE p_size BETWEEN 15 AND 40 GROUP BY 1 ORDER BY n DESC, k LIMIT 1)")
def _(s, d):
    return curves.vote(read(s, d, "part").select(F.col("p_size").alias("k")), 15, 40)


GAPS = "SELECT l_linenumber AS k, avg(l_extendedprice) / 1000 AS gap, stddev_samp(l_discount) AS s FROM lineitem GROUP BY 1"


@query("gap_rule", f"WITH g AS (SELECT k, gap, gap >= lead(gap) OVER (ORDER BY k) - lead(s) OVER (ORDER BY k) AS ok FROM ({GAPS})) SELECT coalesce((SELECT min(k) FROM g WHERE ok), (SELECT k FROM g ORDER BY gap DESC, k LIMIT 1)) AS k")
def _(s, d):
    g = read(s, d, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg((F.avg("l_extendedprice") / 1000).alias("gap"), F.stddev_samp("l_discount").alias("s"))
    return curves.gap_choice(g)


BRANDS = "SELECT p_brand AS config, avg(p_retailprice) AS a, stddev_samp(p_retailprice) AS b, avg(p_size) AS c FROM part GROUP BY 1"
COMP = f"SELECT config, composite, CAST(row_number() OVER (ORDER BY round(composite, 9) DESC, config) AS INTEGER) AS rank FROM (SELECT config, (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER () + 1e-12) + (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER () + 1e-12) + 1 - (c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER () + 1e-12) AS composite FROM ({BRANDS}))"


def brands(s, d):
    return read(s, d, "part").groupBy(F.col("p_brand").alias("config")).agg(F.avg("p_retailprice").alias("a"), F.stddev_samp("p_retailprice").alias("b"), F.avg("p_size").alias("c"))


@query("composite_rank", COMP, "composite")
def _(s, d):
    return curves.composite(brands(s, d), ["a", "b"], ["c"], "config")


@query("winner_lookup", f"SELECT b.* FROM ({BRANDS}) b JOIN ({COMP}) r USING (config) WHERE rank = 1", "a b c")
def _(s, d):
    best = curves.composite(brands(s, d), ["a", "b"], ["c"], "config").where("rank = 1").select("config")
    return brands(s, d).join(F.broadcast(best), "config", "left_semi")


# ---------------------------------------------------------------- profiles

DIMS = {"energy": list(range(0, 11)), "danceability": list(range(11, 20)), "tempo": list(range(20, 31)), "harmonic": list(range(31, 42)), "rhythmic": list(range(42, 53)), "texture": list(range(53, 64))}
DIM_OF = "CASE " + " ".join(f"WHEN i <= {max(p)} THEN '{n}'" for n, p in DIMS.items()) + " END"


def profile_sql(group: str) -> str:
    return f"""{E}, l AS (SELECT track_id, {group} AS g, unnest(range(0, 64)) AS i, unnest(v) AS x FROM e), st AS (SELECT i, avg(x) AS m, stddev_samp(x) AS s FROM l GROUP BY i),
r AS (SELECT track_id, g, {DIM_OF} AS dim, avg((x - m) / s) AS score FROM l JOIN st USING (i) GROUP BY ALL), b AS (SELECT dim, quantile_cont(score, 0.05) AS p5, quantile_cont(score, 0.95) AS p95 FROM r GROUP BY dim),
pr AS (SELECT g, dim, greatest(0, least(100, 100 * (avg(score) - any_value(p5)) / (any_value(p95) - any_value(p5)))) AS score FROM r JOIN b USING (dim) GROUP BY g, dim)"""


for _key, _group in (("profile_cluster", "cluster"), ("profile_genre", "genre")):
    query(_key, f"{profile_sql(_group)} SELECT g AS {_group}, dim, score FROM pr", "score")(lambda s, d, g=_group: profile.profiles(embeddings(s, d), "track_id", g, "v", DIMS))


@query("profile_delta", f"{profile_sql('genre')} SELECT x.g AS g1, y.g AS g2, avg(abs(x.score - y.score)) AS delta FROM pr x JOIN pr y ON x.dim = y.dim AND x.g < y.g GROUP BY ALL", "delta")
def _(s, d):
    return profile.deltas(profile.profiles(embeddings(s, d), "track_id", "genre", "v", DIMS), "genre")


@query(
    "convergent_pairs",
    f"{profile_sql('genre')}, cc AS (SELECT genre, cluster, count(*) AS n FROM e GROUP BY ALL), sz AS (SELECT genre, count(*) AS n FROM e GROUP BY genre), dl AS (SELECT x.g AS g1, y.g AS g2, avg(abs(x.score - y.score)) AS delta FROM pr x JOIN pr y ON x.dim = y.dim AND x.g < y.g GROUP BY ALL), rt AS (SELECT g1, g2, delta, coalesce((SELECT sum(p.n * q.n) FROM cc p JOIN cc q ON p.cluster = q.cluster WHERE p.genre = g1 AND q.genre = g2), 0) / CAST(a.n * b.n AS DOUBLE) AS rate FROM dl JOIN sz a ON a.genre = g1 JOIN sz b ON b.genre = g2 WHERE delta < 15) SELECT * FROM rt ORDER BY round(rate, 9) DESC, g1, g2 LIMIT 4",
    "delta rate",
)
def _(s, d):
    return profile.convergent_pairs(embeddings(s, d), "track_id", "genre", "cluster", "v", DIMS)


@query("rank_slices", f"{E}, {PURE}, k AS (SELECT cluster, row_number() OVER (ORDER BY purity DESC, cluster) AS place, row_number() OVER (ORDER BY purity, cluster DESC) AS back FROM pur) SELECT cluster, CASE WHEN place <= 2 THEN 'top' WHEN place <= 4 THEN 'next' WHEN back <= 2 THEN 'last' WHEN back <= 4 THEN 'before last' END AS part, CAST(place AS INTEGER) AS place FROM k WHERE place <= 4 OR back <= 4")
def _(s, d):
    return profile.slices(contingency.purity_by(embeddings(s, d), "genre", "cluster"), F.col("purity"), "cluster", 2)


# ---------------------------------------------------------------- ranking


@query("top_k", "SELECT p_partkey, p_retailprice, CAST(row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS rank FROM part ORDER BY rank LIMIT 50", "p_retailprice")
def _(s, d):
    top = read(s, d, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(50)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "p_partkey")))


@query("top_k_components", f"{E}, q AS (SELECT track_id, CAST(unnest(range(0, 64)) AS INTEGER) AS dim, unnest(v) AS x FROM e) SELECT track_id, dim, CAST(row_number() OVER (PARTITION BY track_id ORDER BY x DESC, dim) AS INTEGER) AS place FROM q QUALIFY place <= 5")
def _(s, d):
    pairs = F.transform("v", lambda x, i: F.struct((-x).alias("x"), i.alias("dim")))
    return embeddings(s, d).select("track_id", F.posexplode(F.slice(F.sort_array(pairs), 1, 5)).alias("place", "p")).select("track_id", F.col("p.dim").alias("dim"), (F.col("place") + 1).alias("place"))


@query("argmax", "SELECT p_type, arg_min(p_partkey, k) AS p_partkey FROM (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) WHERE k = 1 GROUP BY p_type")
def _(s, d):
    return read(s, d, "part").groupBy("p_type").agg(F.min_by("p_partkey", F.struct(-F.col("p_retailprice"), F.col("p_partkey"))).alias("p_partkey"))


@query("category_distribution", "SELECT p_type, quantile_cont(p_retailprice, 0.25) AS q1, median(p_retailprice) AS q2, quantile_cont(p_retailprice, 0.75) AS q3, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part WHERE p_type != 'ECONOMY' GROUP BY p_type", "q1 q2 q3 low high")
def _(s, d):
    q = F.percentile("p_retailprice", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = read(s, d, "part").where("p_type != 'ECONOMY'").groupBy("p_type").agg(q.alias("q"), F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))
    return g.select("p_type", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), F.col("q")[2].alias("q3"), "low", "high")


# ---------------------------------------------------------------- sources and names


@query("json_left_lookup", "WITH m AS (SELECT user_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS bpm FROM (SELECT user_id, props, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1) SELECT e.event_id, e.user_id, m.bpm FROM events e LEFT JOIN m USING (user_id)", "bpm")
def _(s, d):
    ev = read(s, d, "events")
    meta = readers.metadata(ev.withColumn("props", F.replace("props", F.lit('"k"'), F.lit('"bpm"'))), ["user_id"], "props", "event_id")
    return readers.attach_metadata(ev.select("event_id", "user_id"), meta.select("user_id", "bpm"), ["user_id"])


@query("json_unread", "SELECT CAST(count(*) FILTER (props IS NULL) AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_broken FROM events")
def _(s, d):
    return readers.unread(read(s, d, "events"), "props")


@query("csv_round_trip", "SELECT c_custkey, c_name, c_acctbal FROM customer", "c_acctbal")
def _(s, d):
    """A table written as CSV with a header and scanned again by a stated schema."""
    path = sinks.scratch(s, "csv")
    sinks.write_table(read(s, d, "customer").select("c_custkey", "c_name", "c_acctbal"), path, "csv")
    return readers.read_csv(s, path, "c_custkey bigint, c_name string, c_acctbal double")[0]


@query("matrix_round_trip", f"{E} SELECT track_id, genre, v[1] AS x0, v[64] AS x63 FROM e", "x0 x63")
def _(s, d):
    """The feature matrix as a stored table."""
    path = sinks.scratch(s, "matrix")
    sinks.write_table(embeddings(s, d).select("track_id", "genre", F.col("v").alias("features")), path)
    return readers.read_matrix(s, path).select("track_id", "genre", F.col("features")[0].alias("x0"), F.col("features")[63].alias("x63"))


@query("cached_once", "SELECT l_linenumber, count(*) AS n FROM lineitem GROUP BY 1")
def _(s, d):
    """Built on the first call, read on the second, built apart for another configuration."""
    path = sinks.scratch(s, "cache")
    build = lambda: read(s, d, "lineitem").groupBy("l_linenumber").agg(F.count("*").alias("n"))
    readers.cached(s, path, build, {"by": "l_linenumber"})
    readers.cached(s, path, lambda: build().limit(0), {"by": "nothing"})
    return readers.cached(s, path, lambda: build().limit(0), {"by": "l_linenumber"})


@query("split_features", "SELECT p_type, p_partkey, p_size, p_retailprice FROM part", "p_retailprice")
def _(s, d):
    return readers.split_features(read(s, d, "part"), "p_type")[0]


@query("path_parse", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host, string_split(regexp_replace(url, '^[a-z]+://', ''), '/')[2] AS section FROM pages")
def _(s, d):
    rest = F.regexp_replace("url", "^[a-z]+://", "")
    return read(s, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("host"), F.get(F.split(rest, "/"), F.lit(1)).alias("section"))


@query("track_parts", "SELECT p_partkey, p_type AS genre, p_name || '.mp3' AS song, p_size > 25 AS nested FROM part")
def _(s, d):
    folder = F.concat(F.lit("/music/"), F.col("p_type"), F.lit(readers.CHART_SUFFIX + "/"), F.col("p_size").cast("string"), F.lit(" - "), F.col("p_name"), F.when(F.col("p_size") > 25, "/inner").otherwise(""), F.lit("/preview.mp3"))
    p = read(s, d, "part").withColumn("path", folder)
    return p.select("p_partkey", *[c.alias(n) for n, c in readers.track_parts(F.col("path")).items()])


@query("genre_ids", "SELECT DISTINCT p_type AS genre, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS genre_id FROM part")
def _(s, d):
    p = read(s, d, "part").select(F.concat("p_type", F.lit("-Top100-x")).alias("folder"))
    return readers.genre_ids(p, "folder").select("genre", "genre_id").distinct()


NAMED = "SELECT p_partkey, p_size, CASE p_size % 5 WHEN 0 THEN 'sub_bass_ratio' WHEN 1 THEN '71-bpm' WHEN 2 THEN 'meta.Bpm' WHEN 3 THEN 'auto_peak1_std' ELSE p_size || '-spectral_' || p_type END AS name FROM part"


def named(s, d):
    p, k = read(s, d, "part"), F.col("p_size") % 5
    name = F.when(k == 0, "sub_bass_ratio").when(k == 1, "71-bpm").when(k == 2, "meta.Bpm").when(k == 3, "auto_peak1_std").otherwise(F.concat(F.col("p_size").cast("string"), F.lit("-spectral_"), "p_type"))
    return p.select("p_partkey", name.alias("name"))


@query("category_classify", f"SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'EDM Production & Texture' WHEN 1 THEN 'Tempogram-Based' WHEN 2 THEN 'Metadata' WHEN 3 THEN 'Tempogram-Based' ELSE 'Conventional MIR' END AS category FROM ({NAMED})")
def _(s, d):
    return named(s, d).select("p_partkey", names.category(F.col("name")).alias("category"))


@query("readable_name", f"SELECT p_partkey, list_aggregate(list_transform(string_split(replace(regexp_replace(name, '^[0-9]+-', ''), '_', ' '), ' '), lambda x: upper(x[1:1]) || lower(x[2:])), 'string_agg', ' ') AS reading FROM ({NAMED})")
def _(s, d):
    return named(s, d).select("p_partkey", names.readable(F.col("name")).alias("reading"))


GENRES = ("House", "Dubstep", "Mainstage", "Drum & Bass", "Nowhere")


@query("family_map", "SELECT p_partkey, ['Groove & Breaks Cluster', 'High-Energy Bass & Hardcore', 'Commercial & Mainstage', 'High-Energy Bass & Hardcore', 'Unaffiliated'][p_size % 5 + 1] AS family, ['House', 'Dubstep', 'Mainstage', 'D&B', 'Nowhere'][p_size % 5 + 1] AS short FROM part")
def _(s, d):
    g = F.element_at(F.array(*[F.lit(x) for x in GENRES]), F.col("p_size") % 5 + 1)
    return read(s, d, "part").withColumn("g", g).select("p_partkey", names.family(F.col("g")).alias("family"), names.short(F.col("g")).alias("short"))


@query("dimension_map", "SELECT n_nationkey, n_name, coalesce(r_name, 'Unaffiliated') AS family FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) r ON n_regionkey = r_regionkey")
def _(s, d):
    r = read(s, d, "region").where("r_regionkey < 3")
    n = read(s, d, "nation")
    return n.join(r, n.n_regionkey == r.r_regionkey, "left").select("n_nationkey", "n_name", F.coalesce("r_name", F.lit("Unaffiliated")).alias("family"))


# ---------------------------------------------------------------- signals


def series(s, d):
    ev = read(s, d, "events").where("value is not null")
    spread = ev.select("user_id", "ts", "event_id", (F.col("value") - 10).alias("value"))
    return frames.ordered(spread, "user_id", ["ts", "event_id"], "value")


SER = "WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value - 10 AS x FROM events WHERE value IS NOT NULL)"


@query("zcr", f"{SER} SELECT user_id, coalesce(sum(abs(g)), 0) / (2.0 * count(*)) AS zcr FROM (SELECT user_id, sign(x) - lag(sign(x)) OVER (PARTITION BY user_id ORDER BY i) AS g FROM s) GROUP BY user_id", "zcr")
def _(s, d):
    return frames.zero_crossings(series(s, d), "user_id")


@query("frame_energy", f"{SER}, f AS (SELECT user_id, CAST(floor(i / 10.0) AS INTEGER) AS frame, x FROM s) SELECT user_id, frame, sum(x * x) / count(*) AS energy FROM f GROUP BY ALL HAVING count(*) = 10", "energy")
def _(s, d):
    return frames.energy(frames.frame(series(s, d), "user_id", 10), "user_id", "frame")


@query("energy_entropy", f"{SER}, n AS (SELECT user_id, CAST(floor(count(*) / 10.0) AS BIGINT) AS w FROM s GROUP BY user_id HAVING count(*) >= 10), e AS (SELECT user_id, CAST(floor(i / CAST(w AS DOUBLE)) AS BIGINT) AS p, sum(x * x) AS e FROM s JOIN n USING (user_id) WHERE i < w * 10 GROUP BY ALL) SELECT user_id, -sum(CASE WHEN q > 0 THEN q * log2(q + 1e-10) ELSE 0 END) AS entropy FROM (SELECT user_id, e / (sum(e) OVER (PARTITION BY user_id) + 1e-10) AS q FROM e) GROUP BY user_id", "entropy")
def _(s, d):
    return frames.energy_entropy(series(s, d), "user_id")


BINS = "b AS (SELECT user_id, CAST(floor(i / 8.0) AS INTEGER) AS frame, CAST(i % 8 AS INTEGER) AS bin, abs(x) AS m, i FROM s)"


def bins(s, d):
    return series(s, d).select("user_id", F.floor(F.col("i") / 8).cast("int").alias("frame"), (F.col("i") % 8).cast("int").alias("bin"), F.abs("x").alias("m"), "i")


@query("flux_lag", f"{SER}, {BINS}, p AS (SELECT user_id, frame, bin, m / (sum(m) OVER (PARTITION BY user_id, frame) + 1e-10) AS p FROM b), q AS (SELECT user_id, frame, p - coalesce(lag(p) OVER (PARTITION BY user_id, bin ORDER BY frame), 0) AS d FROM p) SELECT user_id, frame, sum(d * d) AS flux FROM q GROUP BY ALL", "flux")
def _(s, d):
    return frames.flux(bins(s, d), "user_id")


@query("rolloff_cumsum", f"{SER}, {BINS}, c AS (SELECT user_id, i, sum(m) OVER (PARTITION BY user_id ORDER BY i) AS c, sum(m) OVER (PARTITION BY user_id) AS t FROM b) SELECT user_id, CAST(min(i) AS INTEGER) AS rolloff FROM c WHERE c >= 0.9 * t GROUP BY user_id")
def _(s, d):
    return frames.rolloff(bins(s, d).withColumn("i", F.col("i").cast("int")), "user_id")


@query("centroid_spread", f"{SER}, {BINS} SELECT user_id, mu / 8 AS centroid, sqrt(greatest(v - mu * mu, 0)) / 8 AS spread FROM (SELECT user_id, sum(bin * m) / sum(m) AS mu, sum(bin * bin * m) / sum(m) AS v FROM b GROUP BY user_id)", "centroid spread")
def _(s, d):
    return frames.centroid_spread(bins(s, d).withColumn("f", F.col("bin").cast("double")), "user_id", F.lit(8.0))


@query("window_variance", f"{SER}, w AS (SELECT user_id, CAST(floor(i / 7.0) AS INTEGER) AS f, avg(x) AS m FROM s GROUP BY ALL HAVING count(*) = 7) SELECT u.user_id, coalesce(v, 0) AS variance FROM (SELECT DISTINCT user_id FROM s) u LEFT JOIN (SELECT user_id, CASE WHEN count(*) > 1 THEN var_pop(m) ELSE 0 END AS v FROM w GROUP BY user_id) USING (user_id)", "variance")
def _(s, d):
    return frames.window_variance(series(s, d), "user_id", 7)


@query("rms_moments", f"{SER}, m AS (SELECT user_id, avg(x) AS mu, stddev_pop(x) AS sd FROM s GROUP BY user_id) SELECT user_id, any_value(mu) AS mean, any_value(sd) AS std, CASE WHEN any_value(sd) = 0 THEN 0 ELSE avg(((x - mu) / sd) ** 3) END AS skew, CASE WHEN any_value(sd) = 0 THEN 0 ELSE avg(((x - mu) / sd) ** 4) - 3 END AS kurtosis FROM s JOIN m USING (user_id) GROUP BY user_id", "mean std skew kurtosis")
def _(s, d):
    return frames.moments(series(s, d), "user_id")


@query("crest_dynamic", f"{SER} SELECT user_id, 20 * log10((p + 1e-10) / (r + 1e-10)) AS dynamic_range_db, p / (r + 1e-10) AS crest_factor FROM (SELECT user_id, max(abs(x)) AS p, sqrt(avg(x * x)) AS r FROM s GROUP BY user_id)", "dynamic_range_db crest_factor")
def _(s, d):
    return frames.crest(series(s, d), "user_id")


@query("onset_rate", "SELECT user_id, count(*) / (epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6 + 1e-10) AS onset_rate FROM events GROUP BY user_id HAVING count(*) > 1", "onset_rate")
def _(s, d):
    ev = read(s, d, "events")
    return frames.onset_rate(ev, "user_id", "ts").join(ev.groupBy("user_id").count().where("count > 1"), "user_id", "left_semi")


@query("hp_ratio", f"{SER} SELECT user_id, avg(abs(x) / (i + 1 + 1e-10)) AS ratio_mean, stddev_pop(abs(x) / (i + 1 + 1e-10)) AS ratio_std FROM s GROUP BY user_id", "ratio_mean ratio_std")
def _(s, d):
    return frames.ratio_stats(series(s, d).select("user_id", F.abs("x").alias("a"), (F.col("i") + 1).alias("b")), "user_id", "a", "b")


@query("sidechain_rate", f"{SER} SELECT user_id, stddev_pop(abs(x)) / (avg(abs(x)) + 1e-10) AS variation FROM s GROUP BY user_id", "variation")
def _(s, d):
    return frames.variation(series(s, d).withColumn("x", F.abs("x")), "user_id")


@query("autocorrelation", f"{SER} SELECT a.user_id, CAST(b.i - a.i AS INTEGER) AS lag, sum(a.x * b.x) / (any_value(z) + 1e-10) AS r FROM s a JOIN s b ON a.user_id = b.user_id AND b.i - a.i BETWEEN 0 AND 4 JOIN (SELECT user_id, sum(x * x) AS z FROM s GROUP BY user_id) t ON t.user_id = a.user_id GROUP BY ALL", "r")
def _(s, d):
    return frames.autocorrelation(series(s, d), "user_id", 4)


CYC = "WITH t AS (SELECT p_type, p_retailprice AS bpm, CAST(p_size AS DOUBLE) AS w FROM part WHERE p_retailprice > 0), y AS (SELECT p_type, CAST(least(119, floor((log2(bpm / 60) - floor(log2(bpm / 60))) * 120)) AS INTEGER) AS bin, sum(w) AS weight FROM t GROUP BY ALL)"


def folded(s, d):
    return frames.cyclic_bins(read(s, d, "part").withColumn("w", F.col("p_size").cast("double")), "p_type", "p_retailprice", "w")


@query("cyclic_bins", f"{CYC} SELECT * FROM y", "weight")
def _(s, d):
    return folded(s, d)


@query("cyclic_summary", f"{CYC}, p AS (SELECT *, weight / (sum(weight) OVER (PARTITION BY p_type) + 1e-10) AS p FROM y), h AS (SELECT p_type, -sum(p * ln(p)) AS entropy, max(p) / (avg(p) + 1e-10) AS peak_ratio FROM p GROUP BY p_type) SELECT p_type, CAST(row_number() OVER (PARTITION BY p_type ORDER BY round(p, 12) DESC, bin) AS INTEGER) AS peak, 1 + bin / 120.0 AS s, p AS share, entropy, peak_ratio FROM p JOIN h USING (p_type) QUALIFY peak <= 5", "s share entropy peak_ratio")
def _(s, d):
    return frames.cyclic_summary(folded(s, d), "p_type")


@query("band_energy", f"{E}, q AS (SELECT track_id, unnest(range(0, 64)) * 10.0 AS f, abs(unnest(v)) AS m FROM e) SELECT track_id, sum(CASE WHEN f >= 20 AND f <= 60 THEN m ELSE 0 END) / (sum(m) + 1e-10) AS sub_bass, sum(CASE WHEN f >= 20 AND f < 250 THEN m ELSE 0 END) / (sum(m) + 1e-10) AS low, sum(CASE WHEN f >= 40 AND f <= 100 THEN m ELSE 0 END) / (sum(m) + 1e-10) AS kick FROM q GROUP BY track_id", "sub_bass low kick")
def _(s, d):
    b = geometry.long(embeddings(s, d), "v", "track_id").select("track_id", (F.col("dim") * 10.0).alias("f"), F.abs("x").alias("m"))
    return frames.band_shares(b, "track_id", {"sub_bass": (20, 60, True), "low": (20, 250, False), "kick": (40, 100, True)})


# ---------------------------------------------------------------- learned or seeded: rows only


@query("kmeans_forced")
def _(s, d):
    return cluster.forced(embeddings(s, d).drop("cluster"), "v", 35).groupBy("cluster").agg(F.count("*").alias("n"))


@query("kmeans_sweep")
def kmeans_sweep(s, d):
    return cluster.sweep(embeddings(s, d), "track_id", "v", list(range(15, 31)))


@query("natural_k")
def _(s, d):
    return cluster.natural_k(kmeans_sweep(s, d), 15, 30)


@query("natural_clusters")
def _(s, d):
    return cluster.natural(embeddings(s, d).select("track_id", "v"), "track_id", "v", 15, 40).select("track_id", "cluster")


@query("sensitivity")
def _(s, d):
    """Natural k with and without one class, and whether both agree."""
    e = embeddings(s, d)
    one, two = (cluster.natural_k(cluster.sweep(x, "track_id", "v", list(range(15, 31))), 15, 30) for x in (e, e.where("genre != 3")))
    return one.select(F.col("k").alias("k_all")).crossJoin(two.select(F.col("k").alias("k_without"))).withColumn("robust", F.col("k_all") == F.col("k_without"))


@query("gap_statistic")
def _(s, d):
    return cluster.gap_statistic(embeddings(s, d), "track_id", "v", list(range(15, 41)))


@query("divisive")
def _(s, d):
    return cluster.divisive(embeddings(s, d), "track_id", "v", 35)


@query("ward_labels")
def _(s, d):
    return cluster.tree_labels(embeddings(s, d), "track_id", "v", 35)


@query("ward_cophenetic")
def _(s, d):
    return cluster.cophenetic(embeddings(s, d), "track_id", "v")


@query("average_linkage")
def _(s, d):
    """The class tree; families: classes by their remainder, as the tables' classes are numbers."""
    return cluster.class_tree(geometry.convergence(embeddings(s, d), "genre", "v"), {g: f"family {g % 3}" for g in range(1000)})


@query("rf_importance")
def _(s, d):
    return select.forest_importance(embeddings(s, d), "genre", "v")


@query("et_importance")
def _(s, d):
    return select.tree_importance(embeddings(s, d), "genre", "v")


#: A jitter that both sides can work out.
JITTER = "((track_id * 7919 + dim * 104729) % 1000003) / 1000003.0 - 0.5"


@query(
    "mi_knn",
    f"{E}, f AS (SELECT track_id, genre, unnest(range(0, 64)) AS dim, unnest(v) AS x FROM e), p AS (SELECT dim, coalesce(nullif(stddev_pop(x), 0), 1) AS s, greatest(1, avg(abs(x))) AS m FROM f GROUP BY dim), z AS (SELECT track_id, genre, dim, x / s + 1e-10 * m * ({JITTER}) AS x FROM f JOIN p USING (dim)), "
    "w AS (SELECT *, count(*) OVER (PARTITION BY dim, genre) AS n, lag(x, 1) OVER o AS a1, lag(x, 2) OVER o AS a2, lag(x, 3) OVER o AS a3, lead(x, 1) OVER o AS b1, lead(x, 2) OVER o AS b2, lead(x, 3) OVER o AS b3 FROM z WINDOW o AS (PARTITION BY dim, genre ORDER BY x)), "
    "q AS (SELECT *, list_sort([coalesce(x - a1, 1e300), coalesce(x - a2, 1e300), coalesce(x - a3, 1e300), coalesce(b1 - x, 1e300), coalesce(b2 - x, 1e300), coalesce(b3 - x, 1e300)])[least(3, n - 1)] - 1e-14 * (1 + abs(x)) AS r FROM w WHERE n > 1), "
    "cn AS (SELECT q.dim, q.track_id, any_value(q.n) AS n, count(*) AS near FROM q JOIN q AS o ON o.dim = q.dim AND o.x BETWEEN q.x - q.r AND q.x + q.r GROUP BY q.dim, q.track_id), "
    "h AS (SELECT i, coalesce(sum(1.0 / i) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS psi FROM (SELECT unnest(range(1, (SELECT count(*) + 1 FROM e))) AS i)) "
    "SELECT 'e' || dim AS feature, greatest(0, any_value(t.psi) + avg(k.psi) - avg(s.psi) - avg(u.psi)) AS mi FROM cn JOIN (SELECT dim, count(*) AS t FROM cn GROUP BY dim) USING (dim) JOIN h t ON t.i = t JOIN h k ON k.i = least(3, cn.n - 1) JOIN h s ON s.i = cn.n JOIN h u ON u.i = cn.near GROUP BY dim",
    "mi",
)
def _(s, d):
    dims = geometry.long(embeddings(s, d), "v", "track_id", "genre").select("track_id", "genre", "dim", F.concat(F.lit("e"), F.col("dim").cast("string")).alias("feature"), F.col("x").alias("value"))
    return select.knn_mi(dims, "genre", "track_id", jitter=F.expr(JITTER))


YJ_AT = "CASE WHEN value >= 0 THEN CASE WHEN abs(lam) < 1e-9 THEN ln(value + 1) ELSE (pow(value + 1, lam) - 1) / lam END ELSE CASE WHEN abs(2 - lam) < 1e-9 THEN -ln(1 - value) ELSE -(pow(1 - value, 2 - lam) - 1) / (2 - lam) END END"


@query(
    "yeo_johnson_fit",
    f"WITH f AS (SELECT unnest(['size', 'balance']) AS feature, unnest([x, y]) AS value FROM (SELECT CAST(p_size AS DOUBLE) AS x, (p_retailprice - 1000) / 100 AS y FROM part)), g AS (SELECT feature, lam, -count(*) / 2.0 * ln(var_pop({YJ_AT})) + (lam - 1) * sum(sign(value) * ln(1 + abs(value))) AS likelihood FROM f, (SELECT i / 100.0 AS lam FROM range(-200, 401) t(i)) GROUP BY feature, lam) SELECT feature, arg_max(lam, likelihood) AS exponent FROM g GROUP BY feature",
    "exponent",
)
def _(s, d):
    """The exponent of largest likelihood of each feature, to two places."""
    p = read(s, d, "part").select(F.col("p_size").cast("double").alias("size"), ((F.col("p_retailprice").cast("double") - 1000) / 100).alias("balance"))
    return s.createDataFrame([(c, round(x, 2)) for c, x in engineer.fit_exponents(p, p.columns).items()], "feature string, exponent double")


def _scaler_sql(expr: str) -> str:
    return f"SELECT key, {expr} AS x FROM (SELECT key, x, {YJ} AS y FROM ({CUST})), (SELECT avg(x) AS xm, stddev_pop(x) AS xs, quantile_cont(x, [0.25, 0.5, 0.75]) AS q FROM ({CUST}))"


@query("scaler_standard", _scaler_sql("(x - xm) / xs"), "x")
def _(s, d):
    from taxolens.plans.models import Scaler

    return Scaler("standard").fit(customer(s, d), ["x"]).transform(customer(s, d))


@query("scaler_robust", _scaler_sql("(x - q[2]) / (q[3] - q[1])"), "x")
def _(s, d):
    from taxolens.plans.models import Scaler

    return Scaler("robust").fit(customer(s, d), ["x"]).transform(customer(s, d))


@query("scaler_ensemble")
def _(s, d):
    """Half robust, three tenths power with a fitted exponent, two tenths standard, learnt and applied as one step."""
    from taxolens.plans.models import Scaler

    return Scaler("ensemble").fit(customer(s, d), ["x"]).transform(customer(s, d))


@query("greedy_silhouette")
def _(s, d):
    return cluster.greedy_silhouette(embeddings(s, d), "track_id", "v")


@query("pca_projection")
def _(s, d):
    return cluster.projection(embeddings(s, d), "v", "track_id", "cluster")


@query("projection_centroids")
def _(s, d):
    return cluster.projection(embeddings(s, d), "v", "cluster").groupBy("cluster").agg(F.avg("px").alias("px"), F.avg("py").alias("py"))


@query("embedding_benchmark")
def _(s, d):
    from taxolens.plans.analysis import benchmark

    return benchmark(embeddings(s, d).select("track_id", "genre", "v"), "track_id", "genre", "v", list(range(15, 41)))


@query("feature_count_grid")
def _(s, d):
    from taxolens.plans.analysis import feature_count_grid

    e = embeddings(s, d)
    greedy = [r.pos for r in cluster.greedy_silhouette(e, "track_id", "v", 35, pool=60).orderBy("ord").collect()]
    ranked = [int(r.feature[1:]) for r in ensemble_scores(s, d).orderBy("rank").collect()]
    return feature_count_grid(e, "track_id", "genre", "v", greedy, ranked)


@query("audio_features")
def _(s, d):
    tracks = audio.signals(read(s, d, "events").where("value is not null"), "user_id", ["ts", "event_id"], "value")
    return audio.extract(tracks, "user_id", "y", 1000.0).select("user_id", F.explode_outer("features").alias("feature", "value"), "error")


#: Frames of 50 samples every 25, as a signal of 1000 Hz has them; magnitudes of its 26 bins by plain sums of cosines and sines.
SHORT = """WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, CAST(value AS DOUBLE) AS x FROM events WHERE value IS NOT NULL),
u AS (SELECT user_id, unnest(range(0, CAST(greatest(1, 1 + (count(*) - 50) // 50) AS BIGINT))) AS t FROM s GROUP BY user_id),
fr AS (SELECT u.user_id, t, j, coalesce(s.x, 0) AS x FROM u CROSS JOIN range(0, 50) r(j) LEFT JOIN s ON s.user_id = u.user_id AND s.i = 50 * t + j),
ft AS (SELECT user_id, t, k, k * 20.0 AS f, sqrt(sum(x * (0.54 - 0.46 * cos(2 * pi() * j / 49)) * cos(2 * pi() * j * k / 50)) ** 2 + sum(x * (0.54 - 0.46 * cos(2 * pi() * j / 49)) * sin(2 * pi() * j * k / 50)) ** 2) / (26 + 1e-10) AS m FROM fr CROSS JOIN range(0, 26) r(k) GROUP BY ALL),
zc AS (SELECT user_id, t, sum(abs(g)) / 100.0 AS v FROM (SELECT user_id, t, sign(x) - lag(sign(x)) OVER (PARTITION BY user_id, t ORDER BY j) AS g FROM fr) GROUP BY ALL),
en AS (SELECT user_id, t, sum(x * x) / 50 AS v FROM fr GROUP BY ALL),
ee AS (SELECT user_id, t, -sum(CASE WHEN p > 0 THEN p * log2(p + 1e-10) ELSE 0 END) AS v FROM (SELECT user_id, t, e / (sum(e) OVER (PARTITION BY user_id, t) + 1e-10) AS p FROM (SELECT user_id, t, j // 5 AS b, sum(x * x) AS e FROM fr GROUP BY ALL)) GROUP BY ALL),
se AS (SELECT user_id, t, -sum(CASE WHEN p > 0 THEN p * log2(p + 1e-10) ELSE 0 END) AS v FROM (SELECT user_id, t, k // 2 AS b, sum(p) AS p FROM (SELECT user_id, t, k, m / sum(m) OVER (PARTITION BY user_id, t) AS p FROM ft) WHERE k < 20 GROUP BY ALL) GROUP BY ALL),
ce AS (SELECT user_id, t, sum(m * f) / sum(m) AS c FROM ft GROUP BY ALL),
sp AS (SELECT user_id, t, sqrt(greatest(sum(m * (f - c) ** 2) / sum(m), 0)) / 500 AS v FROM ft JOIN ce USING (user_id, t) GROUP BY ALL),
fl AS (SELECT user_id, t, sum(d * d) AS v FROM (SELECT user_id, t, p - coalesce(lag(p) OVER (PARTITION BY user_id, k ORDER BY t), 0) AS d FROM (SELECT user_id, t, k, m / (sum(m) OVER (PARTITION BY user_id, t) + 1e-10) AS p FROM ft)) GROUP BY ALL),
ro AS (SELECT user_id, t, min(k) / 26.0 AS v FROM (SELECT user_id, t, k, sum(m) OVER (PARTITION BY user_id, t ORDER BY k) AS r, sum(m) OVER (PARTITION BY user_id, t) AS z FROM ft) WHERE r >= 0.9 * z GROUP BY ALL),
ed AS (SELECT q, 700 * (10 ** (2595 * log10(1 + 500.0 / 700) * q / 27 / 2595) - 1) AS h FROM range(0, 28) r(q)),
me AS (SELECT user_id, t, a.q AS b, sum(m * m * greatest(0, least((f - a.h) / (c.h - a.h), (d.h - f) / (d.h - c.h)))) AS e FROM ft CROSS JOIN ed a JOIN ed c ON c.q = a.q + 1 JOIN ed d ON d.q = a.q + 2 GROUP BY ALL),
db AS (SELECT user_id, t, b, greatest(v, max(v) OVER (PARTITION BY user_id, t) - 80) AS v FROM (SELECT user_id, t, b, 10 * log10(greatest(e, 1e-10) / greatest(max(e) OVER (PARTITION BY user_id, t), 1e-10)) AS v FROM me)),
mf AS (SELECT user_id, t, c, sum(v * cos(pi() * c * (2 * b + 1) / 52)) * sqrt(2 / 26.0) / CASE WHEN c = 0 THEN sqrt(2) ELSE 1 END AS v FROM db CROSS JOIN range(0, 13) r(c) GROUP BY user_id, t, c),
ch AS (SELECT user_id, t, c, coalesce(e / nullif(max(e) OVER (PARTITION BY user_id, t), 0), 0) AS v FROM (SELECT user_id, t, c, sum(CASE WHEN f > 20 AND (CAST(round(12 * log2(greatest(f, 1e-9) / 440)) AS BIGINT) % 12 + 12) % 12 = c THEN m * m ELSE 0 END) AS e FROM ft CROSS JOIN range(0, 12) r(c) GROUP BY ALL)),
al AS (SELECT user_id, t, 0 AS o, 'ZCR' AS name, v FROM zc UNION ALL SELECT user_id, t, 1, 'Energy', v FROM en UNION ALL SELECT user_id, t, 2, 'EnergyEntropy', v FROM ee UNION ALL SELECT user_id, t, 3, 'SpectralCentroid', c / 500 FROM ce UNION ALL SELECT user_id, t, 4, 'SpectralSpread', v FROM sp UNION ALL SELECT user_id, t, 5, 'SpectralEntropy', v FROM se UNION ALL SELECT user_id, t, 6, 'SpectralFlux', v FROM fl UNION ALL SELECT user_id, t, 7, 'SpectralRolloff', v FROM ro
 UNION ALL SELECT user_id, t, 8 + c, 'MFCCs' || (c + 1), v FROM mf UNION ALL SELECT user_id, t, 21 + c, 'ChromaVector' || (c + 1), v FROM ch UNION ALL SELECT user_id, t, 33, 'ChromaDeviation', stddev_pop(v) FROM ch GROUP BY user_id, t)
SELECT user_id, (o + 1) || '-' || name || 'm' AS feature, avg(v) AS value FROM al GROUP BY user_id, o, name UNION ALL SELECT user_id, (o + 35) || '-' || name || 'std', stddev_pop(v) FROM al GROUP BY user_id, o, name"""


@query("audio_short_term", SHORT, "value")
def _(s, d):
    """The 68 means and deviations of the 34 short-term series."""
    tracks = audio.signals(read(s, d, "events").where("value is not null"), "user_id", ["ts", "event_id"], "value")
    each = audio.extract(tracks, "user_id", "y", 1000.0).select("user_id", F.explode("features").alias("feature", "value"))
    number = F.regexp_extract("feature", "^([0-9]+)-", 1)
    return each.where((number != "") & (F.try_to_number(number, F.lit("999")) <= 68))


LEVELS = f"{SER.replace('value - 10 AS x', 'CAST(value AS DOUBLE) AS x')} SELECT user_id, 20 * log10((p + 1e-10) / (r + 1e-10)) AS dynamic_range_db, p / (r + 1e-10) AS crest_factor FROM (SELECT user_id, max(abs(x)) AS p, sqrt(avg(x * x)) AS r FROM s GROUP BY user_id)"


@query("audio_levels", LEVELS, "dynamic_range_db crest_factor")
def _(s, d):
    tracks = audio.signals(read(s, d, "events").where("value is not null"), "user_id", ["ts", "event_id"], "value")
    return audio.wide(audio.extract(tracks, "user_id", "y", 1000.0), "user_id", ["dynamic_range_db", "crest_factor"])


#: One frame over the whole signal, as signals of fewer than 2048 samples at 1000 Hz have it.
WHOLE = """WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS j, count(*) OVER (PARTITION BY user_id) AS c, CAST(value AS DOUBLE) AS x FROM events WHERE value IS NOT NULL),
w AS (SELECT user_id, j, x, greatest(16, c) AS n FROM s),
ft AS (SELECT user_id, k, k * (CAST(500 AS DOUBLE) / (n // 2)) AS f, sqrt(sum(x * (0.54 - 0.46 * cos(2 * pi() * j / (n - 1))) * cos(2 * pi() * j * k / n)) ** 2 + sum(x * (0.54 - 0.46 * cos(2 * pi() * j / (n - 1))) * sin(2 * pi() * j * k / n)) ** 2) / n AS m FROM (SELECT *, unnest(range(0, n // 2 + 1)) AS k FROM w) GROUP BY user_id, k, n),
b AS (SELECT * FROM (VALUES (1, 0, 50), (2, 50, 100), (3, 100, 200), (4, 200, 400), (5, 400, 800), (6, 800, 1600), (7, 1600, 500)) t(band, lo, hi)),
co AS (SELECT user_id, band, 10 * log10((max(m) FILTER (f >= lo AND f < hi) + 1e-10) / (min(m) FILTER (f >= lo AND f < hi) + 1e-10)) AS v FROM ft CROSS JOIN b GROUP BY user_id, band),
ce AS (SELECT user_id, sum(m * f) / (sum(m) + 1e-10) AS c, sum(m) + 1e-10 AS z, sum(m * m) + 1e-10 AS e FROM ft GROUP BY user_id),
nb AS (SELECT *, (k + o + 64 * (n // 2 + 1)) % (2 * (n // 2 + 1)) AS q FROM (SELECT user_id, k, f, m, CAST(z.n AS BIGINT) AS n FROM ft JOIN (SELECT user_id, max(n) AS n FROM w GROUP BY user_id) z USING (user_id)), range(-15, 16) r(o)),
pe AS (SELECT nb.user_id, nb.k, any_value(nb.f) AS f, any_value(nb.m) * (1 - any_value(nb.m) ** 2 / (any_value(nb.m) ** 2 + quantile_cont(o.m, 0.5) ** 2 + 1e-10)) AS g FROM nb JOIN ft o ON o.user_id = nb.user_id AND o.k = CASE WHEN q > n // 2 THEN 2 * (n // 2) + 1 - q ELSE q END GROUP BY nb.user_id, nb.k),
rs AS (SELECT user_id, n, c, greatest(n // 4, 1) AS step, unnest(range(0, CAST(1 + (c + 2 * (n // 2) - n) // greatest(n // 4, 1) AS BIGINT))) AS i FROM (SELECT user_id, CAST(max(n) AS BIGINT) AS n, count(*) AS c FROM w GROUP BY user_id)),
rm AS (SELECT rs.user_id, rs.i, sqrt(coalesce(sum(w.x * w.x), 0) / any_value(rs.n)) AS r FROM rs LEFT JOIN w ON w.user_id = rs.user_id AND w.j >= rs.i * rs.step - rs.n // 2 AND w.j < rs.i * rs.step - rs.n // 2 + rs.n GROUP BY rs.user_id, rs.i)
SELECT user_id, 'spectral_contrast_band' || band || '_mean' AS feature, coalesce(v, 0) AS value FROM co
UNION ALL SELECT user_id, 'spectral_flatness_mean', exp(avg(ln(greatest(m * m, 1e-10)))) / avg(greatest(m * m, 1e-10)) FROM ft GROUP BY user_id
UNION ALL SELECT user_id, 'spectral_bandwidth_mean', sqrt(sum(m / z * (f - c) ** 2)) FROM ft JOIN ce USING (user_id) GROUP BY user_id
UNION ALL SELECT user_id, name, sum(CASE WHEN f >= lo AND (f < hi OR shut AND f = hi) THEN m * m ELSE 0 END) / max(e) FROM ft JOIN ce USING (user_id) CROSS JOIN (VALUES ('sub_bass_ratio', 20, 60, true), ('energy_ratio_low', 20, 250, false), ('energy_ratio_mid', 250, 4000, false), ('energy_ratio_high', 4000, 20000, true)) t(name, lo, hi, shut) GROUP BY user_id, name
UNION ALL SELECT user_id, 'kick_prominence', sum(CASE WHEN f >= 40 AND f <= 100 THEN g * g ELSE 0 END) / (sum(g * g) + 1e-10) FROM pe GROUP BY user_id
UNION ALL SELECT user_id, 'rms_mean', avg(r) FROM rm GROUP BY user_id
UNION ALL SELECT user_id, 'rms_std', stddev_pop(r) FROM rm GROUP BY user_id"""
WHOLE_NAMES = [*[f"spectral_contrast_band{i}_mean" for i in range(1, 8)], "spectral_flatness_mean", "spectral_bandwidth_mean", "sub_bass_ratio", "energy_ratio_low", "energy_ratio_mid", "energy_ratio_high", "kick_prominence", "rms_mean", "rms_std"]


@query("audio_texture", WHOLE, "value")
def _(s, d):
    """Contrast, flatness, bandwidth, band shares and level of each signal."""
    tracks = audio.signals(read(s, d, "events").where("value is not null"), "user_id", ["ts", "event_id"], "value")
    return audio.extract(tracks, "user_id", "y", 1000.0).select("user_id", F.explode("features").alias("feature", "value")).where(F.col("feature").isin(WHOLE_NAMES))
