"""Scans: feature tables, folder trees, metadata, published results, cached embeddings."""

from __future__ import annotations

import hashlib
import json as json_text
import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from taxolens.operators.engineer import numeric_columns

#: Fixed value: what is cut off a class folder's name.
CHART_SUFFIX = "-Top100-19_03_2025"


def safe_name(name: str) -> str:
    return re.sub(r"\W+", "_", name).strip("_") or "c"


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> tuple[DataFrame, dict[str, str]]:
    """A table with plain column names, and the names it had; types are inferred only without a schema."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return plain_names(df)


def plain_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    names: dict[str, str] = {}
    for c in df.columns:
        own, n = safe_name(c), 2
        while own in names:
            own, n = f"{safe_name(c)}_{n}", n + 1
        names[own] = c
    return df.toDF(*names), names


def split_features(df: DataFrame, label: str = "genre", exclude: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """The label with all numeric columns, and their names."""
    columns = [c for c in numeric_columns(df, exclude) if c != label]
    return df.select(label, *[F.col(f"`{c}`") for c in columns]), columns


def track_parts(path: Column) -> dict[str, Column]:
    """Class, song and whether it lies one folder deeper, from .../<class>/<n - song>/[<nested>/]preview.mp3."""
    parts = F.split(path, "/")
    deep = F.size(F.filter(parts, lambda p: p.contains(" - "))) > 0
    folder = F.when(deep, F.filter(parts, lambda p: p.contains(" - "))[0])
    at = F.array_position(parts, folder).cast("int")
    song = F.concat(F.trim(F.regexp_replace(folder, r"^.*? - ", "")), F.lit(".mp3"))
    return {
        "genre": F.when(at > 1, F.replace(F.get(parts, at - 2), F.lit(CHART_SUFFIX), F.lit(""))),
        "song": F.when(deep, song),
        "nested": F.when(deep, F.size(parts) - at > 1),
    }


def walk_audio(spark: SparkSession, root: str, name: str = "preview.mp3") -> DataFrame:
    """(genre, song, path): one preview a song, the shallower one if there are two, in order of names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root).select("path")
    found = files.select("path", *[c.alias(n) for n, c in track_parts(F.col("path")).items()]).where("song is not null and genre is not null")
    best = Window.partitionBy("genre", "song").orderBy("nested", "path")
    return found.withColumn("_k", F.row_number().over(best)).where("_k = 1").select("genre", "song", "path").orderBy("genre", "song")


def missing_previews(spark: SparkSession, root: str, name: str = "preview.mp3") -> DataFrame:
    """(genre, song): folders of songs that hold files but no preview, neither at once nor one level deeper; walk_audio leaves them out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    found = files.select("path", *[c.alias(n) for n, c in track_parts(F.col("path")).items()]).where("song is not null and genre is not null")
    held = found.groupBy("genre", "song").agg(F.bool_or(F.substring_index("path", "/", -1) == name).alias("there"))
    return held.where("not there").select("genre", "song").orderBy("genre", "song")


def genre_ids(df: DataFrame, folder: str) -> DataFrame:
    """df with genre (text before -Top100) and its id, the place among sorted folders from 0."""
    names = df.select(folder).distinct()
    ids = names.select(folder, F.substring_index(F.col(folder), "-Top100", 1).alias("genre"), (F.dense_rank().over(Window.orderBy(folder)) - 1).alias("genre_id"))
    return df.join(F.broadcast(ids), folder, "left")


def metadata(df: DataFrame, key: list[str], json: str, order: str) -> DataFrame:
    """(key..., bpm, musical_key, length_ms): parsed JSON; broken documents are left out, of equal keys the last counts."""
    parsed = df.select(*key, order, F.from_json(json, "bpm double, key string, length_ms double, duration_ms double", {"mode": "PERMISSIVE"}).alias("j"), F.get_json_object(json, "$").alias("_whole"))
    last = Window.partitionBy(*key).orderBy(F.desc(order))
    kept = parsed.where("_whole is not null").withColumn("_k", F.row_number().over(last)).where("_k = 1")
    return kept.select(*key, F.col("j.bpm").alias("bpm"), F.col("j.key").alias("musical_key"), F.coalesce("j.length_ms", "j.duration_ms").alias("length_ms"))


def attach_metadata(features: DataFrame, meta: DataFrame, key: list[str]) -> DataFrame:
    """Every feature row with its metadata, nulls where there is none. Spark broadcasts meta if its size is small."""
    return features.join(meta, key, "left")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A stored feature matrix (track_id, genre, song, features)."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"{path}: run the analysis plan first, it writes this table") from e


def unread(df: DataFrame, json: str) -> DataFrame:
    """(n_missing, n_broken): rows without a document, and rows whose document is no JSON; both are left out by metadata."""
    whole = F.get_json_object(json, "$")
    return df.agg(F.count_if(F.col(json).isNull()).alias("n_missing"), F.count_if(F.col(json).isNotNull() & whole.isNull()).alias("n_broken"))


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], config: dict | None = None) -> DataFrame:
    """The table at path, built and written there if it isn't there yet.

    config: what the table depends on; its digest is part of the path, so another configuration is built anew.
    """
    if config is not None:
        path = f"{path}-{hashlib.sha256(json_text.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]}"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def embed(files: DataFrame, model: Callable[[list[bytes]], list[list[float]]], width: int, batch: int = 1) -> DataFrame:
    """(path, embedding, failed) of (path, content) by a model; a failed file gets zeros.

    model: contents to vectors; it gets `batch` files at a time, and those of a batch that fails one by one.
    """
    import pandas as pd

    def one(content):
        try:
            return [float(v) for v in model([content])[0]], False
        except Exception:  # a broken file must not end the job; the flag tells
            return [0.0] * width, True

    def run(batches):
        for b in batches:
            contents, got = b["content"].tolist(), []
            for lo in range(0, len(contents), batch):
                part = contents[lo : lo + batch]
                try:
                    vectors = [[float(v) for v in x] for x in model(part)] if len(part) > 1 else None
                except Exception:
                    vectors = None
                got += [(v, False) for v in vectors] if vectors and len(vectors) == len(part) else map(one, part)
            yield pd.DataFrame({"path": b["path"], "embedding": [v for v, _ in got], "failed": [f for _, f in got]})

    return files.select("path", "content").mapInPandas(run, "path string, embedding array<double>, failed boolean")
