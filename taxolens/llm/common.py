"""Session helpers shared by the text operators: shared folder, stored tables, table reads, joins on hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch that Spark sends to a Python worker; one longer row is a batch.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
#: So many of the most frequent keys of a join go to all executors; each key beyond them has less than 1 / HOT_KEYS of the rows.
HOT_KEYS = 10_000
#: Keys with fewer rows are never frequent.
HOT_LEAST = 100


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor see: spark.checkpoint.dir; a new local one where it is unset in local mode."""
    said = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not said:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        said = "file://" + tempfile.mkdtemp(prefix="taxolens-")
        spark.conf.set("spark.checkpoint.dir", said)
    return said.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other job uses; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def store(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder (cuts the lineage and survives lost executors), and its path."""
    spark = df.sparkSession
    bound_batches(spark)
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    return store(df, name)[0]


def bound_batches(spark: SparkSession) -> None:
    """Bounds the bytes of a batch for Python workers, which Spark bounds by rows, unless the session bounds them closer."""
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_CONF)) > BATCH_BYTES:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_join(rows: DataFrame, facts: DataFrame, keys: list[str], n: str = "n", hint: str | None = None) -> DataFrame:
    """Inner join of rows with facts on bigint keys, however frequent a key is.

    facts: one row a key, without null keys; n: how many of rows have it. The HOT_KEYS keys with the
    largest n are sent to all executors, a bounded number whatever the input. Their rows pass the shuffle
    by a hash of the whole row, and only the others by key.
    """
    names = [c for c in facts.columns if c not in (*keys, n)]
    hot = facts.where(F.col(n) >= HOT_LEAST).orderBy(F.desc(n), *keys).limit(HOT_KEYS).select(*keys, F.struct(*names, F.lit(True).alias("_is")).alias("_hot"))
    is_hot = F.col("_hot").isNotNull()
    marked = rows.join(F.broadcast(hot), keys, "left").withColumn("_k", F.when(is_hot, F.xxhash64(*rows.columns)).otherwise(F.col(keys[0]))).withColumn("_h", is_hot)
    cold = facts.select(F.col(keys[0]).alias("_k"), *[F.col(k).alias(f"_{k}") for k in keys[1:]], F.lit(False).alias("_h"), F.struct(*names, F.lit(True).alias("_is")).alias("_cold"))
    on = marked["_k"] == cold["_k"]
    for k in keys[1:]:
        on &= F.col(k) == F.col(f"_{k}")
    joined = marked.join(cold.hint(hint) if hint else cold, on & (marked["_h"] == cold["_h"]), "left")
    got = F.coalesce("_hot", "_cold")
    return joined.where(got.isNotNull()).select(*[F.col(f"`{c}`") for c in rows.columns], *[got[c].alias(c) for c in names])
