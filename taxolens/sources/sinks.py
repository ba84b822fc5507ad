"""Sinks: tables, matrices, and the text report."""

from __future__ import annotations

import datetime
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORCED_K = 35
#: Result tables and where they lie under the output folder.
LAYOUT = {name: f"{kind}/{name}" for kind, names in {"tables": ("feature_matrix", "feature_scores", "clusters", "convergence_matrix", "converging_pairs", "phantom_pairs", "fragmentation", "sweep", "profiles", "features", "metadata", "embeddings", "contingency", "agreement", "grid", "sensitivity", "projection"), "reports": ("report", "summary")}.items() for name in names}


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder that the driver and all executors share; deleted when the driver ends.

    That is spark.checkpoint.dir; where it is unset in local mode, a new local folder.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="taxolens-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bound_batches(spark: SparkSession, size: int = 16 << 20) -> None:
    """Bounds the bytes of a batch for Python workers, which Spark bounds by rows, unless the session bounds them closer."""
    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(conf)) > size:
        spark.conf.set(conf, str(size))


def paths(root: str) -> dict[str, str]:
    return {k: f"{root.rstrip('/')}/{v}" for k, v in LAYOUT.items()}


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> dict:
    """Writes a table; returns its columns and path."""
    out = df.write.mode("overwrite")
    out.option("header", True).csv(path) if kind == "csv" else out.parquet(path)
    return {"path": path, "columns": df.columns}


def square(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """A long similarity table as a square one, for a small set of classes."""
    names = sorted(r[0] for r in df.select(column).distinct().collect())
    return df.groupBy(row).pivot(column, names).agg(F.first(value)).orderBy(row)


def summary(df_metrics: dict) -> list[tuple[str, str]]:
    natural = df_metrics.get("natural_k")
    return [*((k, str(v)) for k, v in df_metrics.items()), ("excess_categories", str(FORCED_K - natural) if natural is not None else "")]


def report(spark, metrics: dict, path: str, stamp: bool = True) -> list[str]:
    """Writes the metrics as text, and a copy named by the time; numbers that are measures have three places."""
    lines = [f"{k}: {v:.3f}" if isinstance(v, float) else f"{k}: {v}" for k, v in metrics.items()]
    out = spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1)
    out.write.mode("overwrite").text(path)
    if stamp:
        out.write.mode("overwrite").text(f"{path}_{datetime.datetime.now():%Y%m%d_%H%M%S}")
    return lines
