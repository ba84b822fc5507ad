"""Track features over a table of signals; broken tracks become rows with an error."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tracks whose features a task holds at once.
TRACKS = 64


def extract(tracks: DataFrame, key: str, signal: str, sr: float = 44100.0) -> DataFrame:
    """(key, features map, error) of every track; a track that can't be read has no features and says why.

    A task holds a batch of signals of bounded bytes and the features of TRACKS tracks, however many there are.
    """
    from taxolens.sources.sinks import bound_batches

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from taxolens.functions.signal import extract as kernel

        for b in batches:
            rows = []
            for k, y in zip(b[key], b[signal], strict=True):
                try:
                    rows.append((k, kernel(np.asarray(y, float), sr), None))
                except (ValueError, TypeError, IndexError, FloatingPointError) as e:
                    rows.append((k, None, f"{type(e).__name__}: {e}"))
                if len(rows) == TRACKS:
                    yield pd.DataFrame(rows, columns=[key, "features", "error"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=[key, "features", "error"])

    bound_batches(tracks.sparkSession)
    return tracks.select(key, signal).mapInPandas(run, f"{key} {tracks.schema[key].dataType.simpleString()}, features map<string,double>, error string")


def prepared(tracks: DataFrame, key: str, signal: str, sr: float, to: float = 24_000.0, seconds: float = 120.0) -> DataFrame:
    """(key, y): signals at the rate and of the length that an embedding model takes; null signals are empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from taxolens.functions.signal import resampled

        for b in batches:
            yield pd.DataFrame({key: b[key], "y": [resampled(y if y is not None else [], sr, to, seconds) for y in b[signal]]})

    return tracks.select(key, signal).mapInPandas(run, f"{key} {tracks.schema[key].dataType.simpleString()}, y array<double>")


def wide(extracted: DataFrame, key: str, names: list[str]) -> DataFrame:
    """One column a feature, of the tracks that could be read."""
    return extracted.where("error is null").select(key, *[F.col("features")[n].alias(n) for n in names])


def signals(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, y): the samples of each key in order."""
    packed = F.sort_array(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("_v"))))
    return df.groupBy(key).agg(F.transform(packed, lambda s: s["_v"]).alias("y"))


def with_metadata(extracted: DataFrame, key: str, names: list[str], meta: DataFrame, out: str | None = None) -> DataFrame:
    """The readable tracks' features, one column each, with their metadata beside them (joined by key, nulls where there is none).

    meta: key and metadata columns. With a path, the table is written there too, and what was written is returned.
    """
    joined = wide(extracted, key, names).join(meta, key, "left")
    if out is None:
        return joined
    joined.write.mode("overwrite").parquet(out)
    return extracted.sparkSession.read.parquet(out)
