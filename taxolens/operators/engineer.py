"""Feature engineering and scaling over wide numeric tables.

Which columns come out depends on the data (a logarithm needs a positive minimum, a
constant is dropped), so each operator makes one aggregate pass for the facts and
then one projection.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolens.functions.numeric import EPS, clean, percent_band, ratio, signed_root, unit_range, yeo_johnson

#: Columns that identify a track and are no feature.
IDENTITY = ("genre", "song", "track_name", "artist_name", "meta.Key")
#: Columns that get a square and a root, ratios by name, and the words that pair rhythm with energy.
KEY_FEATURES = ("meta.Bpm", "77-danceability", "80-onset_rate", "2-Energym", "7-SpectralFluxm", "sub_bass_ratio")
RATIOS = {"bpm_onset_ratio": ("meta.Bpm", "80-onset_rate"), "energy_sub_ratio": ("2-Energym", "sub_bass_ratio"), "groove_pump_ratio": ("77-danceability", "sidechain_mod_depth")}
TEMPO_WORDS = ("fourier_peak", "auto_peak", "cyclic_")
#: The same for the second variant.
ANCHORS = ("meta.Bpm", "77-danceability", "80-onset_rate", "2-Energym")
INTERACTIONS = {
    "bpm_onset_ratio": ("meta.Bpm", "80-onset_rate"),
    "energy_sub_interaction": ("2-Energym", "sub_bass_ratio"),
    "groove_pump_interaction": ("77-danceability", "sidechain_mod_depth"),
    "flux_onset_interaction": ("7-SpectralFluxm", "80-onset_rate"),
}
RHYTHM_WORDS, ENERGY_WORDS = ("bpm", "beat", "tempo", "rhythm"), ("energy", "power", "strength")
FAST_BPM, SLOW_BPM = 130.0, 100.0
#: Exponents that a pass of the power transform's fit tries for each column.
STEPS = 17


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = IDENTITY, kinds: tuple[str, ...] | None = None) -> list[str]:
    """Numeric columns in order: all but the excluded; kinds narrows to type names such as double."""
    allowed = kinds or ("double", "float", "bigint", "int", "smallint", "tinyint")
    return [c for c, t in df.dtypes if c not in exclude and (t in allowed or kinds is None and t.startswith("decimal"))]


def matching(columns: list[str], words: tuple[str, ...], first: int | None = None) -> list[str]:
    """Sorted columns whose name holds one of the words, in any case."""
    out = sorted({c for c in columns if any(w in c.lower() for w in words)})
    return out[:first] if first else out


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def facts(df: DataFrame, columns: list[str]) -> dict[str, tuple]:
    """(least, distinct values up to 2) of each column in one pass over the table."""
    row = df.agg(*[F.min(clean(_q(c))).alias(f"lo{i}") for i, c in enumerate(columns)], *[F.max(clean(_q(c))).alias(f"hi{i}") for i, c in enumerate(columns)]).first()
    return {c: (row[f"lo{i}"], 0 if row[f"lo{i}"] is None else 1 if row[f"lo{i}"] == row[f"hi{i}"] else 2) for i, c in enumerate(columns)}


def log_columns(df: DataFrame, columns: list[str], least: dict[str, tuple] | None = None, strict: bool = True) -> dict[str, Column]:
    """{name_log: log1p} of the columns whose minimum is above 0 (or, if not strict, at least 0)."""
    least = least or facts(df, columns)
    ok = lambda lo: lo is not None and (lo > 0 if strict else lo >= 0)
    return {f"{c}_log": F.log1p(_q(c)) for c in columns if ok(least[c][0])}


def power_columns(columns: list[str]) -> dict[str, Column]:
    return {f"{c}_squared": _q(c) * _q(c) for c in columns} | {f"{c}_sqrt": signed_root(_q(c)) for c in columns}


def product_columns(columns: list[str], first: int = 3) -> dict[str, Column]:
    rhythm, energy = matching(columns, RHYTHM_WORDS, first), matching(columns, ENERGY_WORDS, first)
    return {f"{r}_x_{e}": _q(r) * _q(e) for r in rhythm for e in energy if r != e}


def ratio_columns(pairs: dict[str, tuple[str, str]], have: list[str]) -> dict[str, Column]:
    return {name: ratio(_q(a), _q(b)) for name, (a, b) in pairs.items() if a in have and b in have}


def row_stats(columns: list[str], prefix: str) -> dict[str, Column]:
    """Mean, sample deviation and largest over columns of one row, nulls left out."""
    values = F.filter(F.array(*[clean(_q(c)) for c in columns]), lambda x: x.isNotNull())
    n = F.size(values)
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    mean = total / F.when(n > 0, n)
    spread = F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean))
    return {f"{prefix}_mean": mean, f"{prefix}_std": F.sqrt(spread / F.when(n > 1, n - 1)), f"{prefix}_max": F.array_max(values)}


def fast_slow(bpm: list[str], mean: list[str]) -> dict[str, Column]:
    """Energy above FAST_BPM over energy at or below SLOW_BPM, and the first peak's share; what lies between counts in neither."""
    zero = F.lit(0.0)
    fast = reduce(lambda s, x: s + x, [F.when(_q(b) > FAST_BPM, _q(m)).otherwise(0.0) for b, m in zip(bpm, mean, strict=True)], zero)
    slow = reduce(lambda s, x: s + x, [F.when(_q(b) <= SLOW_BPM, _q(m)).otherwise(0.0) for b, m in zip(bpm, mean, strict=True)], zero)
    total = reduce(lambda s, x: s + x, [_q(m) for m in mean], zero)
    return {"tempogram_fast_slow_ratio": fast / (slow + EPS), "fourier_peak_concentration": (_q(mean[0]) if mean else zero) / (total + EPS)}


def engineer(df: DataFrame, columns: list[str], key_features: tuple[str, ...] = KEY_FEATURES, ratios: dict[str, tuple[str, str]] = RATIOS, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, the columns and all derived ones; nulls, NaN and infinities are 0, columns with one value are gone."""
    least = facts(df, columns)
    made = log_columns(df, columns, least) | power_columns([c for c in key_features if c in columns]) | product_columns(columns) | ratio_columns(ratios, columns)
    tempo = [c for c in columns if any(w in c.lower() for w in TEMPO_WORDS)]
    if tempo:
        made |= row_stats(tempo, "tempo_features")
    peaks = [i for i in range(1, 6) if f"fourier_peak{i}_bpm" in columns and f"fourier_peak{i}_mean" in columns]
    made |= fast_slow([f"fourier_peak{i}_bpm" for i in peaks], [f"fourier_peak{i}_mean" for i in peaks])
    wide = df.select(*[_q(c) for c in keep], *[F.coalesce(clean(_q(c)), F.lit(0.0)).alias(c) for c in columns], *[F.coalesce(clean(x), F.lit(0.0)).alias(n) for n, x in made.items()])
    return drop_constant(wide, [c for c in wide.columns if c not in keep])


def engineer_alternate(df: DataFrame, columns: list[str], anchors: tuple[str, ...] = ANCHORS, interactions: dict[str, tuple[str, str]] = INTERACTIONS, keep: tuple[str, ...] = ()) -> DataFrame:
    """The second variant: logs from a minimum of 0 on, named interactions (a name with ratio divides), nulls become the column's mean."""
    made = log_columns(df, columns, strict=False) | power_columns([c for c in anchors if c in columns])
    made |= {n: ratio(_q(a), _q(b)) if "ratio" in n else _q(a) * _q(b) for n, (a, b) in interactions.items() if a in columns and b in columns}
    wide = df.select(*[_q(c) for c in keep], *[clean(_q(c)).alias(c) for c in columns], *[clean(x).alias(n) for n, x in made.items()])
    return impute_mean(wide, [c for c in wide.columns if c not in keep])


def drop_constant(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*[c for c, (_, n) in facts(df, columns).items() if n < 2])


def impute_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    means = df.agg(*[F.avg(clean(_q(c))).alias(f"m{i}") for i, c in enumerate(columns)])
    at = {c: i for i, c in enumerate(columns)}
    return df.crossJoin(F.broadcast(means)).select(*[F.coalesce(clean(_q(c)), F.col(f"m{at[c]}"), F.lit(0.0)).alias(c) if c in at else _q(c) for c in df.columns])


def _with(df: DataFrame, aggregates: list[Column]) -> DataFrame:
    """df with one row of aggregates beside each row."""
    return df.crossJoin(F.broadcast(df.agg(*aggregates)))


#: Relative rank error of a pass is 1 / ACCURACY; so few values are taken exactly; so many columns share a pass.
ACCURACY, EXACT, TOGETHER = 10_000, 10_000, 50


def quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of each column with straight lines between values; None for columns without values. Nulls, NaN and infinities are left out.

    Mergeable summaries bound each quantile's values; the next pass summarises what lies between the bounds,
    and so on until few values are left, which an exact aggregate takes. No task or aggregate holds a column's distinct values.
    """
    out: dict[str, list[float | None]] = {}
    for lo in range(0, len(columns), TOGETHER):
        out |= _quantiles(df, columns[lo : lo + TOGETHER], probabilities)
    return out


def _quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> dict[str, list[float | None]]:
    values = df.select(*[clean(_q(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    row = values.agg(*[F.struct(F.count(f"c{i}").alias("n"), F.min(f"c{i}").alias("lo"), F.max(f"c{i}").alias("hi")).alias(f"c{i}") for i in range(len(columns))]).first()
    # of each column and quantile: rank, and the bounds with the values below and within
    open_ = {(i, j): (p * (row[f"c{i}"].n - 1), row[f"c{i}"].lo, row[f"c{i}"].hi, 0, row[f"c{i}"].n) for i in range(len(columns)) if row[f"c{i}"].n for j, p in enumerate(probabilities)}
    found: dict[tuple[int, int], float | None] = {}
    inside = lambda i, lo, hi: F.when(F.col(f"c{i}").between(lo, hi), F.col(f"c{i}"))

    def close() -> dict:
        """What is left to narrow: not single values, nor few values."""
        return {k: b for k, b in open_.items() if k not in done and b[1] < b[2] and b[4] > EXACT}

    done: set[tuple[int, int]] = set()
    while some := close():
        summaries = []
        for (i, j), (rank, lo, hi, below, m) in some.items():
            first, last = (math.floor(rank) - below) / m - 2 / ACCURACY, (math.floor(rank) + 2 - below) / m + 2 / ACCURACY
            summaries.append(F.percentile_approx(inside(i, lo, hi), [max(0.0, first), min(1.0, last)], ACCURACY).alias(f"s{i}_{j}"))
        got = values.agg(*summaries).first()
        bounds = {(i, j): got[f"s{i}_{j}"] for i, j in some}
        counts = values.agg(*[F.struct(F.count_if(F.col(f"c{i}") < a).alias("below"), F.count(inside(i, a, b)).alias("m")).alias(f"s{i}_{j}") for (i, j), (a, b) in bounds.items()]).first()
        for k, (rank, lo, hi, below, m) in some.items():
            (a, b), c = bounds[k], counts[f"s{k[0]}_{k[1]}"]
            holds = c.below <= math.floor(rank) and c.below + c.m >= min(math.floor(rank) + 2, row[f"c{k[0]}"].n)
            if not holds or c.m > m / 2:  # what is left is a few values of very many rows
                done.add(k)
            if holds:
                open_[k] = rank, a, b, c.below, c.m
    if open_:
        exact = []
        for (i, j), (rank, lo, hi, below, m) in open_.items():
            share = (rank - below) / (m - 1) if m > 1 else 0.0
            exact.append(F.percentile(inside(i, lo, hi), min(max(share, 0.0), 1.0)).alias(f"s{i}_{j}"))
        got = values.agg(*exact).first()
        found = {(i, j): got[f"s{i}_{j}"] for i, j in open_}
    return {c: [found.get((i, j)) for j in range(len(probabilities))] for i, c in enumerate(columns)}


def scale_standard(df: DataFrame, c: str) -> DataFrame:
    out = _with(df, [F.avg(clean(_q(c))).alias("_m"), F.stddev_pop(clean(_q(c))).alias("_s")])
    return out.withColumn("scaled", (clean(_q(c)) - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)).drop("_m", "_s")


def scale_sample(df: DataFrame, c: str) -> DataFrame:
    out = _with(df, [F.avg(clean(_q(c))).alias("_m"), F.stddev_samp(clean(_q(c))).alias("_s")])
    return out.withColumn("scaled", (clean(_q(c)) - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)).drop("_m", "_s")


def scale_robust(df: DataFrame, c: str) -> DataFrame:
    low, middle, high = (F.lit(q).cast("double") for q in quantiles(df, [c], [0.25, 0.5, 0.75])[c])
    return df.withColumn("scaled", (clean(_q(c)) - middle) / F.when(high - low > 0, high - low).otherwise(1.0))


def scale_minmax(df: DataFrame, c: str) -> DataFrame:
    out = _with(df, [F.min(clean(_q(c))).alias("_l"), F.max(clean(_q(c))).alias("_h")])
    return out.withColumn("scaled", unit_range(clean(_q(c)), F.col("_l"), F.col("_h"))).drop("_l", "_h")


def scale_percent(df: DataFrame, c: str) -> DataFrame:
    low, high = (F.lit(q).cast("double") for q in quantiles(df, [c], [0.05, 0.95])[c])
    return df.withColumn("scaled", percent_band(clean(_q(c)), low, high))


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two sets of values as one; rows of size, mean and sum of squares about the mean."""
    n = a[0] + b[0]
    off = b[1] - a[1]
    return np.stack([n, a[1] + off * b[0] / n, a[2] + b[2] + off * off * a[0] * b[0] / n])


def _spreads(values: DataFrame, exponents: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """The population variance of each column c0, c1... under the power transform with each of its exponents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, lams in exponents.items():
                x = batch.column(f"c{i}").drop_null().to_numpy()
                if not len(x):
                    continue
                up, down = np.log1p(x[x >= 0]), np.log1p(-x[x < 0])
                with np.errstate(over="ignore", invalid="ignore"):
                    each = []
                    for lam in lams.tolist():
                        y = np.concatenate([up if abs(lam) < 1e-12 else np.expm1(lam * up) / lam, -(down if abs(2 - lam) < 1e-12 else np.expm1((2 - lam) * down) / (2 - lam))])
                        m = y.mean()
                        each.append((len(y), m, ((y - m) ** 2).sum()))
                    one = np.array(each).T
                    held[i] = _merged(held[i], one) if i in held else one
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([h.ravel().tolist() for h in held.values()], pa.list_(pa.float64()))], ["i", "sums"])

    found: dict[int, np.ndarray] = {}
    with np.errstate(over="ignore", invalid="ignore"):
        for r in values.select(*[f"c{i}" for i in exponents]).mapInArrow(run, "i int, sums array<double>").collect():
            one = np.array(r.sums).reshape(3, -1)
            found[r.i] = _merged(found[r.i], one) if r.i in found else one
    return {i: s[2] / s[0] for i, s in found.items()}


def fit_exponents(df: DataFrame, columns: list[str], low: float = -4.0, high: float = 4.0, precision: float = 1e-6) -> dict[str, float]:
    """The power transform's exponent of largest likelihood for each column; 1 for columns with fewer than two values.

    All columns are searched at once: each pass takes the variance at STEPS exponents a column, from the logarithms of a
    batch's values, and the next looks closer around the best. A task sends a size, mean and sum of squares for each exponent.
    """
    from taxolens.sources.sinks import bound_batches

    bound_batches(df.sparkSession)
    values = df.select(*[clean(_q(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    facts = {}
    for lo in range(0, len(columns), TOGETHER):
        some = range(lo, min(lo + TOGETHER, len(columns)))
        weight = lambda x: F.sum(F.signum(x) * F.log1p(F.abs(x)))
        row = values.agg(*[F.struct(F.count(f"c{i}").alias("n"), weight(F.col(f"c{i}")).alias("w"), F.min(f"c{i}").alias("lo"), F.max(f"c{i}").alias("hi")).alias(f"c{i}") for i in some]).first()
        facts |= {i: row[f"c{i}"] for i in some if row[f"c{i}"].n}
    open_ = {i: (low, high) for i, r in facts.items() if r.lo < r.hi}
    while open_ and max(b - a for a, b in open_.values()) > precision:
        spread = _spreads(values, {i: a + (b - a) / (STEPS - 1) * np.arange(STEPS) for i, (a, b) in open_.items()})
        for i, variances in spread.items():
            a, b = open_[i]
            step, f = (b - a) / (STEPS - 1), facts[i]
            loss = [math.inf if not 0 < v < math.inf else f.n / 2 * math.log(v) - (a + j * step - 1) * f.w for j, v in enumerate(variances.tolist())]
            best = loss.index(min(loss))
            open_[i] = (a + max(best - 1, 0) * step, a + min(best + 1, STEPS - 1) * step)
    return {c: sum(open_[i]) / 2 if i in open_ else 1.0 for i, c in enumerate(columns)}


def scale_power(df: DataFrame, c: str, lam: float | None = None) -> DataFrame:
    """The power transform, with its exponent fitted if none is given, then mean 0 and population deviation 1."""
    lam = fit_exponents(df, [c])[c] if lam is None else lam
    moved = df.withColumn("_y", yeo_johnson(clean(_q(c)), lam))
    return scale_standard(moved, "_y").drop("_y")


def scale_blend(df: DataFrame, c: str, lam: float | None = None) -> DataFrame:
    """Half robust, three tenths power, two tenths standard."""
    out = scale_robust(df, c).withColumnRenamed("scaled", "_r")
    out = scale_power(out, c, lam).withColumnRenamed("scaled", "_p")
    out = scale_standard(out, c)
    return out.withColumn("scaled", 0.5 * F.col("_r") + 0.3 * F.col("_p") + 0.2 * F.col("scaled")).drop("_r", "_p")
