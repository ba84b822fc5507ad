"""Signal features over ordered rows: one series a key, samples in order of time and a tie-break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxolens.functions.numeric import xlogx

TINY = 1e-10
#: Fixed value: share of a total by which sums in another order may differ; what lies nearer counts as equal.
SUM_ERROR = 1e-11


def ordered(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, i, x): samples with their place from 0."""
    return df.select(key, (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).alias("i"), F.col(value).cast("double").alias("x"))


def frame(series: DataFrame, key: str, width: int, whole: bool = True) -> DataFrame:
    """(key, frame, i, x): frames of `width` samples side by side; a shorter last one is dropped if whole."""
    out = series.withColumn("frame", F.floor(F.col("i") / width).cast("int"))
    if whole:
        out = out.withColumn("_n", F.count("*").over(Window.partitionBy(key, "frame"))).where(F.col("_n") == width).drop("_n")
    return out


def zero_crossings(series: DataFrame, key: str) -> DataFrame:
    """(key, zcr): half the mean absolute step of the sign; null samples have sign 0."""
    s = series.withColumn("sg", F.signum(F.coalesce("x", F.lit(0.0)))).withColumn("step", F.abs(F.col("sg") - F.lag("sg").over(Window.partitionBy(key).orderBy("i"))))
    return s.groupBy(key).agg((F.sum(F.coalesce("step", F.lit(0.0))) / (2 * F.count("*"))).alias("zcr"))


def energy(series: DataFrame, key: str, *more: str) -> DataFrame:
    return series.groupBy(key, *more).agg((F.sum(F.col("x") * F.col("x")) / F.count("*")).alias("energy"))


def energy_entropy(series: DataFrame, key: str, parts: int = 10) -> DataFrame:
    """(key, entropy): bits over the energies of `parts` equal pieces of a series; samples beyond them are left out."""
    n = F.count("*").over(Window.partitionBy(key))
    s = series.withColumn("w", F.floor(n / parts).cast("int")).where((F.col("w") > 0) & (F.col("i") < F.col("w") * parts))
    e = s.groupBy(key, F.floor(F.col("i") / F.col("w")).alias("part")).agg(F.sum(F.col("x") * F.col("x")).alias("e"))
    p = e.withColumn("p", F.col("e") / (F.sum("e").over(Window.partitionBy(key)) + TINY))
    return p.groupBy(key).agg((-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log2(F.col("p") + TINY)).otherwise(0.0))).alias("entropy"))


def centroid_spread(bins: DataFrame, key: str, top: Column) -> DataFrame:
    """(key, centroid, spread) of (key, f, m): the mean place weighted by magnitude and its deviation, over top; 0 if silent."""
    t = bins.groupBy(key).agg(F.sum("m").alias("t"), F.sum(F.col("f") * F.col("m")).alias("a"), F.sum(F.col("f") * F.col("f") * F.col("m")).alias("b"))
    ok = F.col("t") > 0
    mean = F.when(ok, F.col("a") / F.when(ok, F.col("t"))).otherwise(0.0)
    var = F.when(ok, F.col("b") / F.when(ok, F.col("t"))).otherwise(0.0) - mean * mean
    return t.select(key, (mean / top).alias("centroid"), (F.sqrt(F.greatest(var, F.lit(0.0))) / top).alias("spread"))


def flux(bins: DataFrame, key: str) -> DataFrame:
    """(key, frame, flux) of (key, frame, bin, m): squared change of normalised magnitudes; the first frame against zeros."""
    p = bins.withColumn("p", F.col("m") / (F.sum("m").over(Window.partitionBy(key, "frame")) + TINY))
    step = F.col("p") - F.coalesce(F.lag("p").over(Window.partitionBy(key, "bin").orderBy("frame")), F.lit(0.0))
    return p.withColumn("d", step).groupBy(key, "frame").agg(F.sum(F.col("d") * F.col("d")).alias("flux"))


def rolloff(bins: DataFrame, key: str, share: float = 0.9) -> DataFrame:
    """(key, rolloff) of (key, i, m): the first place where the running sum reaches the share of the total.

    A running sum that equals the share (a series that repeats itself has such places) reaches it, however its rounding falls.
    """
    run = F.sum("m").over(Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    r = bins.withColumn("c", run).withColumn("t", F.sum("m").over(Window.partitionBy(key)))
    return r.where(F.col("c") >= (share - SUM_ERROR) * F.col("t")).groupBy(key).agg(F.min("i").alias("rolloff"))


def window_variance(series: DataFrame, key: str, width: int) -> DataFrame:
    """(key, variance): population variance of means of whole windows; 0 for fewer than two."""
    means = frame(series, key, width).groupBy(key, "frame").agg(F.avg("x").alias("m"))
    v = means.groupBy(key).agg(F.when(F.count("*") > 1, F.var_pop("m")).otherwise(0.0).alias("variance"))
    return series.select(key).distinct().join(v, key, "left").select(key, F.coalesce("variance", F.lit(0.0)).alias("variance"))


def moments(series: DataFrame, key: str) -> DataFrame:
    """(key, mean, std, skew, kurtosis): population figures, excess kurtosis; 0 for a constant."""
    flat = F.coalesce(F.stddev_pop("x"), F.lit(0.0)) == 0
    return series.groupBy(key).agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.when(flat, 0.0).otherwise(F.skewness("x")).alias("skew"), F.when(flat, 0.0).otherwise(F.kurtosis("x")).alias("kurtosis"))


def crest(series: DataFrame, key: str) -> DataFrame:
    """(key, dynamic_range_db, crest_factor) from the peak and the root mean square."""
    g = series.groupBy(key).agg(F.max(F.abs("x")).alias("peak"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))
    return g.select(key, (20 * F.log10((F.col("peak") + TINY) / (F.col("rms") + TINY))).alias("dynamic_range_db"), (F.col("peak") / (F.col("rms") + TINY)).alias("crest_factor"))


def onset_rate(events: DataFrame, key: str, time: str) -> DataFrame:
    """(key, onset_rate): events a second over the span from the first to the last."""
    t = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    return events.groupBy(key).agg((F.count("*") / (F.max(t) - F.min(t) + TINY)).alias("onset_rate"))


def ratio_stats(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, ratio_mean, ratio_std) of a / b by row."""
    r = F.col(a) / (F.col(b) + TINY)
    return pairs.groupBy(key).agg(F.avg(r).alias("ratio_mean"), F.stddev_pop(r).alias("ratio_std"))


def variation(series: DataFrame, key: str) -> DataFrame:
    """(key, variation): deviation over mean."""
    return series.groupBy(key).agg((F.stddev_pop("x") / (F.avg("x") + TINY)).alias("variation"))


def band_shares(bins: DataFrame, key: str, bands: dict[str, tuple[float, float, bool]], f: str = "f", m: str = "m") -> DataFrame:
    """(key, one column a band): share of magnitude within low..high (the upper end counts if the flag says so)."""
    inside = lambda lo, hi, closed: (F.col(f) >= lo) & ((F.col(f) <= hi) if closed else (F.col(f) < hi))
    return bins.groupBy(key).agg(*[(F.sum(F.when(inside(*b), F.col(m)).otherwise(0.0)) / (F.sum(m) + TINY)).alias(n) for n, b in bands.items()])


def autocorrelation(series: DataFrame, key: str, max_lag: int) -> DataFrame:
    """(key, lag, r): sums of products at each lag over that at lag 0."""
    s = series.select(key, "i", F.coalesce("x", F.lit(0.0)).alias("x"))
    packed = s.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("v"))
    lags = packed.select(key, "v", F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag")).where(F.col("lag") < F.size("v"))
    r = F.aggregate(F.zip_with(F.slice("v", 1, F.size("v") - F.col("lag")), F.slice("v", F.col("lag") + 1, F.size("v")), lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
    zero = F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)
    return lags.select(key, "lag", (r / (zero + TINY)).alias("r"))


def cyclic_bins(tempi: DataFrame, key: str, bpm: str, weight: str, base: float = 60.0, bins: int = 120) -> DataFrame:
    """(key, bin, weight): tempi folded by octaves; those not above 0 or not finite are left out."""
    ok = (F.col(bpm) > 0) & ~F.isnan(F.col(bpm).cast("double")) & (F.col(bpm).cast("double") < float("inf"))
    octave = F.log2(F.col(bpm).cast("double") / base)
    return tempi.where(ok).groupBy(key, F.least(F.lit(bins - 1), F.floor((octave - F.floor(octave)) * bins)).cast("int").alias("bin")).agg(F.sum(weight).alias("weight"))


def cyclic_summary(folded: DataFrame, key: str, bins: int = 120, top: int = 5) -> DataFrame:
    """(key, peak, s, share, entropy, peak_ratio): the strongest bins, and two figures of the whole."""
    p = folded.withColumn("p", F.col("weight") / (F.sum("weight").over(Window.partitionBy(key)) + TINY))
    whole = p.groupBy(key).agg((-F.sum(xlogx(F.col("p")))).alias("entropy"), (F.max("p") / (F.avg("p") + TINY)).alias("peak_ratio"))
    ranked = p.withColumn("peak", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.round("p", 12)), "bin"))).where(F.col("peak") <= top)
    return ranked.join(whole, key).select(key, "peak", (1 + F.col("bin") / bins).alias("s"), F.col("p").alias("share"), "entropy", "peak_ratio")
