"""Event-related potentials: averages over epochs and their features in component windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Component windows in seconds, and whether the peak is the least, the greatest or the largest deflection.
COMPONENTS = [("N1", 0.08, 0.12, "min"), ("P2", 0.15, 0.25, "max"), ("LPP", 0.4, 0.8, "abs")]
DEFAULT_CHANNELS = ["Fz", "Cz", "Pz"]


def components(spark: SparkSession, windows=COMPONENTS) -> DataFrame:
    return spark.createDataFrame(windows, "component string, lo double, hi double, peak string")


def average(epochs: DataFrame, keys: tuple[str, ...] = ("subject", "code")) -> DataFrame:
    """The mean over epochs for each key, channel and time, and the spread over epochs."""
    return epochs.groupBy(*keys, "ch", "k", "t").agg(F.avg("x").alias("erp"), F.stddev_pop("x").alias("spread"), F.count("*").alias("n_epochs"))


def in_windows(erp: DataFrame, windows: DataFrame) -> DataFrame:
    """Each time of an average in every component window that holds it; the windows are a handful of rows."""
    return erp.join(F.broadcast(windows), F.col("t").between(F.col("lo"), F.col("hi")))


def first_peak(value: Column) -> Column:
    """struct(v, erp, t) of the first time at which ``value`` is greatest."""
    return F.max(F.struct(value.alias("v"), (-F.col("k")).alias("first"), F.col("erp"), F.col("t")))


def features(epochs: DataFrame, windows: DataFrame, keys: tuple[str, ...] = ("subject", "code")) -> DataFrame:
    """Amplitude, latency, mean, peak-to-peak, area, spread and inter-trial variability by key, component and channel."""
    rows = in_windows(average(epochs, keys), windows)
    score = F.when(F.col("peak") == "min", -F.col("erp")).when(F.col("peak") == "max", F.col("erp")).otherwise(F.abs("erp"))
    w = Window.partitionBy(*keys, "component", "ch").orderBy("k")
    trapezoid = (F.col("erp") + F.lead("erp").over(w)) / 2 * (F.lead("t").over(w) - F.col("t"))
    got = rows.withColumn("part", trapezoid).groupBy(*keys, "component", "ch").agg(
        first_peak(score).alias("top"), F.avg("erp").alias("mean_amplitude"), (F.max("erp") - F.min("erp")).alias("peak_to_peak"), F.coalesce(F.sum("part"), F.lit(0.0)).alias("area"),
        F.stddev_pop("erp").alias("std"), F.avg("spread").alias("itv"), F.max("n_epochs").alias("n_epochs"), F.first("peak").alias("peak"),
    )
    amplitude = F.when(F.col("peak") == "abs", F.col("mean_amplitude")).otherwise(F.col("top.erp"))
    return got.select(*keys, "component", "ch", amplitude.alias("amplitude"), F.col("top.t").alias("latency"), "mean_amplitude", "peak_to_peak", "area", "std", "itv", "n_epochs")


def global_features(epochs: DataFrame, windows: DataFrame) -> DataFrame:
    """Mean and peak over all epochs, channels and times of a window."""
    rows = epochs.join(F.broadcast(windows), F.col("t").between(F.col("lo"), F.col("hi")))
    peak = F.when(F.first("peak") == "min", F.min("x")).when(F.first("peak") == "max", F.max("x")).otherwise(F.avg("x"))
    return rows.groupBy("subject", "code", "component").agg(F.avg("x").alias("global_mean_amplitude"), peak.alias("global_peak_amplitude"))


def gradient(epochs: DataFrame, windows: DataFrame) -> DataFrame:
    """Mean of channels with F in their names less that of channels with P or O; null if either is missing."""
    rows = epochs.join(F.broadcast(windows), F.col("t").between(F.col("lo"), F.col("hi")))
    front, back = F.avg(F.when(F.col("ch").contains("F"), F.col("x"))), F.avg(F.when(F.col("ch").rlike("P|O"), F.col("x")))
    return rows.groupBy("subject", "code", "component").agg((front - back).alias("anterior_posterior_gradient"))


def difference_wave(epochs: DataFrame, one: int, two: int) -> DataFrame:
    """Average of code ``one`` less that of code ``two``, where both are present."""
    own = epochs.where(F.col("code").isin(one, two))
    side = lambda c: F.avg(F.when(F.col("code") == c, F.col("x")))
    return own.groupBy("subject", "ch", "k", "t").agg((side(one) - side(two)).alias("x")).where("x is not null")


def difference_features(epochs: DataFrame, one: int, two: int, windows: DataFrame) -> DataFrame:
    """Features of a difference wave, which counts as one epoch and takes the largest deflection as its peak."""
    wave = difference_wave(epochs, one, two).withColumn("epoch", F.lit(0))
    as_diff = windows.select(F.concat("component", F.lit("_diff")).alias("component"), "lo", "hi", F.lit("abs").alias("peak"))
    return features(wave, as_diff, ("subject",))


def component_features(epochs: DataFrame, windows: DataFrame, component: str) -> DataFrame:
    return features(epochs, windows.where(F.col("component") == component))
