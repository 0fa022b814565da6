"""Data-quality operators over samples (subject, ch, n, x), epochs and feature tables.

Standard deviations are of the population unless stated. All are grouped aggregates or windows over a recording's keys;
a ratio without a denominator is null, the signal-to-noise ratio without noise is infinite.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavemill.operators.pairsums import moments

#: Default limits of the validation rules.
MIN_DURATION, MIN_CHANNELS, MIN_SFREQ, NOISE_LIMIT, FLAT_LIMIT = 60.0, 32, 250.0, 100e-6, 1e-6
MIN_EPOCHS, MIN_EPOCH_SECONDS, CV_LIMIT = 10, 0.5, 0.5
Z_LIMIT, MISSING_LIMIT, OUTLIER_LIMIT, CORR_LIMIT = 3.0, 0.5, 0.1, 0.95


def channel_stats(samples: DataFrame) -> DataFrame:
    """Moments of each channel: everything the recording's metrics need, in one pass with partial aggregation."""
    return samples.groupBy("subject", "ch").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.sum(F.abs("x")).alias("abs_sum"), F.sum("x").alias("sum"), F.sum(F.col("x") * F.col("x")).alias("sq_sum"), F.max(F.abs("x")).alias("abs_max"), F.max("n").alias("last"))


def amplitude(samples: DataFrame) -> DataFrame:
    return samples.groupBy("subject").agg(F.avg(F.abs("x")).alias("mean_amplitude"), F.stddev_pop("x").alias("std_amplitude"), F.max(F.abs("x")).alias("max_amplitude"))


def snr(samples: DataFrame) -> DataFrame:
    """10 log10 of mean power over the power about each channel's mean."""
    s = channel_stats(samples)
    noise = F.sum(F.col("sq_sum") - F.col("sum") * F.col("mean")) / F.sum("n")
    power = F.sum("sq_sum") / F.sum("n")
    rows = s.groupBy("subject").agg(power.alias("power"), noise.alias("noise"))
    return rows.select("subject", F.when(F.col("noise") > 1e-18, 10 * F.log10(F.col("power") / F.col("noise"))).otherwise(F.lit(float("inf"))).alias("snr"))


def flat_channels(samples: DataFrame, limit: float = FLAT_LIMIT) -> DataFrame:
    return channel_stats(samples).groupBy("subject").agg(F.count_if(F.col("sd") < limit).cast("long").alias("flat_channels"), F.count("*").alias("n_channels"))


def outlier_ratio(samples: DataFrame, z: float = Z_LIMIT) -> DataFrame:
    """Share of samples further than z standard deviations from their channel's mean. The moments are joined back, so a
    long channel is never held in one window."""
    s = channel_stats(samples).select("subject", "ch", "mean", "sd")
    far = F.abs(F.col("x") - F.col("mean")) > z * F.col("sd")
    return samples.join(s, ["subject", "ch"]).groupBy("subject").agg(F.count_if(far & (F.col("sd") > 0)).cast("long").alias("outliers"), F.count("x").alias("n")).select("subject", "outliers", (F.col("outliers") / F.col("n")).alias("outlier_ratio"))


def validate(samples: DataFrame, sfreq: float, min_duration=MIN_DURATION, min_channels=MIN_CHANNELS, min_sfreq=MIN_SFREQ, noise=NOISE_LIMIT, flat=FLAT_LIMIT) -> DataFrame:
    """passed and issues of each recording. Flat channels are an issue but don't fail it."""
    rows = channel_stats(samples).groupBy("subject").agg((F.max("last") / F.lit(sfreq)).alias("duration"), F.count("*").alias("n_channels"), (F.sum("abs_sum") / F.sum("n")).alias("mean_amplitude"), F.count_if(F.col("sd") < flat).cast("long").alias("flat_channels"))
    hard = {"short recording": F.col("duration") < min_duration, "few channels": F.col("n_channels") < min_channels, "low sampling rate": F.lit(sfreq < min_sfreq), "noisy": F.col("mean_amplitude") > noise}
    issues = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in hard.items()], F.when(F.col("flat_channels") > 0, F.lit("flat channels"))))
    failed = hard["short recording"] | hard["few channels"] | hard["low sampling rate"] | hard["noisy"]
    return rows.select("subject", (~failed).alias("passed"), issues.alias("issues"), "duration", "n_channels", "mean_amplitude", "flat_channels")


def validation_struct(validated: DataFrame) -> DataFrame:
    metrics = F.create_map(*[x for c in ("duration", "mean_amplitude") for x in (F.lit(c), F.col(c))])
    return validated.select("subject", "passed", "issues", metrics.alias("quality_metrics"))


def report(validated: DataFrame) -> DataFrame:
    n = F.size("issues")
    return validated.select("subject", "passed", n.cast("int").alias("n_issues"), F.when(n > 0, F.array_join("issues", "; ")).otherwise(F.lit("None")).alias("issues"))


def pass_summary(validated: DataFrame) -> DataFrame:
    rows = validated.agg(F.count("*").alias("total"), F.count_if("passed").cast("long").alias("passed"))
    return rows.select("total", "passed", (F.col("total") - F.col("passed")).alias("failed"), F.coalesce(F.try_divide(F.col("passed"), F.col("total")), F.lit(0.0)).alias("pass_rate"))


def epoch_metrics(epochs: DataFrame, zero_k: int) -> DataFrame:
    """Number of epochs and channels, amplitude, coefficient of variation, consistency and baseline stability by subject."""
    cell = epochs.groupBy("subject", "ch", "k").agg(F.var_pop("x").alias("v"), F.avg("x").alias("m"))
    trial = cell.groupBy("subject").agg((1 - F.try_divide(F.avg("v"), F.var_pop("m"))).alias("inter_trial_consistency"))
    plain = epochs.groupBy("subject").agg(
        F.countDistinct("epoch").alias("n_epochs"), F.countDistinct("ch").alias("n_channels"), (F.max("t") - F.min("t")).alias("duration"),
        F.avg(F.abs("x")).alias("mean_amplitude"), F.stddev_pop("x").alias("std_amplitude"), F.max(F.abs("x")).alias("max_amplitude"),
        F.stddev_pop(F.when(F.col("k") == zero_k, F.col("x"))).alias("baseline_stability"),
    )
    return plain.join(trial, "subject").withColumn("coefficient_of_variation", F.try_divide("std_amplitude", "mean_amplitude"))


def validate_epochs(epochs: DataFrame, zero_k: int = 0, min_epochs=MIN_EPOCHS, min_seconds=MIN_EPOCH_SECONDS, cv=CV_LIMIT) -> DataFrame:
    m = epoch_metrics(epochs, zero_k)
    few, short = F.col("n_epochs") < min_epochs, F.col("duration") < min_seconds
    issues = F.array_compact(F.array(F.when(few, F.lit("few epochs")), F.when(short, F.lit("short epochs")), F.when(F.col("coefficient_of_variation") > cv, F.lit("high variation"))))
    return m.select("subject", (~(few | short)).alias("passed"), issues.alias("issues"))


def table_shape(wide: DataFrame) -> DataFrame:
    return wide.agg(F.count("*").alias("n_samples")).withColumn("n_features", F.lit(len(wide.columns)).cast("int"))


def missing_ratio(wide: DataFrame) -> DataFrame:
    """(name, missing_ratio, too_many) for each column, in one aggregation."""
    one = wide.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in wide.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("missing_ratio")) for c in wide.columns])
    return one.select(F.inline(pairs)).withColumn("too_many", F.col("missing_ratio") > MISSING_LIMIT)


def feature_outliers(features: DataFrame, z: float = Z_LIMIT) -> DataFrame:
    """Outliers of each feature of a long table (sample standard deviation) and their share of all its cells."""
    s = features.groupBy("name").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    cells = features.agg(F.count("value").alias("cells"))
    far = F.abs(F.col("value") - F.col("m")) > z * F.col("sd")
    rows = features.join(F.broadcast(s), "name").groupBy("name").agg(F.count_if(far).cast("long").alias("outliers"), F.count("value").alias("n"))
    return rows.join(F.broadcast(cells)).select("name", "outliers", (F.col("outliers") / F.col("cells")).alias("outlier_ratio"))


def gram(features: DataFrame, keys: list[str], row: str = "id", name: str = "name", value: str = "value") -> DataFrame:
    """Moments of each ordered-by-name pair of columns of a long table: (keys, i, j, n, si, sj, sii, sjj, sij)."""
    return moments(features, keys, row, name, value)


def pearson() -> Column:
    """Pearson's r of a row of ``gram``; null for a constant column."""
    n = F.col("n")
    cov = n * F.col("sij") - F.col("si") * F.col("sj")
    var = (n * F.col("sii") - F.col("si") * F.col("si")) * (n * F.col("sjj") - F.col("sj") * F.col("sj"))
    return F.try_divide(cov, F.sqrt(F.greatest(F.lit(0.0), var)))


def high_correlations(features: DataFrame, limit: float = CORR_LIMIT) -> DataFrame:
    """Pairs of features with |r| over the limit."""
    return gram(features, []).select("i", "j", pearson().alias("r")).where(F.abs("r") > limit)
