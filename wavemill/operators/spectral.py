"""Spectral features over a psd table (keys, f_idx, freq, p) and band powers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Frequency bands in Hz, both ends included.
BANDS = [("delta", 0.5, 4.0), ("theta", 4.0, 8.0), ("alpha", 8.0, 13.0), ("beta", 13.0, 30.0), ("gamma", 30.0, 45.0)]
EDGES = (50, 90, 95)


def band_table(spark: SparkSession, bands=BANDS) -> DataFrame:
    return spark.createDataFrame(bands, "band string, lo double, hi double")


def by_band(psd: DataFrame, bands: DataFrame) -> DataFrame:
    """Each bin in every band that holds it; the bands are a handful of rows, so the range join is a broadcast."""
    return psd.join(F.broadcast(bands), F.col("freq").between(F.col("lo"), F.col("hi")))


def band_stats(psd: DataFrame, bands: DataFrame, keys: list[str]) -> DataFrame:
    return by_band(psd, bands).groupBy(*keys, "band").agg(F.avg("p").alias("psd_mean"), F.max("p").alias("psd_max"), F.stddev_pop("p").alias("psd_std"))


def entropy(weight: Column, total: Column) -> Column:
    """A term of the Shannon entropy (nats) of weights of a given total; empty weights add nothing."""
    q = F.try_divide(weight, total)
    return F.when(q > 0, -q * F.ln(q)).otherwise(F.lit(0.0))


def spectral_entropy(psd: DataFrame, keys: list[str]) -> DataFrame:
    """-sum q ln q with q = p / sum p, from two sums: ln(total) - sum(p ln p) / total."""
    plnp = F.when(F.col("p") > 0, F.col("p") * F.ln("p")).otherwise(F.lit(0.0))
    return psd.groupBy(*keys).agg((F.ln(F.sum("p")) - F.try_divide(F.sum(plnp), F.sum("p"))).alias("spectral_entropy"))


def peak_frequency(psd: DataFrame, keys: list[str]) -> DataFrame:
    """The first frequency of greatest power."""
    return psd.groupBy(*keys).agg(F.max_by("freq", F.struct("p", -F.col("f_idx"))).alias("peak_frequency"))


def band_peak_frequency(psd: DataFrame, bands: DataFrame, keys: list[str]) -> DataFrame:
    return peak_frequency(by_band(psd, bands), [*keys, "band"])


def edge_frequency(psd: DataFrame, keys: list[str], edges=EDGES) -> DataFrame:
    """The first frequency at which the running power reaches a share of the total."""
    w = Window.partitionBy(*keys)
    run = psd.withColumn("upto", F.sum("p").over(w.orderBy("f_idx").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("p").over(w))
    return run.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") >= F.col("total") * (q / 100), F.col("freq"))).alias(f"edge_freq_{q}") for q in edges])


def relative_power(psd: DataFrame, bands: DataFrame, keys: list[str]) -> DataFrame:
    total = psd.groupBy(*keys).agg(F.sum("p").alias("total"))
    own = by_band(psd, bands).groupBy(*keys, "band").agg(F.sum("p").alias("power"))
    return own.join(total, keys).select(*keys, "band", F.try_divide("power", "total").alias("relative_power"))


def ratios(power: DataFrame, keys: list[str]) -> DataFrame:
    """alpha/theta, beta/alpha, theta/beta and total of the channel means of band powers (keys, ch, band, power)."""
    mean = power.groupBy(*keys, "band").agg(F.avg("power").alias("m"))
    band = lambda b: F.sum(F.when(F.col("band") == b, F.col("m")))
    return mean.groupBy(*keys).agg(
        (band("alpha") / (band("theta") + 1e-10)).alias("alpha_theta_ratio"), (band("beta") / (band("alpha") + 1e-10)).alias("beta_alpha_ratio"),
        (band("theta") / (band("beta") + 1e-10)).alias("theta_beta_ratio"), F.sum("m").alias("total_power"),
    )


def dominant_frequency(psd: DataFrame, keys: list[str]) -> DataFrame:
    """Peak of the channel-mean spectrum, and -sum p ln(p + 1e-10) / sum p over all channels and bins."""
    mean = psd.groupBy(*keys, "f_idx", "freq").agg(F.avg("p").alias("m"), F.sum("p").alias("s"), F.sum(F.col("p") * F.ln(F.col("p") + 1e-10)).alias("plnp"))
    return mean.groupBy(*keys).agg(F.max_by("freq", F.struct("m", -F.col("f_idx"))).alias("dominant_frequency"), (-F.try_divide(F.sum("plnp"), F.sum("s"))).alias("raw_spectral_entropy"))
