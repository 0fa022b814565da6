"""Epoching: event-locked segments, baselines, rejection of bad epochs and of bad raw segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def annotations_to_marks(annotations: DataFrame, sfreq: float, codes: dict[str, int]) -> DataFrame:
    """(subject, task, onset seconds, description) to event marks; descriptions without a code go."""
    table = F.create_map(*[F.lit(x) for k, v in codes.items() for x in (k, v)])
    code = F.try_element_at(table, F.col("description"))
    return annotations.select("subject", "task", F.round(F.col("onset") * sfreq).cast("long").alias("sample"), F.lit(0).alias("prev"), code.cast("int").alias("code")).where("code is not null")


def cut(samples: DataFrame, marks: DataFrame, before: int, after: int) -> DataFrame:
    """Segments of samples from ``before`` to ``after`` samples about each mark, both included; k counts from the mark.

    A mark is exploded into its sample numbers and equi-joined, so no range join is needed.
    """
    want = marks.select("subject", F.col("sample").alias("epoch"), "code", F.explode(F.sequence(F.lit(before), F.lit(after))).alias("k")).withColumn("n", F.col("epoch") + F.col("k"))
    return want.join(samples.select("subject", "ch", "n", "x"), ["subject", "n"]).select("subject", "epoch", "code", "ch", F.col("k").cast("int").alias("k"), "x")


def subtract_baseline(epochs: DataFrame, lo: float, hi: float, at: str = "t") -> DataFrame:
    """x less the mean over lo <= t <= hi of its own epoch and channel; unchanged where there is no such sample."""
    w = Window.partitionBy("subject", "epoch", "ch")
    base = F.avg(F.when(F.col(at).between(lo, hi), F.col("x"))).over(w)
    return epochs.withColumn("x", F.col("x") - F.coalesce(base, F.lit(0.0)))


def bad_epochs(epochs: DataFrame, reject: float, flat: float = 0.0) -> DataFrame:
    """Epochs in which a channel's peak-to-peak amplitude is over ``reject`` or under ``flat``."""
    ptp = epochs.groupBy("subject", "epoch", "ch").agg((F.max("x") - F.min("x")).alias("ptp"))
    return ptp.where((F.col("ptp") > reject) | (F.col("ptp") < flat)).select("subject", "epoch").distinct()


def drop_bad(epochs: DataFrame, reject: float, flat: float = 0.0) -> DataFrame:
    return epochs.join(bad_epochs(epochs, reject, flat), ["subject", "epoch"], "left_anti")


def drop_bad_segments(samples: DataFrame, length: int, reject: float, flat: float = 0.0) -> DataFrame:
    """Raw rejection: windows of ``length`` samples in which a channel is too large or flat go, for all channels."""
    parts = samples.withColumn("epoch", F.floor(F.col("n") / length))
    return parts.join(bad_epochs(parts, reject, flat), ["subject", "epoch"], "left_anti").drop("epoch")


def summary(before: DataFrame, after: DataFrame, sfreq: float) -> DataFrame:
    """Samples, channels and seconds of each recording before and after preprocessing."""
    def facts(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy("subject").agg(F.countDistinct("ch").alias(f"channels_{tag}"), F.count("*").alias(f"samples_{tag}"), ((F.max("n") - F.min("n")) / F.lit(sfreq)).alias(f"seconds_{tag}"))

    return facts(before, "before").join(facts(after, "after"), "subject", "left").withColumn("samples_dropped", F.col("samples_before") - F.coalesce("samples_after", F.lit(0)))
