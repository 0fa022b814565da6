"""Streams of samples: event-time windows with late data, sessions, and a stateful filter.

Not a capability of batch feature extraction, but its natural extension: half-overlapping windows are a spectrum's
segments, sessions are recordings.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def sliding_stats(samples: DataFrame, length: str = "2 hours", slide: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Amplitude of each channel in overlapping windows of event time ``ts``."""
    return samples.withWatermark("ts", late).groupBy(F.window("ts", length, slide), "ch").agg(F.count("*").alias("n"), F.avg(F.abs("x")).alias("mean_amplitude"), F.max(F.abs("x")).alias("max_amplitude"))


def sessions(samples: DataFrame, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """Recordings: runs of samples of a subject without a longer gap."""
    return samples.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "subject").agg(F.count("*").alias("n"), F.sum("x").alias("sum_x"))


def smooth(samples: DataFrame, alpha: float = 0.1) -> DataFrame:
    """First-order recursive smoothing of each channel, its state kept between micro-batches (causal, in order of ts)."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        y = state.get[0] if state.exists else None
        out = []
        for row in pd.concat(list(batches)).sort_values("ts").itertuples():
            y = row.x if y is None else y + alpha * (row.x - y)
            out.append((key[0], row.ts, y))
        if y is not None:
            state.update((y,))
        yield pd.DataFrame(out, columns=["ch", "ts", "y"])

    return samples.select("ch", "ts", "x").groupBy("ch").applyInPandasWithState(step, "ch string, ts timestamp, y double", "y double", "append", GroupStateTimeout.NoTimeout)
