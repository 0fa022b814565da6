"""The preprocessing flow of raw recordings: band-pass, independent components, rejection of bad stretches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavemill.operators import epochs, ica, kernels


@dataclass(frozen=True)
class Flow:
    """Parameters of the flow. Without EOG and ECG channels there is nothing to tell components by, and none is fitted."""

    lo: float = 0.1
    hi: float = 100.0
    method: str = "iir"
    eog: tuple[str, ...] = ()
    ecg: str | None = None
    n_components: int = 15
    max_iter: int = 200
    reject: float = 150e-6
    flat: float = 0.0
    seconds: float = 1.0


def numbered(samples: DataFrame) -> DataFrame:
    """Samples of each channel numbered without gaps, in their order."""
    w = Window.partitionBy("subject", "ch").orderBy("n")
    return samples.select("subject", "ch", (F.row_number().over(w) - 1).cast("long").alias("n"), "x")


def packed(samples: DataFrame) -> DataFrame:
    """One row for each channel: its samples in order, and the number of the first."""
    rows = samples.groupBy("subject", "ch").agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("s"))
    return rows.select("subject", "ch", F.get("s.n", F.lit(0)).alias("n0"), F.col("s.x").alias("xs"))


def unpacked(channels: DataFrame) -> DataFrame:
    long = channels.select("subject", "ch", "n0", F.posexplode("xs").alias("k", "x"))
    return long.select("subject", "ch", (F.col("n0") + F.col("k")).alias("n"), "x")


def preprocess(samples: DataFrame, fs: float, flow: Flow = Flow()) -> DataFrame:
    """(subject, ch, n, x): filtered, without eye and heart components, and without the windows of ``seconds`` in which a
    channel's peak-to-peak amplitude is over ``reject`` or under ``flat``. Samples of a channel are numbered without gaps."""
    out = unpacked(kernels.bandpass(packed(samples), flow.lo, min(flow.hi, fs / 2 * 0.99), fs, flow.method))
    if flow.eog or flow.ecg:
        out = ica.clean(out, fs, list(flow.eog), flow.ecg, flow.n_components, flow.max_iter)[0].drop("removed")
    return epochs.drop_bad_segments(out, max(1, int(flow.seconds * fs)), flow.reject, flow.flat)
