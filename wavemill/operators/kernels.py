"""Signal kernels on Spark: one row holds one signal, an Arrow batch runs the kernel.

Band-pass, phases and spectra need one channel at a time, so they run on packed channels without any grouping.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.functions import dsp


def map_signals(packed: DataFrame, fn: Callable[[np.ndarray], np.ndarray], out: str = "xs") -> DataFrame:
    """Replace each row's array ``xs`` by fn(xs) (one-dimensional); null and empty signals stay as they are."""
    keys = [c for c in packed.columns if c != "xs"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema.fields if f.name != "xs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [fn(np.array(x, float)) if x else x for x in batch.column("xs").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(got, pa.list_(pa.float64()))], names=[*keys, out])

    return packed.select(*keys, "xs").mapInArrow(run, f"{fields}, {out} array<double>")


def bandpass(packed: DataFrame, lo: float, hi: float, fs: float, method: str = "iir") -> DataFrame:
    """Zero-phase band-pass of each packed channel; the filter is designed once, on the driver."""
    if method == "iir":
        sos = dsp.butter_bandpass(lo, hi, fs)
        return map_signals(packed, lambda x: dsp.zero_phase(x, sos)[0])
    taps = dsp.fir_bandpass(lo, hi, fs)
    return map_signals(packed, lambda x: dsp.fir_filter(x, taps)[0])


def notch_filter(packed: DataFrame, f0: float, fs: float) -> DataFrame:
    sos = dsp.notch(f0, fs)
    return map_signals(packed, lambda x: dsp.zero_phase(x, sos)[0])


def phases(packed: DataFrame) -> DataFrame:
    """Instantaneous phase of each packed channel."""
    return map_signals(packed, lambda x: np.angle(dsp.analytic(x))[0])


def welch_psd(packed: DataFrame, fs: float, nperseg: int = 256, noverlap: int | None = None) -> DataFrame:
    """Long spectra (keys, f_idx, freq, p) of packed channels."""
    keys = [c for c in packed.columns if c != "xs"]
    spectra = map_signals(packed, lambda x: dsp.welch(x, fs, nperseg, noverlap)[1][0], "ps")
    return spectra.select(*keys, F.posexplode("ps").alias("f_idx", "p")).withColumn("freq", F.col("f_idx") * F.lit(fs / nperseg))


def band_power(packed: DataFrame, bands: list[tuple[str, float, float]], fs: float) -> DataFrame:
    """power and log_power of each band by packed channel: the mean square after a zero-phase band-pass."""
    keys = [c for c in packed.columns if c != "xs"]
    filters = [dsp.butter_bandpass(lo, hi, fs) for _, lo, hi in bands]
    powers = map_signals(packed, lambda x: np.array([np.mean(dsp.zero_phase(x, sos) ** 2) for sos in filters]), "ps")
    names = F.array(*[F.lit(b[0]) for b in bands])
    return powers.select(*keys, F.posexplode("ps").alias("b", "power")).select(*keys, F.get(names, F.col("b")).alias("band"), "power", F.log10(F.col("power") + 1e-10).alias("log_power"))
