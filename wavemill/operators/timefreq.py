"""Multitaper spectra of packed channels, and Morlet wavelet power of recordings of any length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.operators.ica import _blocks_of, blocks
from wavemill.operators.kernels import map_signals


def slepian(n: int, half_bandwidth: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k tapers of n samples whose energy lies most within ``half_bandwidth`` / n cycles a sample, and the shares that do.

    They are the leading eigenvectors of a symmetric tridiagonal matrix; even ones have a positive sum, odd ones begin
    positive.
    """
    w = half_bandwidth / n
    at = np.arange(n)
    main, side = ((n - 1 - 2 * at) / 2) ** 2 * np.cos(2 * np.pi * w), at[1:] * (n - at[1:]) / 2
    _, vectors = np.linalg.eigh(np.diag(main) + np.diag(side, 1) + np.diag(side, -1))
    tapers = vectors[:, ::-1][:, :k].T.copy()
    for i, t in enumerate(tapers):
        if (t.sum() if i % 2 == 0 else t[np.abs(t) > 1e-6 * np.abs(t).max()][0]) < 0:
            t *= -1
    lags = np.stack([np.correlate(t, t, "full")[n - 1 :] for t in tapers])
    kernel = np.concatenate([[2 * w], 2 * np.sin(2 * np.pi * w * at[1:]) / (np.pi * at[1:])])
    return tapers, np.clip(lags @ kernel, 0, 1)


def adapted(spectra: np.ndarray, shares: np.ndarray, variance: float, rounds: int = 100) -> np.ndarray:
    """Adaptive mean over tapers (first axis): tapers that leak weigh less where the spectrum is low."""
    level = spectra[:2].mean(axis=0)
    leak = (1 - shares)[:, None] * variance
    for _ in range(rounds):
        weight = shares[:, None] * (level / np.maximum(shares[:, None] * level + leak, 1e-300)) ** 2
        new = (weight * spectra).sum(axis=0) / np.maximum(weight.sum(axis=0), 1e-300)
        if np.max(np.abs(new - level)) <= 1e-10 * max(new.max(), 1e-300):
            return new
        level = new
    return level


def multitaper(x: np.ndarray, fs: float, half_bandwidth: float = 4.0, adaptive: bool = True, least_share: float = 0.9) -> np.ndarray:
    """One-sided density of one signal, mean taken off, over its tapers of which ``least_share`` lies within the band."""
    n = len(x)
    tapers, shares = slepian(n, half_bandwidth, max(1, min(n, int(2 * half_bandwidth) - 1)))
    keep = shares > least_share
    keep[0] = True
    tapers, shares = tapers[keep], shares[keep]
    x = x - x.mean()
    spectra = np.abs(np.fft.rfft(tapers * x)) ** 2 / fs
    out = adapted(spectra, shares, x.var() / fs) if adaptive and len(tapers) > 1 else spectra.mean(axis=0)
    out[1 : None if n % 2 else -1] *= 2
    return out


def multitaper_psd(packed: DataFrame, fs: float, half_bandwidth: float = 4.0, adaptive: bool = True) -> DataFrame:
    """Long spectra (keys, f_idx, freq, p) of packed channels; bins are fs / n apart."""
    keys = [c for c in packed.columns if c != "xs"]
    sized = packed.where(F.size("xs") > 1).withColumn("n_in", F.size("xs"))
    spectra = map_signals(sized, lambda x: multitaper(x, fs, half_bandwidth, adaptive), "ps")
    return spectra.select(*keys, F.posexplode("ps").alias("f_idx", "p"), "n_in").select(*keys, "f_idx", (F.col("f_idx") * F.lit(fs) / F.col("n_in")).alias("freq"), "p")


def morlet(freq: float, fs: float, cycles: float = 7.0) -> np.ndarray:
    """Complex taps over five deviations on both sides; a sine of amplitude a at ``freq`` has power a^2."""
    sigma = cycles / (2 * np.pi * freq)
    half = int(np.ceil(5 * sigma * fs))
    t = np.arange(-half, half + 1) / fs
    bell = np.exp(-0.5 * (t / sigma) ** 2)
    return 2 * bell / bell.sum() * np.exp(2j * np.pi * freq * t)


def wavelet_power(samples: DataFrame, fs: float, freqs: list[float], cycles: float = 7.0, step: int = 1, block: int = 4096) -> DataFrame:
    """(subject, ch, freq, n, power) at every ``step``-th sample number, of samples (subject, ch, n, x).

    Recordings are cut into blocks with margins as long as the longest wavelet reaches, so the cuts don't show. Beyond its ends,
    and where a value is missing, a signal counts as zero.
    """
    taps = [(float(f), morlet(f, fs, cycles)) for f in freqs]
    cut = blocks(samples, block, max(len(w) // 2 for _, w in taps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _blocks_of(batch):
                x = np.where(np.isfinite(b.x), b.x, 0.0)
                at = np.arange(b.n0, b.n0 + b.core)
                at = at[at % step == 0]
                for f, w in taps:
                    size = 1 << int(np.ceil(np.log2(x.shape[1] + len(w))))
                    y = np.fft.ifft(np.fft.fft(x, size) * np.fft.fft(w, size))[:, len(w) // 2 :]
                    power = np.abs(y[:, at - b.n0 + b.lead]) ** 2
                    k, n = power.shape
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b.subject] * (k * n), pa.string()), pa.array(np.repeat(b.channels, n).tolist(), pa.string()), pa.array(np.full(k * n, f)), pa.array(np.tile(at, k)), pa.array(power.ravel())],
                        names=["subject", "ch", "freq", "n", "power"],
                    )

    return cut.mapInArrow(run, "subject string, ch string, freq double, n long, power double")
