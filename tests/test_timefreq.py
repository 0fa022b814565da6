"""Tapers, adaptive spectra and wavelets against direct sums."""

import numpy as np
import pytest

from wavemill.functions import dsp
from wavemill.operators import timefreq as tf


@pytest.mark.parametrize("n, half", [(64, 2.5), (101, 4.0), (256, 3.0)])
def test_tapers_are_orthonormal_and_concentrated(n, half):
    k = int(2 * half) - 1
    tapers, shares = tf.slepian(n, half, k)
    assert np.allclose(tapers @ tapers.T, np.eye(k), atol=1e-9)
    gap = np.subtract.outer(np.arange(n), np.arange(n))
    kernel = np.where(gap == 0, 2 * half / n, np.sin(2 * np.pi * half / n * gap) / (np.pi * np.where(gap == 0, 1, gap)))
    assert np.allclose(kernel @ tapers.T, tapers.T * shares, atol=1e-7)
    assert (np.diff(shares) < 1e-9).all() and shares[0] > 0.99


def test_spectra_of_noise_and_of_a_sine():
    r = np.random.default_rng(0)
    many = np.array([tf.multitaper(r.normal(size=256), 100.0) for _ in range(60)])
    welch = np.array([dsp.welch(r.normal(size=256), 100.0, 256)[1][0] for _ in range(60)])
    assert abs(many[:, 5:-5].mean() - 2 / 100) < 0.002
    assert many[:, 5:-5].var(axis=0).mean() < 0.5 * welch[:, 5:-5].var(axis=0).mean()
    t = np.arange(400) / 100
    p = tf.multitaper(np.sin(2 * np.pi * 20 * t), 100.0, 2.5)
    assert abs(p.argmax() * 100 / 400 - 20) <= 1 and abs(p.sum() * 100 / 400 - 0.5) < 0.02
    assert np.allclose(tf.multitaper(np.full(50, 3.0), 10.0), 0)


def test_wavelets_whatever_the_cuts(spark):
    fs, r = 100.0, np.random.default_rng(1)
    x = np.stack([np.sin(2 * np.pi * 10 * np.arange(700) / fs) * 3, r.normal(size=700)])
    rows = [("s", c, n, float(v)) for c, row in zip("ab", x) for n, v in enumerate(row)]
    df = spark.createDataFrame(rows, "subject string, ch string, n long, x double").repartition(3)
    seen = []
    for block in (90, 250, 5000):
        got = {(q["ch"], q["freq"], q["n"]): q["power"] for q in tf.wavelet_power(df, fs, [10.0, 20.0], 5, 7, block).collect()}
        assert len(got) == 2 * 2 * 100
        seen.append([got[k] for k in sorted(got)])
    assert np.allclose(seen[0], seen[1], atol=1e-9) and np.allclose(seen[0], seen[2], atol=1e-9)
    w = tf.morlet(20.0, fs, 5)
    half = len(w) // 2
    for n in (0, 7, 350, 693):
        direct = sum(x[1, n - m] * w[m + half] for m in range(-half, half + 1) if 0 <= n - m < 700)
        assert abs(got["b", 20.0, n] - abs(direct) ** 2) < 1e-9
    assert abs(got["a", 10.0, 350] - 9) < 0.01 and got["a", 20.0, 350] < 0.05


def test_odd_signals(spark):
    packed = spark.createDataFrame([(1, [1.0, 2.0, 4.0]), (2, [5.0]), (3, []), (4, None)], "rec long, xs array<double>")
    assert {r["rec"] for r in tf.multitaper_psd(packed, 10.0, 1.0).collect()} == {1}
    empty = spark.createDataFrame([], "subject string, ch string, n long, x double")
    assert tf.wavelet_power(empty, 100.0, [10.0]).count() == 0
