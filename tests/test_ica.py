"""ICA over blocks: planted blinks and heartbeats go, cuts don't matter, odd recordings stay."""

import numpy as np
import pytest

from wavemill.functions import dsp
from wavemill.operators import ica

FS, N = 100.0, 6000
NAMES = [f"E{k}" for k in range(6)]


def planted(seed=3):
    """Channels without artefacts, the recording with blinks and heartbeats in it, its EOG and its ECG."""
    r = np.random.default_rng(seed)
    t = np.arange(N) / FS
    blink = np.zeros(N)
    for at in np.arange(120, N - 100, 310) + r.integers(-60, 60, len(np.arange(120, N - 100, 310))):
        blink[at : at + 40] += np.hanning(40)
    beat = np.zeros(N)
    for at in np.cumsum(r.integers(80, 120, 70)):
        if at < N - 20:
            beat[at : at + 10] += np.diff(np.concatenate([[0], np.hanning(10)])) * 4
    brain = np.stack([np.sin(2 * np.pi * f * t + p) * (1 + 0.5 * np.sin(0.7 * t + p)) for f, p in ((6, 0), (11, 1), (21, 2))] + [r.laplace(0, 0.6, N)])
    clean = r.normal(0, 1, (6, 4)) @ brain
    whole = clean + np.outer(r.uniform(2, 5, 6), blink) + np.outer(r.uniform(1, 3, 6), beat)
    return clean, whole, blink + 0.05 * r.normal(size=N), beat + 0.05 * r.normal(size=N)


@pytest.fixture(scope="module")
def samples(spark):
    _, whole, eog, ecg = planted()
    rows = [("s", ch, n, float(v)) for ch, x in zip([*NAMES, "EOG", "ECG"], [*whole, eog, ecg]) for n, v in enumerate(x)]
    df = spark.createDataFrame(rows, "subject string, ch string, n long, x double").repartition(6).persist()
    yield df
    df.unpersist()


def matrix(df, names=NAMES):
    got = {(r["ch"], r["n"]): r["x"] for r in df.collect()}
    return np.array([[got[c, n] for n in range(N)] for c in names])


def test_blinks_and_heartbeats_go(spark, samples):
    clean, whole, eog, ecg = planted()
    out, found = ica.clean(samples, FS, ["EOG"], "ECG", n=6, block=1000)
    y = matrix(out)
    assert np.abs(y - clean).std() < 0.15 * np.abs(whole - clean).std()
    rows = found.collect()
    assert sum(r["removed"] for r in rows) == 2 and all(r["beats"] > 40 for r in rows)
    assert np.allclose(matrix(out, ["EOG", "ECG"]), [eog, ecg])
    assert {r["removed"] for r in out.select("removed").distinct().collect()} == {2}


def test_cuts_do_not_matter(spark, samples):
    a, b = (ica.clean(samples, FS, ["EOG"], "ECG", n=6, block=size) for size in (700, 10_000))
    assert np.allclose(matrix(a[0]), matrix(b[0]), atol=1e-6)
    for r, q in zip(a[1].orderBy("component").collect(), b[1].orderBy("component").collect()):
        assert r["removed"] == q["removed"] and abs(r["eye"] - q["eye"]) < 1e-6 and abs(r["heart"] - q["heart"]) < 1e-9 and r["beats"] == q["beats"]


def test_components_equal_those_of_the_whole_recording(spark, samples):
    _, whole, _, _ = planted()
    cut = ica.blocks(samples.where("ch like 'E_'"), 900, 0)
    fitted = ica.fit(cut, {"s": NAMES}, 6, 200, 42, 1e-8)["s"]
    s, mix, _ = dsp.fast_ica(whole, 6, 400, 42, 1e-8)
    r = np.abs(np.corrcoef(fitted.sources(whole), s)[:6, 6:])
    assert (r.max(axis=1) > 0.999).all()
    assert np.allclose(fitted.mix @ fitted.sources(whole) + fitted.mean[:, None], whole, atol=1e-6)


def test_beats_and_kuiper():
    e = np.zeros(300)
    e[[50, 60, 120, 121, 200]] = [5, 6, 4, 4, 2]
    assert ica.beats_of(e, 3, 40).tolist() == [60, 120]
    even, one = np.full(64, 10.0), np.zeros(64)
    one[5] = 640
    assert ica.kuiper(np.stack([even, one, one * 0])).round(3).tolist() == [0, round(63 / 64, 3), 0]


def test_odd_recordings(spark):
    kind = "subject string, ch string, n long, x double"
    out, found = ica.clean(spark.createDataFrame([], kind), FS, ["EOG"], "ECG")
    assert out.count() == 0 and found.count() == 0
    r = np.random.default_rng(0)
    rows = [("flat", c, n, 1.0) for c in "ab" for n in range(50)] + [("one", "a", 3, 2.0)] + [("odd", c, n, float(v)) for c in "abc" for n, v in enumerate(r.normal(size=200)) if (c, n) != ("b", 7)]
    rows += [("odd", "EOG", n, float(v)) for n, v in enumerate(r.normal(size=200))] + [("odd", "c", 300, None), ("odd", "c", 301, float("nan")), (None, "a", 1, 1.0)]
    df = spark.createDataFrame(rows, kind)
    out, found = ica.clean(df, FS, ["EOG"], "ECG", block=64)
    before = {(s, c, n): x for s, c, n, x in rows if s is not None and x is not None and x == x}
    after = {(r["subject"], r["ch"], r["n"]): r["x"] for r in out.collect()}
    assert set(after) == set(before)
    assert all(after[k] == before[k] for k in before if k[0] != "odd" or k[2] == 7 or k[1] == "EOG")
    assert {r["subject"] for r in found.collect()} == {"odd"} and {r["heart"] for r in found.collect()} == {None}
