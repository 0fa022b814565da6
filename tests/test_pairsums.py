"""Sums over pairs against direct sums, with missing values, many blocks and names that come late."""

from collections import Counter

import numpy as np

from wavemill.operators import pairsums


def test_pairs_against_direct_sums(spark, monkeypatch):
    r = np.random.default_rng(0)
    rows = [("s", n, c, float(v)) for c in "abcd" for n, v in enumerate(r.normal(size=300)) if r.random() < 0.8 and (c != "a" or n > 200)]
    rows += [("t", n, c, float(r.normal())) for c in "xy" for n in range(10)] + [("t", 3, "x", None), (None, 1, "a", 1.0), (None, 1, "b", 2.0)]
    df = spark.createDataFrame(rows, "subject string, n long, ch string, x double").repartition(4)
    at = {(s, c, n): v for s, n, c, v in rows if v is not None}
    pairs = [("s", i, j) for i in "abcd" for j in "abcd" if i < j] + [("t", "x", "y"), (None, "a", "b")]
    for size, held in ((4096, 1 << 20), (37, 1 << 20), (37, 100)):
        monkeypatch.setattr(pairsums, "ROWS", size)
        monkeypatch.setattr(pairsums, "HELD_BYTES", held)
        got = {(q["subject"], q["i"], q["j"]): q for q in pairsums.moments(df, ["subject"], "n", "ch", "x").collect()}
        waves = {(q["subject"], q["i"], q["j"]): q for q in pairsums.phasors(df, ["subject"]).collect()}
        assert set(got) == set(waves) == set(pairs)
        for k in pairs:
            both = [n for n in range(300) if (k[0], k[1], n) in at and (k[0], k[2], n) in at]
            x, y = (np.array([at[k[0], c, n] for n in both]) for c in k[1:])
            assert np.allclose([got[k][c] for c in ("n", "si", "sj", "sii", "sjj", "sij")], [len(x), x.sum(), y.sum(), (x * x).sum(), (y * y).sum(), (x * y).sum()])
            z = np.exp(1j * (x - y)).sum()
            assert np.allclose([waves[k]["re"], waves[k]["im"], waves[k]["n"]], [z.real, z.imag, len(x)])


def test_joint_codes(spark):
    r = np.random.default_rng(1)
    codes = {c: r.integers(1, 5, 90) for c in "ab"}
    df = spark.createDataFrame([("s", n, c, int(v)) for c in "ab" for n, v in enumerate(codes[c])], "subject string, n long, ch string, code int")
    got = {(q["x"], q["y"]): q["c"] for q in pairsums.joint_codes(df, ["subject"], 4).collect()}
    assert got == Counter(zip(codes["a"].tolist(), codes["b"].tolist()))
    assert pairsums.moments(df.where("false"), ["subject"], "n", "ch", "code").count() == 0


def test_coherence_whatever_the_cuts(spark, monkeypatch):
    from wavemill.functions import dsp
    from wavemill.operators import connectivity

    r = np.random.default_rng(2)
    shared = r.normal(size=500)
    x = np.stack([shared + 0.5 * r.normal(size=500), shared + r.normal(size=500), r.normal(size=500)])
    short = r.normal(size=(2, 20))
    rows = [("s", c, n, float(v)) for c, row in zip("abc", x) for n, v in enumerate(row)] + [("t", c, n, float(v)) for c, row in zip("ab", short) for n, v in enumerate(row)]
    df = spark.createDataFrame(rows, "subject string, ch string, n long, x double").repartition(3)
    for size in (4096, 64):
        monkeypatch.setattr(connectivity, "SPECTRUM_BLOCK", size)
        got = {(q["subject"], q["i"], q["j"]): q["w"] for q in connectivity.coherence(df, 100.0, 64).collect()}
        assert set(got) == {("s", "a", "b"), ("s", "a", "c"), ("s", "b", "c"), ("t", "a", "b")}
        for s, i, j in got:
            y = {"s": x, "t": short}[s]
            p, q = y["abc".index(i)], y["abc".index(j)]
            c, own, other = dsp.csd(p, q, 100.0, 64)[1][0], dsp.welch(p, 100.0, 64)[1][0], dsp.welch(q, 100.0, 64)[1][0]
            assert np.isclose(got[s, i, j], np.mean(np.abs(c) ** 2 / (own * other)), atol=1e-9)
