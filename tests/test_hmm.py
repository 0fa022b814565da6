"""Hidden-Markov microstates: likelihood, cuts, paths and expectations against plain programs."""

from itertools import product

import numpy as np
import pytest

from wavemill.operators import hmm

CH = ["a", "b", "c"]


def chain(k, seed=0):
    r = np.random.default_rng(seed)
    return hmm.Chain(CH, r.dirichlet(np.ones(k)), r.dirichlet(np.ones(k), k), r.normal(0, 2, (k, 3)), r.uniform(0.3, 1.5, (k, 3)))


def drawn(m, n, seed):
    r = np.random.default_rng(seed)
    states = [r.choice(len(m.start), p=m.start)]
    for _ in range(n - 1):
        states.append(r.choice(len(m.start), p=m.step[states[-1]]))
    return np.array(states), (m.mean[states] + r.normal(size=(n, 3)) * np.sqrt(m.var[states])).T


def frame(spark, recordings):
    rows = [(s, c, n, float(v)) for s, x in recordings.items() for c, row in zip(CH, x) for n, v in enumerate(row)]
    return spark.createDataFrame(rows, "subject string, ch string, n long, x double").repartition(4)


def test_expectations_and_paths_of_blocks_equal_all_paths(spark):
    m, x = chain(3), {}
    for s in "pq":
        x[s] = drawn(m, 7, ord(s))[1]
    x["p"][1, 3] = np.nan
    every = list(product(range(3), repeat=7))
    like, starts, steps, best = 0.0, np.zeros(3), np.zeros((3, 3)), {}
    for s in x:
        logs = m.logs(x[s])
        weight = np.array([np.log(m.start[p[0]]) + sum(np.log(m.step[a, b]) for a, b in zip(p, p[1:])) + logs[range(7), p].sum() for p in every])
        best[s] = every[int(weight.argmax())]
        share = np.exp(weight - weight.max())
        like += np.log(share.sum()) + weight.max()
        for p, w in zip(every, share / share.sum()):
            starts[p[0]] += w
            for a, b in zip(p, p[1:]):
                steps[a, b] += w
    for size in (2, 3, 50):
        cut = hmm.cut_blocks(frame(spark, x), size)
        v = hmm._counts(cut, m)
        assert np.isclose(v[0], like) and np.allclose(v[1:4], starts) and np.allclose(v[4:13].reshape(3, 3), steps)
        got = {}
        for r in hmm.paths(cut, m).orderBy("subject", "n").collect():
            got.setdefault(r["subject"], []).append(r["state"])
        assert {s: tuple(p) for s, p in got.items()} == best


def test_likelihood_never_falls_and_states_are_found(spark):
    m = hmm.Chain(CH, np.array([0.5, 0.5]), np.array([[0.95, 0.05], [0.1, 0.9]]), np.array([[2.0, 0, -1], [-2, 1, 1]]), np.full((2, 3), 0.8))
    x = {s: drawn(m, 400, k) for k, s in enumerate(["s1", "s2"])}
    cut = hmm.cut_blocks(frame(spark, {s: v[1] for s, v in x.items()}), 150)
    found, said = hmm.fit(cut, 2, max_iter=12, tol=1e-6)
    assert all(b >= a - 1e-6 for a, b in zip(said, said[1:])) and len(said) > 2
    got = {(r["subject"], r["n"]): r["state"] for r in hmm.paths(cut, found).collect()}
    guess = np.array([got[s, n] for s in x for n in range(400)])
    truth = np.concatenate([v[0] for v in x.values()])
    assert max((guess == truth).mean(), (guess != truth).mean()) > 0.97
    assert np.bincount(guess)[0] >= np.bincount(guess)[1]
    assert hmm.templates(spark, found).count() == 6
    other, _ = hmm.fit(hmm.cut_blocks(frame(spark, {s: v[1] for s, v in x.items()}), 10_000), 2, max_iter=12, tol=1e-6)
    assert np.allclose(other.mean, found.mean, atol=1e-6) and np.allclose(other.step, found.step, atol=1e-6)


def test_nothing_to_fit_on(spark):
    with pytest.raises(ValueError, match="nothing to fit"):
        hmm.fit(hmm.cut_blocks(spark.createDataFrame([], "subject string, ch string, n long, x double")))
    with pytest.raises(ValueError, match="nothing to fit"):
        hmm.fit(hmm.cut_blocks(spark.createDataFrame([("s", "a", 0, None), ("s", "a", 1, float("inf"))], "subject string, ch string, n long, x double")))
