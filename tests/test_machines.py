"""Machines for pairs of classes: kernels, several classes, probabilities, and their agreement with plain programs."""

import numpy as np
import pytest

from wavemill.operators import machines, models


def frame(spark, x, y):
    rows = [(k, int(c), [float(v) for v in row]) for k, (row, c) in enumerate(zip(x, y))]
    return models.vectors(spark.createDataFrame(rows, "id long, label int, xs array<double>").repartition(3))


def test_sketch_follows_the_kernel(spark):
    x = np.random.default_rng(1).normal(size=(40, 5))
    for degree, coef0 in ((2, 0.0), (3, 1.0)):
        z = machines.PolynomialMapModel(0.3, coef0, degree, 1 << 15, 7, 5).sketch()(x)
        k = (0.3 * x @ x.T + coef0) ** degree
        assert np.abs(z @ z.T - k).max() < 0.06 * np.abs(k).max()


def test_coupling_gives_back_probabilities():
    p = np.random.default_rng(2).dirichlet(np.ones(4), 50)
    r = np.stack([p[:, a] / (p[:, a] + p[:, b]) for a, b in machines._pairs(4)], axis=1)
    assert np.allclose(machines.coupled(r, 4), p, atol=1e-6)


def test_minimiser_finds_the_least():
    r = np.random.default_rng(3)
    a = r.normal(size=(30, 8))
    m, t = a.T @ a + np.eye(8), r.normal(size=8)
    x = machines.minimise(lambda v: (0.5 * v @ m @ v - t @ v, m @ v - t), np.zeros(8), 200, 1e-10)
    assert np.allclose(m @ x, t, atol=1e-6)


def plain_machine(k, y, c):
    """Squared-hinge kernel machine by gradient steps on the dual coefficients; gives the decision values."""
    a, b = np.zeros(len(y)), 0.0
    value = lambda a, b: 0.5 * a @ k @ a + c * (np.maximum(0, 1 - y * (k @ a + b)) ** 2).sum()

    def fn(v):
        a, b = v[:-1], v[-1]
        short = np.maximum(0, 1 - y * (k @ a + b))
        d = -2 * c * short * y
        return value(a, b), np.concatenate([k @ (a + d), [d.sum()]])

    v = machines.minimise(fn, np.concatenate([a, [b]]), 3000, 1e-9)
    return k @ v[:-1] + v[-1]


@pytest.mark.parametrize("gamma", ["scale", "auto"])
def test_polynomial_machine_on_ten_classes_against_plain_ones(spark, gamma):
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(c, 0.5, (12, 3)) for c in r.normal(0, 2, (10, 3))])
    y = np.repeat(np.arange(10), 12)
    df = frame(spark, x, y)
    model = models.create("svm", kernel="poly", gamma=gamma, degree=2, coef0=1.0, C=1.0, n_features=4096, maxIter=300).fit(df)
    got = {row["id"]: row for row in model.transform(df).collect()}
    g = 1 / (3 * x.var()) if gamma == "scale" else 1 / 3
    k = (g * x @ x.T + 1) ** 2
    votes = np.zeros((120, 10))
    for a, b in machines._pairs(10):
        on = np.isin(y, (a, b))
        side = np.where(y[on] == a, 1.0, -1.0)
        # decision values of all rows by the representer of this pair's machine
        alpha = np.linalg.lstsq(k[np.ix_(on, on)] + 1e-9 * np.eye(on.sum()), plain_machine(k[np.ix_(on, on)], side, 1.0), rcond=None)[0]
        f = k[:, on] @ alpha
        votes[np.arange(120), np.where(f >= 0, a, b)] += 1
    guess = np.array([got[i]["prediction"] for i in range(120)])
    assert (guess == votes.argmax(axis=1)).mean() > 0.93
    assert (guess == y).mean() > 0.85
    p = np.array([got[i]["probability"].toArray() for i in range(120)])
    assert p.shape == (120, 10) and np.allclose(p.sum(axis=1), 1) and (p.argmax(axis=1) == guess).mean() > 0.85


def test_linear_machine_equals_a_plain_one(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(80, 4))
    y = (x @ [1.0, -2, 0.5, 0] + 0.3 * r.normal(size=80) > 0.2).astype(int)
    model = machines.PairwiseMachines(C=0.5, maxIter=500).fit(frame(spark, x, y))
    f = x @ np.array(model.getOrDefault("weights")) + model.getOrDefault("intercepts")[0]
    assert np.allclose(f, plain_machine(x @ x.T, np.where(y == 0, 1.0, -1.0), 0.5), atol=0.02)


def test_odd_labels_saved_and_loaded(spark, tmp_path):
    x = np.concatenate([np.random.default_rng(6).normal(c, 0.3, (20, 2)) for c in ((0, 0), (3, 0), (0, 3))])
    df = frame(spark, x, np.repeat([2, 5, 7], 20))
    got = models.train_models(df, {"svm": {"C": [1.0], "n_features": [64]}, "knn": {"n_neighbors": [3]}, "none": {}}, k=2)
    assert models.predict(got, df, "svm").where("prediction = label").count() == 60
    knn = models.predict(got, df, "knn").first()["probability"]
    assert len(knn) == 8 and abs(sum(knn.toArray()) - 1) < 1e-9
    for name in ("none", "other"):
        with pytest.raises(ValueError, match="not been trained"):
            models.predict(got, df, name)
    with pytest.raises(ValueError, match="no model"):
        models.predict({"best": None, "models": {}}, df)
    rows = {r["model"]: r for r in models.summary_table(spark, got).collect()}
    assert rows["none"]["error"] and not rows["svm"]["error"] and sum(r["best"] for r in rows.values()) == 1
    models.save_models(got, str(tmp_path / "m"))
    back = models.load_models(str(tmp_path / "m"))
    a, b = ({r["id"]: (r["prediction"], r["probability"]) for r in models.predict(z, df, "svm").collect()} for z in (got, back))
    assert a == b
    with pytest.raises(ValueError, match="two classes"):
        machines.PairwiseMachines().fit(df.where("label = 2"))


def test_logistic_regression_counts_its_rows(spark):
    r = np.random.default_rng(7)
    x = r.normal(size=(60, 2))
    df = frame(spark, x, (x[:, 0] + r.normal(size=60) > 0).astype(int))
    a, b = (models.create("logistic_regression", n_rows=n, C=1.0).fit(df).coefficients for n in (None, 999))
    assert np.allclose(a, b)


def test_few_rows_are_summed_in_few_partitions(spark):
    rows = models.vectors(spark.createDataFrame([(i, i % 2, [float(i), 1.0]) for i in range(100)], "id long, label int, xs array<double>").repartition(40))
    summed = machines._Summed(rows, "features", [0.0, 1.0], 200)
    try:
        assert summed.rdd.getNumPartitions() == 1
        assert summed.over(lambda y, z: np.array([len(y), z[:, 0].sum()])).tolist() == [100, 4950]
    finally:
        summed.close()


def test_a_grid_of_neighbours_looks_for_them_once_a_fold(spark, monkeypatch):
    r = np.random.default_rng(2)
    rows = models.vectors(spark.createDataFrame([(i, int(x[0] + 0.3 * x[1] > 0), x) for i, x in enumerate(r.standard_normal((90, 2)).tolist())], "id long, label int, xs array<double>"))
    asked, real = [], models.k_nearest
    monkeypatch.setattr(models, "k_nearest", lambda *a: asked.append(a[2]) or real(*a))
    grid = {"n_neighbors": [1, 5], "weights": ["uniform", "distance"]}
    _, best, params = models.train_one(rows, "knn", grid, k=3)
    assert asked == [5, 5, 5]
    folded = models.stratified_folds(rows, "id", "label", 3, 42).persist()
    judge = models.MulticlassClassificationEvaluator(metricName="accuracy")
    each = {}
    for n in (1, 5):
        for w in ("uniform", "distance"):
            each[n, w] = np.mean([judge.evaluate(models.create("knn", n_neighbors=n, weights=w).fit(folded.where(f"fold <> {f}")).transform(folded.where(f"fold = {f}"))) for f in range(3)])
    assert best == pytest.approx(max(each.values())) and best == pytest.approx(each[params["n_neighbors"], params["weights"]])


def test_sigmoids_read_margins_and_not_features(spark, monkeypatch):
    r = np.random.default_rng(5)
    y = r.integers(0, 3, 120)
    rows = frame(spark, r.standard_normal((120, 4)) + y[:, None], y)
    seen, real = [], machines._sigmoids
    monkeypatch.setattr(machines, "_sigmoids", lambda m, *a: seen.append(m.rdd.map(lambda b: len(b[1]) / len(b[0])).collect()) or real(m, *a))
    machines.PairwiseMachines().fit(rows)
    assert seen and set(seen[0]) == {3 * 8 / 4}


def test_each_row_is_minimised_by_itself_and_left_alone_at_rest():
    scales = [1.0, 100.0, 1e4]
    a = [np.diag(np.linspace(1, s, 6)) for s in scales]
    t, asked = np.arange(18.0).reshape(3, 6) + 1, []

    def fn(v, which):
        asked.append(len(which))
        return np.array([0.5 * r @ a[i] @ r - t[i] @ r for r, i in zip(v, which)]), np.array([a[i] @ r - t[i] for r, i in zip(v, which)])

    x = machines.minimise_each(fn, np.zeros((3, 6)), 300, 1e-10)
    assert np.allclose([m @ r for m, r in zip(a, x)], t, atol=1e-5)
    assert asked[0] == 3 and asked[-1] < 3


def test_few_passes_over_the_rows_whatever_their_features_scales(spark, monkeypatch):
    r = np.random.default_rng(8)
    y = r.integers(0, 4, 400)
    x = (r.standard_normal((400, 12)) + 0.5 * r.standard_normal((4, 12))[y]) * np.geomspace(0.1, 30, 12)
    passes, real = [], machines._Summed.over
    monkeypatch.setattr(machines._Summed, "over", lambda self, *a: passes.append(0) or real(self, *a))
    monkeypatch.setattr(machines, "_sigmoids", lambda m, sides, counts: (np.ones(6), np.zeros(6)))
    model = machines.PairwiseMachines(maxIter=500).fit(frame(spark, x, y))
    assert len(passes) <= 30
    w, b = np.array(model.getOrDefault("weights")).reshape(6, 12), model.getOrDefault("intercepts")
    for p, (i, j) in enumerate(machines._pairs(4)):
        on = np.isin(y, (i, j))
        side = np.where(y[on] == i, 1.0, -1.0)
        value = lambda f, q: 0.5 * q + (np.maximum(0, 1 - side * f) ** 2).sum()
        z = x[on]

        def fn(v):
            d = -2 * np.maximum(0, 1 - side * (z @ v[:-1] + v[-1])) * side
            return value(z @ v[:-1] + v[-1], v[:-1] @ v[:-1]), np.append(v[:-1] + z.T @ d, d.sum())

        least = fn(machines.minimise(fn, np.zeros(13), 5000, 1e-9))[0]
        assert value(z @ w[p] + b[p], w[p] @ w[p]) <= least * (1 + 1e-4)


@pytest.mark.parametrize("kernel", ["poly", "rbf"])
def test_mapped_rows_are_not_kept_and_give_the_same_machines(spark, monkeypatch, kernel):
    r = np.random.default_rng(9)
    y = r.integers(0, 3, 700)
    rows = frame(spark, r.standard_normal((700, 5)) + 0.3 * y[:, None], y)
    wide, real = [], machines._Summed.__init__

    def init(self, *a):
        real(self, *a)
        wide.extend(self.rdd.map(lambda b: (len(b[1]) // 8) / (len(b[0]) // 4)).collect())

    monkeypatch.setattr(machines._Summed, "__init__", init)
    got = models.create("svm", kernel=kernel, n_features=64).fit(rows).stages
    assert set(wide) == {5}
    apart = machines.PairwiseMachines(featuresCol=got[1].getOrDefault("featuresCol")).fit(got[0].transform(rows))
    for name in ("weights", "intercepts", "slopes", "shifts"):
        assert np.allclose(got[1].getOrDefault(name), apart.getOrDefault(name), atol=1e-3)
