"""Shapley values against sums over all sets of features, and local surrogates of known models."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from wavemill.operators import explain, models


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(150, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] + 0.3 * r.normal(size=150) > 0.4)).astype(int)
    df = spark.createDataFrame([(k, int(c), [float(v) for v in row]) for k, (row, c) in enumerate(zip(x, y))], "id long, label int, xs array<double>")
    return models.vectors(df), x


def expectation(tree, x, known):
    """Mean of a tree's leaves where the known features go this row's way and the others as the rows went."""
    total = 0.0
    for leaf in tree:
        w = 1.0
        for f, low, high, share in zip(leaf.features, leaf.low, leaf.high, leaf.share):
            w *= float(low < x[f] <= high) if f in known else share
        total += w * leaf.value
    return total


def test_values_equal_sums_over_all_sets(spark, data):
    df, x = data
    model = models.create("random_forest", n_estimators=6, max_depth=3).fit(df)
    leaves = explain.forest_leaves(model)
    base, got = explain.shapley(leaves, x[:12])
    for i in range(12):
        for j in range(4):
            rest, total = [f for f in range(4) if f != j], 0.0
            for k in range(4):
                for s in combinations(rest, k):
                    gain = np.mean([expectation(t, x[i], {*s, j}) - expectation(t, x[i], set(s)) for t in leaves])
                    total += factorial(k) * factorial(3 - k) / factorial(4) * gain
            assert np.isclose(got[i, j], total, atol=1e-9)
    assert np.isclose(base, np.mean([expectation(t, x[0], set()) for t in leaves]))


def test_values_add_up_to_the_prediction(spark, data):
    df, x = data
    model = models.create("random_forest", n_estimators=20, max_depth=5).fit(df)
    p = {r["id"]: r["p"] for r in model.transform(df).select("id", F.get(vector_to_array("probability"), F.lit(1)).alias("p")).collect()}
    values = explain.shapley_values(model, df.select("id", "xs").repartition(3))
    sums = values.groupBy("id").agg(F.sum("value").alias("s"), F.first("base").alias("b")).collect()
    assert len(sums) == 150 and all(np.isclose(r["s"] + r["b"], p[r["id"]], atol=1e-9) for r in sums)
    order = [r["feature"] for r in explain.shapley_importance(values).orderBy(F.desc("importance")).collect()]
    assert set(order[:2]) == {0, 1}


def test_surrogates_recover_a_known_model(spark, data):
    df, x = data
    y = (2 * x[:, 0] - x[:, 2] > 0).astype(int)
    rows = models.vectors(spark.createDataFrame([(k, int(c), [float(v) for v in row]) for k, (row, c) in enumerate(zip(x, y))], "id long, label int, xs array<double>"))
    model = models.create("logistic_regression", C=0.01).fit(rows)
    some = rows.where("id < 6").select("id", "xs")
    got = {r["id"]: r for r in explain.local_surrogates(model, some, n=800, width=1.0, ridge=1e-6).collect()}
    again = {r["id"]: r for r in explain.local_surrogates(model, some.repartition(5), n=800, width=1.0, ridge=1e-6).collect()}
    c = model.coefficients.toArray() * x.std(axis=0)
    for k in range(6):
        p = 1 / (1 + np.exp(-(model.coefficients.toArray() @ x[k] + model.intercept)))
        w = np.array(got[k]["weights"])
        assert np.corrcoef(w, c * p * (1 - p))[0, 1] > 0.99 and got[k]["r2"] > 0.9
        assert np.allclose(w, again[k]["weights"])


def test_odd_rows(spark, data):
    df, _ = data
    model = models.create("random_forest", n_estimators=2, max_depth=2).fit(df)
    rows = spark.createDataFrame([(1, None), (2, [0.0, 0.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0, 0.0])], "id long, xs array<double>")
    assert explain.shapley_values(model, rows).count() == 8
    assert explain.shapley_values(model, rows.where("id = 1")).count() == 0
