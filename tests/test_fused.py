"""Quantiles by counted ranges, and the fitted chain of the feature table."""

import numpy as np
import pytest

from wavemill.operators import fused, graph
from wavemill.operators.ranks import quantiles


def test_quantiles_against_numpy(spark):
    r = np.random.default_rng(0)
    x = {"a": r.normal(size=501), "b": np.concatenate([np.full(700, 2.0), r.normal(size=10)]), "c": np.array([4.0])}
    rows = [(k, float(v)) for k in x for v in x[k]] + [("a", None), ("d", None)]
    got = {q["name"]: q["q"] for q in quantiles(spark.createDataFrame(rows, "name string, value double").repartition(5), [0, 0.25, 0.5, 0.9, 1]).collect()}
    assert set(got) == set(x)
    for k in x:
        assert np.allclose(got[k], np.quantile(x[k], [0, 0.25, 0.5, 0.9, 1]))
    assert quantiles(spark.createDataFrame([], "name string, value double"), [0.5]).count() == 0


def table(spark, seed, n, names="abcde"):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        label = i % 2
        for k, c in enumerate(names):
            v = float(r.normal(3 * label * (c in "bd"), 1 + k))
            rows.append((i, c, None if r.random() < 0.1 else v, label))
    return spark.createDataFrame(rows, "id long, name string, value double, label int"), rows


@pytest.mark.parametrize("scaling", ["standard", "minmax", "robust", "none"])
def test_chain_saved_loaded_and_applied(spark, tmp_path, scaling):
    train, rows = table(spark, 1, 80)
    fused.fit(train, fused.Settings(scaling)).save(str(tmp_path / "m"))
    new = spark.createDataFrame([(1, "a", 2.0), (1, "b", None), (1, "zz", 9.0), (2, "c", 1.0)], "id long, name string, value double")
    got = {(q["id"], q["name"]): q["value"] for q in fused.load(spark, str(tmp_path / "m")).apply(new).collect()}
    assert len(got) == 10
    for c in "abcde":
        x = np.array([v for _, n, v, _ in rows if n == c], float)
        fill = np.nanmedian(x)
        x = np.where(np.isnan(x), fill, x)
        q = np.quantile(x, [0.25, 0.5, 0.75])
        shift, spread = {"standard": (x.mean(), x.std()), "minmax": (x.min(), np.ptp(x)), "robust": (q[1], q[2] - q[0]), "none": (0, 1)}[scaling]
        for i, given in ((1, {"a": 2.0}), (2, {"c": 1.0})):
            assert np.isclose(got[i, c], (given.get(c, fill) - shift) / spread)


def test_selection_and_projection(spark, tmp_path):
    train, _ = table(spark, 2, 200)
    for how in ("f_classif", "mutual_info"):
        model = fused.fit(train, fused.Settings("standard", how, 2))
        assert {r["name"] for r in model.facts.where("kept").collect()} == {"b", "d"}
    model = fused.fit(train, fused.Settings("standard", n_components=3))
    model.save(str(tmp_path / "m"))
    parts = fused.load(spark, str(tmp_path / "m")).apply(train).collect()
    y = np.zeros((200, 3))
    for r in parts:
        y[r["id"], int(r["name"].rsplit("_", 1)[1])] = r["value"]
    z = {(r["id"], r["name"]): r["value"] for r in model.scaled(train).collect()}
    x = np.array([[z[i, c] for c in "abcde"] for i in range(200)])
    value, vector = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(np.abs(y), np.abs(x @ vector[:, ::-1][:, :3]), atol=1e-6)
    assert fused.fit(train, fused.Settings(n_components=5)).loadings is None


def test_odd_chains(spark):
    kind = "id long, name string, value double, label int"
    with pytest.raises(ValueError, match="nothing"):
        fused.fit(spark.createDataFrame([], kind))
    with pytest.raises(ValueError, match="unknown scaling"):
        fused.fit(table(spark, 3, 4)[0], fused.Settings("other"))
    with pytest.raises(ValueError, match="unknown selection"):
        fused.fit(table(spark, 3, 4)[0], fused.Settings(selection="rf"))
    rows = [(1, "a", 5.0, 0), (1, "a", 4.0, 0), (2, "a", 4.0, 1), (1, "b", None, 0), (2, "b", None, 1)]
    model = fused.fit(spark.createDataFrame(rows, kind))
    assert [tuple(r) for r in model.apply(spark.createDataFrame(rows, kind)).orderBy("id").collect()] == [(1, "a", 0.0), (2, "a", 0.0)]
    assert model.apply(spark.createDataFrame([], kind)).count() == 0


def test_local_efficiency_of_small_graphs(spark):
    edges = [("full", i, j) for i in "abcd" for j in "abcd" if i < j] + [("star", "a", j) for j in "bcd"] + [("kite", *e) for e in ("ab", "ac", "bc", "cd")]
    g = spark.createDataFrame(edges, "subject string, i string, j string")
    nodes = spark.createDataFrame([(s, v) for s in ("full", "star", "kite", "none") for v in "abcd"], "subject string, node string")
    got = {r["subject"]: round(r["local_efficiency"], 6) for r in graph.local_efficiency(g, nodes).collect()}
    assert got == {"full": 1.0, "star": 0.0, "none": 0.0, "kite": round((1 + 1 + 1 / 3 + 0) / 4, 6)}
