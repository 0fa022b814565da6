"""Explanations of fitted models: exact Shapley values of a forest's predictions, and local linear surrogates of any model.

Shapley values follow the trees' own weights (a feature that isn't known goes down both ways, by the rows that went there when the
tree was grown). A leaf's part is found without going over sets of features: with m features on its path, each with a share z
of rows that pass its splits and an answer o whether this row passes them, the part of a feature is v (o - z) times a sum over
sizes k of the k-th coefficient of the product of (z' + o' y) over the other features, weighted k! (m - k - 1)! / m!. All rows of
an Arrow batch go through a leaf at once. The trees are small next to the data and go to every task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.operators.models import vectors
from wavemill.plans.shared import shared_dir


@dataclass
class Leaf:
    """A path: for each of its features the interval of values that pass and the share of rows that do; the leaf's value."""

    features: list[int]
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: float
    reached: float


def forest_leaves(model, target: int = 1) -> list[list[Leaf]]:
    """The leaves of each tree of a fitted forest, their values the shares of class ``target``; only numeric splits are read."""
    spark = SparkSession.active()
    path = shared_dir(spark, "forest")
    model.write().overwrite().save(path)
    rows = spark.read.parquet(f"{path}/data")
    tree_column = "treeID" if "treeID" in rows.columns else "treeId"
    trees: dict[int, dict[int, dict]] = {}
    for r in rows.select(tree_column, "nodeData.*").collect():
        trees.setdefault(r[tree_column], {})[r["id"]] = r.asDict(recursive=True)
    return [_leaves(nodes, target) for _, nodes in sorted(trees.items())]


def _leaves(nodes: dict[int, dict], target: int) -> list[Leaf]:
    cover = {k: float(sum(n["impurityStats"])) for k, n in nodes.items()}
    out: list[Leaf] = []
    # node, then by feature (low, high, share of rows that pass)
    waiting: list[tuple[int, dict[int, tuple[float, float, float]]]] = [(0, {})]
    while waiting:
        k, path = waiting.pop()
        n = nodes[k]
        if n["leftChild"] < 0:
            on = sorted(path)
            stats = n["impurityStats"]
            value = stats[target] / cover[k] if target < len(stats) and cover[k] else 0.0
            low, high, share = (np.array([path[f][i] for f in on]) for i in range(3))
            out.append(Leaf(on, low, high, share, float(value), cover[k] / cover[0]))
            continue
        split = n["split"]
        if split["numCategories"] >= 0:
            raise ValueError("splits of categories aren't read")
        f, at = split["featureIndex"], float(split["leftCategoriesOrThreshold"][0])
        for child, left in ((n["leftChild"], True), (n["rightChild"], False)):
            low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
            bound = (low, min(high, at)) if left else (max(low, at), high)
            waiting.append((child, {**path, f: (*bound, share * cover[child] / cover[k])}))
    return out


def shapley(leaves: list[list[Leaf]], x: np.ndarray) -> tuple[float, np.ndarray]:
    """(mean prediction, rows x features): parts that, with the mean, add up to each row's prediction."""
    out, base = np.zeros(x.shape), 0.0
    for tree in leaves:
        for leaf in tree:
            base += leaf.value * leaf.reached
            m = len(leaf.features)
            if not m or not leaf.value:
                continue
            v = x[:, leaf.features]
            passed = ((v > leaf.low) & (v <= leaf.high)).astype(float)
            weight = [factorial(k) * factorial(m - k - 1) / factorial(m) for k in range(m)]
            for j, f in enumerate(leaf.features):
                product = np.zeros((m, len(x)))
                product[0] = 1
                for i in range(m):
                    if i != j:
                        product[1:] = product[1:] * leaf.share[i] + product[:-1] * passed[:, i]
                        product[0] *= leaf.share[i]
                out[:, f] += leaf.value * (passed[:, j] - leaf.share[j]) * (weight @ product)
    return base / len(leaves), out / len(leaves)


def _by_batch(rows: DataFrame, fn: Callable[[np.ndarray, list], np.ndarray], keys: str) -> DataFrame:
    """(id, values): fn of the matrix of xs and the ids, an Arrow batch at a time."""
    given = rows.select("id", F.col("xs").cast("array<double>").alias("xs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("xs").to_pylist(), float).reshape(batch.num_rows, -1)
            got = fn(x, batch.column("id").to_pylist()) if len(x) else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(got), pa.list_(pa.float64()))], names=["id", "values"])

    return given.mapInArrow(run, f"id {keys}, values array<double>")


def shapley_values(model, rows: DataFrame, target: int = 1) -> DataFrame:
    """(id, feature number, value, base) of a fitted forest for rows (id, xs); value and base add up to the probability of the
    class. Rows of null xs are left out."""
    leaves = forest_leaves(model, target)
    kind = rows.schema["id"].dataType.simpleString()
    base = shapley(leaves, np.zeros((0, max((f for t in leaves for leaf in t for f in leaf.features), default=0) + 1)))[0]
    values = _by_batch(rows.where("xs is not null"), lambda x, _: shapley(leaves, x)[1], kind)
    return values.select("id", F.posexplode("values").alias("feature", "value"), F.lit(base).alias("base"))


def shapley_importance(values: DataFrame) -> DataFrame:
    """(feature, importance): the mean size of a feature's values."""
    return values.groupBy("feature").agg(F.avg(F.abs("value")).alias("importance"))


# ---- local surrogates ----------------------------------------------------------------------------------------------------


def _spreads(rows: DataFrame) -> np.ndarray:
    got = rows.select(F.posexplode(F.col("xs").cast("array<double>")).alias("k", "v")).groupBy("k").agg(F.stddev_pop("v").alias("sd")).orderBy("k").collect()
    sd = np.array([r["sd"] or 0.0 for r in got])
    return np.where(sd > 0, sd, 1.0)


def local_surrogates(model, rows: DataFrame, target: int = 1, n: int = 500, width: float | None = None, ridge: float = 1.0, seed: int = 42) -> DataFrame:
    """(id, intercept, weights, r2): for each row (id, xs) a ridge regression of the model's probability of a class on seeded normal
    perturbations of the row, in the features' deviations and weighted by nearness exp(-d^2 / width^2).

    Perturbed rows are made by the tasks from a seed of the id's hash, go through the model as rows like any others, and come
    back as products by id (weights x features, so a group is (features + 1)^2 numbers); nothing is gathered by id but those.
    """
    given = rows.where("xs is not null").select("id", F.col("xs").cast("array<double>").alias("xs"))
    sd = _spreads(given)
    d = len(sd)
    wide = width or 0.75 * np.sqrt(d)
    id_kind = rows.schema["id"].dataType.simpleString()
    hashed = given.withColumn("h", F.xxhash64(F.col("id").cast("string"), F.lit(seed)))

    def perturbed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x = np.array(batch.column("xs")[k].as_py())
                z = np.random.default_rng(batch.column("h")[k].as_py() & (2**63 - 1)).standard_normal((n, d))
                z[0] = 0
                ids = pa.array([batch.column("id")[k].as_py()] * n, batch.column("id").type)
                w = np.exp(-(z * z).sum(axis=1) / wide**2)
                yield pa.RecordBatch.from_arrays([ids, pa.array(list(x + z * sd), pa.list_(pa.float64())), pa.array(list(z), pa.list_(pa.float64())), pa.array(w)], names=["id", "xs", "z", "w"])

    made = hashed.mapInArrow(perturbed, f"id {id_kind}, xs array<double>, z array<double>, w double")
    scored = model.transform(vectors(made)).select("id", "z", "w", F.get(vector_to_array("probability"), F.lit(target)).alias("p"))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_pylist()
            z = np.column_stack([np.ones(len(ids)), np.array(batch.column("z").to_pylist()).reshape(len(ids), -1), batch.column("p").to_numpy()]) if ids else np.zeros((0, 1))
            w = batch.column("w").to_numpy()
            starts = [k for k in range(len(ids)) if k == 0 or ids[k] != ids[k - 1]]
            parts = [(z[a:b].T @ (z[a:b] * w[a:b, None])).ravel() for a, b in zip(starts, [*starts[1:], len(ids)])]
            yield pa.RecordBatch.from_arrays([pa.array([ids[a] for a in starts], batch.column("id").type), pa.array([p.tobytes() for p in parts], pa.binary())], names=["id", "g"])

    def solved(key, pdf):
        g = sum(np.frombuffer(v) for v in pdf["g"]).reshape(d + 2, d + 2)
        a, t = g[: d + 1, : d + 1], g[: d + 1, d + 1]
        weights = np.linalg.solve(a + np.diag([0.0] + [ridge] * d), t)
        spread = g[-1, -1] - t[0] ** 2 / a[0, 0]
        left = g[-1, -1] - 2 * weights @ t + weights @ a @ weights
        return pd.DataFrame({"id": [key[0]], "intercept": [weights[0]], "weights": [weights[1:].tolist()], "r2": [float(1 - left / spread) if spread > 1e-15 else 1.0]})

    sums = scored.mapInArrow(products, f"id {id_kind}, g binary")
    return sums.groupBy("id").applyInPandas(solved, f"id {id_kind}, intercept double, weights array<double>, r2 double")
