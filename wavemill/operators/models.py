"""Classifiers on pyspark.ml (forests, logistic regression, kernel machines on random Fourier features, neighbours) and
grid search over stratified folds."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.operators.evaluation import metrics, roc_auc, stratified_folds
from wavemill.operators.machines import Map, MappedMachines, PairwiseMachines, PolynomialMap, scale_of
from wavemill.operators.neighbours import k_nearest, votes
from wavemill.operators.ranks import numbered
from wavemill.plans.shared import written


def vectors(rows: DataFrame, xs: str = "xs") -> DataFrame:
    return rows.withColumn("features", array_to_vector(F.col(xs).cast("array<double>")))


def fourier_map(n: int, gamma: float, dim: int, seed: int = 42) -> Map:
    r = np.random.default_rng(seed)
    w, b = r.standard_normal((dim, n)) * np.sqrt(2 * gamma), r.uniform(0, 2 * np.pi, n)
    return lambda x: np.sqrt(2 / n) * np.cos(x @ w + b)


def random_features(rows: DataFrame, n: int, gamma: float, dim: int, seed: int = 42) -> DataFrame:
    """Random Fourier features of xs: an inner product of them approximates exp(-gamma |x - y|^2), so a linear machine
    on them stands in for one with that kernel."""
    fourier = fourier_map(n, gamma, dim, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("xs").to_pylist(), float).reshape(-1, dim)
            at = batch.schema.get_field_index("xs")
            yield batch.set_column(at, "xs", pa.array(list(fourier(x)), pa.list_(pa.float64())))

    plain = rows.withColumn("xs", F.col("xs").cast("array<double>"))
    return plain.mapInArrow(run, plain.schema)


class KernelMap(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Random Fourier features of ``features``; gamma 0 means 1 / (dimensions x variance), a negative one 1 / dimensions."""

    gamma = Param(Params._dummy(), "gamma", "width of the kernel exp(-gamma |x - y|^2)", TypeConverters.toFloat)
    n = Param(Params._dummy(), "n", "number of features", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)

    def __init__(self, gamma: float = 0.0, n: int = 512, seed: int = 42):
        super().__init__()
        self._set(gamma=gamma, n=n, seed=seed)

    def _fit(self, rows: DataFrame) -> KernelMapModel:
        gamma, dim = scale_of(rows, self.getOrDefault("gamma"))
        return KernelMapModel(gamma, self.getOrDefault("n"), self.getOrDefault("seed"), dim)


class KernelMapModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    gamma, n, seed = KernelMap.gamma, KernelMap.n, KernelMap.seed
    dim = Param(Params._dummy(), "dim", "dimensions", TypeConverters.toInt)

    def __init__(self, gamma: float = 1.0, n: int = 512, seed: int = 42, dim: int = 1):
        super().__init__()
        self._set(gamma=gamma, n=n, seed=seed, dim=dim)

    def sketch(self) -> Map:
        return fourier_map(*(self.getOrDefault(p) for p in ("n", "gamma", "dim", "seed")))

    def _transform(self, rows: DataFrame) -> DataFrame:
        n, gamma, dim, seed = (self.getOrDefault(p) for p in ("n", "gamma", "dim", "seed"))
        marked = rows.withColumn("xs", vector_to_array("features")) if "xs" not in rows.columns else rows.withColumn("_xs", F.col("xs")).withColumn("xs", vector_to_array("features"))
        kept = [c for c in marked.columns if c not in ("features", "xs")]
        mapped = random_features(marked.select("xs", F.struct(*kept, F.col("features")).alias("row")), n, gamma, dim, seed)
        out = mapped.select("row.*", array_to_vector("xs").alias("fourier"))
        return out.withColumnRenamed("_xs", "xs") if "_xs" in out.columns else out


class Neighbours(Estimator):
    """k nearest neighbours as a model; rows need an ``id`` and ``xs``."""

    def __init__(self, n_neighbors: int = 5, weights: str = "uniform"):
        super().__init__()
        self.n_neighbors, self.weights = n_neighbors, weights

    def _fit(self, rows: DataFrame) -> NeighboursModel:
        return NeighboursModel(rows.select("id", "label", "xs"), self.n_neighbors, self.weights)


class NeighboursModel(Model):
    def __init__(self, train: DataFrame, n_neighbors: int, weights: str):
        super().__init__()
        self.train, self.n_neighbors, self.weights = train, n_neighbors, weights

    def _transform(self, rows: DataFrame) -> DataFrame:
        """Adds prediction, and probability: a vector with a place for each label from 0 to the greatest seen."""
        return self.voted(rows, k_nearest(self.train, rows, self.n_neighbors))

    def voted(self, rows: DataFrame, near: DataFrame) -> DataFrame:
        """As transform, from the rows' nearest neighbours (id, near), of which there may be more than this model asks for."""
        most = self.train.agg(F.max("label")).first()[0]
        got = votes(near.select("id", F.slice("near", 1, self.n_neighbors).alias("near")), self.weights)
        share = lambda k: F.coalesce(F.try_element_at("votes", F.lit(k)) / F.col("total"), F.lit(0.0))
        shares = F.array(*(share(k) for k in range(max(1, int(most or 0)) + 1)))
        known = got.select("id", F.col("prediction").cast("double").alias("prediction"), array_to_vector(shares).alias("probability"))
        return rows.drop("prediction", "probability").join(known, "id", "left")


class CountedLogisticRegression(Estimator):
    """Logistic regression whose C weighs the sum of the losses of the rows it is fitted on, whatever their number."""

    def __init__(self, C: float | None = None, **params):  # noqa: N803
        super().__init__()
        self.c, self.given = C, params

    def _fit(self, rows: DataFrame) -> LogisticRegressionModel:
        penalty = 1 / (self.c * max(1, rows.count())) if self.c else 0.0
        return LogisticRegression(regParam=penalty, elasticNetParam=0.0, standardization=False, **self.given).fit(rows)


#: Names of gamma as numbers: measured from the variance, or by the dimensions alone.
GAMMAS = {"scale": 0.0, "auto": -1.0}


def create(name: str, seed: int = 42, n_rows: int | None = None, **params):
    """A classifier by name and by the usual names of its parameters; C weighs the losses of the rows a model is fitted on.

    svm (C, kernel rbf, poly or linear, gamma, degree, coef0, n_features, maxIter): machines for all pairs of classes, with
    probabilities, on random Fourier features or a tensor sketch for the kernel. random_forest (n_estimators, max_depth), knn
    (n_neighbors, weights) and logistic_regression (C). ``n_rows`` isn't needed.
    """
    if name == "svm":
        kernel, gamma = params.pop("kernel", "rbf"), params.pop("gamma", "scale")
        if kernel not in ("rbf", "poly", "linear"):
            raise ValueError(f"unknown kernel {kernel}")
        gamma = GAMMAS[gamma] if gamma in GAMMAS else float(gamma)
        n, degree, coef0 = params.pop("n_features", 512 if kernel == "rbf" else 1024), params.pop("degree", 3), params.pop("coef0", 0.0)
        machines = PairwiseMachines(params.pop("C", 1.0), featuresCol={"rbf": "fourier", "poly": "sketch", "linear": "features"}[kernel], **params)
        if kernel == "linear":
            return Pipeline(stages=[machines])
        return MappedMachines(KernelMap(gamma, n, seed) if kernel == "rbf" else PolynomialMap(gamma, coef0, degree, n, seed), machines)
    if name == "random_forest":
        depth = {"maxDepth": params.pop("max_depth")} if params.get("max_depth") is not None else {}
        params.pop("max_depth", None)
        return RandomForestClassifier(seed=seed, numTrees=params.pop("n_estimators", 100), **depth, **params)
    if name == "knn":
        return Neighbours(**params)
    if name == "logistic_regression":
        return CountedLogisticRegression(params.pop("C", None), maxIter=params.pop("max_iter", 100), **params)
    raise ValueError(f"unknown model {name}")


#: Models of a grid that are trained at once.
AT_ONCE = 8


def train_one(rows: DataFrame, name: str, grid: dict[str, list] | None = None, k: int = 5, seed: int = 42):
    """Grid search by stratified k-fold accuracy, refitted on all rows: (model, cross-validation accuracy, parameters).

    The folds are written once, so they have as many partitions as their size asks for. ``AT_ONCE`` choices and folds are
    trained at once; the first of equal choices wins. Neighbours are looked for once for each fold, for the greatest number.
    """
    folded = written(stratified_folds(rows, "id", "label", k, seed), "folds")
    n = folded.count()
    judge = MulticlassClassificationEvaluator(metricName="accuracy")
    choices = [dict(zip(grid or {}, values)) for values in product(*(grid or {}).values())]
    train, test = (lambda fold: folded.where(F.col("fold") != fold)), (lambda fold: folded.where(F.col("fold") == fold))
    most = max((create("knn", **params).n_neighbors for params in choices), default=1) if name == "knn" else 0

    def neighbours(fold: int) -> DataFrame:
        return written(k_nearest(train(fold), test(fold), most), "fold-neighbours")

    def fold_score(of: tuple[dict, int]) -> float:
        params, fold = of
        model = create(name, seed, n, **params).fit(train(fold))
        return judge.evaluate(model.voted(test(fold), near[fold]) if most else model.transform(test(fold)))

    with ThreadPool(AT_ONCE) as pool:
        own_job = inheritable_thread_target(folded.sparkSession)
        near = pool.map(own_job(neighbours), range(k)) if most else []
        scores = pool.map(own_job(fold_score), [(params, fold) for params in choices for fold in range(k)], 1)
    scored = [(float(np.mean(scores[i * k : (i + 1) * k])), params) for i, params in enumerate(choices)]
    best, params = max(scored, key=lambda s: s[0])
    return create(name, seed, n, **params).fit(folded.drop("fold")), best, params


def train_models(rows: DataFrame, specs: dict[str, dict], k: int = 5, seed: int = 42) -> dict:
    """Train every configured model; a model's failure is recorded and doesn't stop the others; the best has the highest
    cross-validation accuracy (the first of equals)."""
    out: dict = {"models": {}, "best": None}
    for name, grid in specs.items():
        try:
            model, score, params = train_one(rows, name, grid, k, seed)
            out["models"][name] = {"model": model, "cv_score": score, "best_params": params}
            if out["best"] is None or score > out["models"][out["best"]]["cv_score"]:
                out["best"] = name
        except Exception as e:  # noqa: BLE001  a model that can't be trained is a result
            out["models"][name] = {"error": str(e)}
    return out


def evaluate(model, rows: DataFrame) -> DataFrame:
    """Metrics of a fitted model on rows it may not have seen, with the AUC where there are two classes."""
    pred = model.transform(rows).withColumn("prediction", F.col("prediction").cast("int"))
    out = metrics(pred)
    if "probability" in pred.columns:
        out = out.crossJoin(roc_auc(pred.withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))))
    return out


def feature_importance(model, names: list[str]) -> list[tuple[str, float]]:
    """(feature, importance), largest first: tree importances or absolute coefficients."""
    if hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray()
    elif hasattr(model, "coefficients"):
        values = np.abs(model.coefficients.toArray())
    else:
        return []
    return sorted(zip(names, map(float, values)), key=lambda x: (-x[1], x[0]))


def permutation_importance(model, rows: DataFrame, index: int, seed: int = 42) -> float:
    """Loss of accuracy when component ``index`` of xs comes from another row (rows are matched in a seeded order)."""
    base = metrics(model.transform(vectors(rows)).withColumn("prediction", F.col("prediction").cast("int"))).first()["accuracy"]
    n = rows.count()
    order = rows.select("id", F.get("xs", F.lit(index)).alias("v"), F.xxhash64("id", F.lit(seed)).alias("h"))
    other = numbered(order, ["h", "id"]).select("number", "v").join(numbered(rows.select("id"), ["id"]), "number").select("id", "v")
    mixed = rows.join(other, "id").withColumn("xs", F.transform("xs", lambda x, i: F.when(i == index, F.col("v")).otherwise(x))).drop("v")
    shuffled = metrics(model.transform(vectors(mixed)).withColumn("prediction", F.col("prediction").cast("int"))).first()["accuracy"]
    return base - shuffled if n else 0.0


def knn_predict(train: DataFrame, queries: DataFrame, k: int = 5, weights: str = "uniform") -> DataFrame:
    """(id, prediction): the class with most votes among the k nearest, the least class of equals; rows with the query's
    own id are left out."""
    return votes(k_nearest(train, queries, k), weights).select("id", "prediction")


def save_models(results: dict, path: str) -> None:
    """Each model in its own folder (of neighbours: their rows), and what is known of them as JSON, all written by Spark."""
    spark, info = SparkSession.active(), {"best": results["best"], "models": {}}
    for name, r in results["models"].items():
        info["models"][name] = {k: v for k, v in r.items() if k != "model"}
        if isinstance(r.get("model"), NeighboursModel):
            r["model"].train.write.mode("overwrite").parquet(f"{path}/{name}")
            info["models"][name] |= {"n_neighbors": r["model"].n_neighbors, "weights": r["model"].weights}
        elif "model" in r:
            r["model"].write().overwrite().save(f"{path}/{name}")
    spark.createDataFrame([(json.dumps(info),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/models.json")


def load_models(path: str) -> dict:
    spark = SparkSession.active()
    kinds = {"svm": PipelineModel, "random_forest": RandomForestClassificationModel, "logistic_regression": LogisticRegressionModel}
    info = json.loads(spark.read.text(f"{path}/models.json").first()["value"])
    for name, r in info["models"].items():
        if name == "knn" and "error" not in r:
            r["model"] = NeighboursModel(spark.read.parquet(f"{path}/{name}"), r["n_neighbors"], r["weights"])
        elif "error" not in r:
            r["model"] = kinds[name].load(f"{path}/{name}")
    return info


def model_of(results: dict, name: str | None = None):
    """The named model of ``train_models``, or the best; ValueError where there is none, or where it wasn't trained."""
    name = name or results["best"]
    if name is None:
        raise ValueError("no model has been trained")
    if "model" not in results["models"].get(name, {}):
        raise ValueError(f"model {name} has not been trained")
    return results["models"][name]["model"]


def predict(results: dict, rows: DataFrame, name: str | None = None) -> DataFrame:
    """rows with prediction and, by class, probability of the named or the best model."""
    return model_of(results, name).transform(rows)


def summary_table(spark: SparkSession, results: dict) -> DataFrame:
    """One row for each configured model: its accuracy in cross-validation, parameters, whether it is the best, its error."""
    rows = [(n, r.get("cv_score"), json.dumps(r.get("best_params", {}), sort_keys=True), results["best"] == n, r.get("error")) for n, r in results["models"].items()]
    return spark.createDataFrame(rows, "model string, cv_score double, params string, best boolean, error string")


def summary(results: dict) -> dict:
    return {"best": results["best"], "scores": {n: r.get("cv_score") for n, r in results["models"].items()}}
