"""Evaluation in SQL terms: folds, splits, confusion counts, AUC, nearest neighbours, labels from questionnaires."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Score from which dependence counts as high for the label, and the levels' first scores.
LABEL_FROM = 6
LEVELS = [("low", 0, 3), ("moderate", 4, 6), ("high", 7, 10)]
#: Items of the three impulsiveness subscales; each item is 1 to 4.
SUBSCALES = {"attention_impulsiveness": 8, "motor_impulsiveness": 11, "non_planning_impulsiveness": 11}


def stratified_folds(rows: DataFrame, key: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """fold 0..k-1, each with an equal share of each class to within one row; the order is a seeded hash of the key.

    A class is numbered in parts: rows fall into hashed ranges, ranges are counted, and a row's number is the count of
    the ranges before its own plus its place in the range, so no class is sorted in one task.
    """
    h = F.xxhash64(F.col(key), F.lit(seed))
    parts = rows.withColumn("_h", h).withColumn("_part", F.pmod(F.shiftright("_h", 40), F.lit(64)))
    size = parts.groupBy(label, "_part").agg(F.count("*").alias("_n"))
    before = size.select(label, "_part", F.coalesce(F.sum("_n").over(Window.partitionBy(label).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(label, "_part").orderBy("_h", key)) - 1
    return parts.withColumn("_place", place).join(F.broadcast(before), [label, "_part"]).withColumn("fold", F.pmod(F.col("_place") + F.col("_before"), F.lit(k)).cast("int")).drop("_h", "_part", "_place", "_before")


def train_test_split(rows: DataFrame, key: str, label: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """split is test for one row in 1 / test_share of each class, train for the rest."""
    k = max(2, round(1 / test_share))
    return stratified_folds(rows, key, label, k, seed).withColumn("split", F.when(F.col("fold") == 0, "test").otherwise("train")).drop("fold")


def class_distribution(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(label).agg(F.count("*").alias("n"))


def with_default_label(rows: DataFrame, labels: DataFrame, key: str, label: str, default: int = 0) -> DataFrame:
    """Left join; a missing label is the default."""
    return rows.join(labels.select(key, label), key, "left").withColumn(label, F.coalesce(label, F.lit(default)))


def dependence_label(score: Column) -> Column:
    """1 from LABEL_FROM on, else 0; a missing score counts as 0."""
    return F.when(F.coalesce(score, F.lit(0)) >= LABEL_FROM, 1).otherwise(0)


def dependence_level(score: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, lo, hi in LEVELS:
        out = F.when(score.between(lo, hi), F.lit(name)).otherwise(out)
    return out


def subscale_scores(answers: DataFrame, items: dict[str, list[str]]) -> DataFrame:
    """Sums of each subscale's item columns, the total, and whether all items lie in 1..4."""
    every = [c for cols in items.values() for c in cols]
    sums = [sum((F.col(c) for c in cols[1:]), F.col(cols[0])).cast("long").alias(name) for name, cols in items.items()]
    total = sum((F.col(c) for c in every[1:]), F.col(every[0])).cast("long")
    valid = F.lit(True)
    for c in every:
        valid = valid & F.coalesce(F.col(c).between(1, 4), F.lit(False))
    return answers.select("subject", *sums, total.alias("total"), valid.alias("valid"))


def confusion(pred: DataFrame, truth: str = "label", guess: str = "prediction") -> DataFrame:
    return pred.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count("*").alias("n"))


def metrics(pred: DataFrame, truth: str = "label", guess: str = "prediction") -> DataFrame:
    """accuracy, balanced accuracy, and precision, recall and F1 weighted by class; undefined ratios are 0."""
    c = confusion(pred, truth, guess)
    classes = c.groupBy(F.col("truth").alias("c")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)).alias("hit"))
    guessed = c.groupBy(F.col("guess").alias("c")).agg(F.sum("n").alias("guessed"))
    p, r = F.coalesce(F.try_divide("hit", "guessed"), F.lit(0.0)), F.try_divide("hit", "support")
    rows = classes.join(guessed, "c", "left").withColumn("p", p).withColumn("r", r).withColumn("f", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))
    w = lambda x: F.sum(F.col(x) * F.col("support")) / F.sum("support")
    return rows.agg((F.sum("hit") / F.sum("support")).alias("accuracy"), F.avg("r").alias("balanced_accuracy"), w("p").alias("precision"), w("r").alias("recall"), w("f").alias("f1"))


#: Ranges of scores whose counts are added up one after the other.
SCORE_RANGES = 256


def roc_auc(pred: DataFrame, truth: str = "label", score: str = "score") -> DataFrame:
    """Area under the curve with ties counted half, from counts by distinct score; null with one class only.

    Distinct scores are split into ranges at approximate quantiles; what lies below a score is what lies in the ranges
    before, of which there are few, and below it in its own.
    """
    by = pred.groupBy(F.col(score).alias("score")).agg(F.sum(F.when(F.col(truth) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(truth) == 1, 0).otherwise(1)).alias("neg"))
    bounds = by.agg(F.percentile_approx("score", [k / SCORE_RANGES for k in range(1, SCORE_RANGES)], 10 * SCORE_RANGES).alias("q")).first()["q"] or []
    splits = [float("-inf"), *sorted({float(q) for q in bounds}), float("inf")]
    cast = by.withColumn("score", F.col("score").cast("double"))
    rows = Bucketizer(splits=splits, inputCol="score", outputCol="part", handleInvalid="keep").transform(cast) if len(splits) > 2 else cast.withColumn("part", F.lit(0.0))
    before = lambda w: F.coalesce(F.sum("neg").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = rows.groupBy("part").agg(F.sum("neg").alias("neg")).select("part", before(Window.orderBy("part")).alias("lower"))  # at most SCORE_RANGES rows
    placed = rows.withColumn("inside", before(Window.partitionBy("part").orderBy("score"))).join(ranges, "part")
    below = F.col("lower") + F.col("inside")
    return placed.agg(F.try_divide(F.sum(F.col("pos") * (below + F.col("neg") / 2)), F.sum("pos") * F.sum("neg").cast("double")).alias("auc"))


def best_model(results: DataFrame, by: str = "accuracy") -> DataFrame:
    """The row of the greatest value; the first name of equals."""
    return results.orderBy(F.desc(by), F.asc("model")).limit(1)


def importance_table(importance: DataFrame) -> DataFrame:
    return importance.orderBy(F.desc("importance"), F.asc("feature"))


def knn(train: DataFrame, queries: DataFrame, k: int = 5, weights: str = "uniform") -> DataFrame:
    """prediction of each query (id, xs) by its k nearest training rows (id, xs, label), ties by id; itself is left out.

    Blocks of queries meet blocks of training rows through a shuffle; nothing is collected or broadcast.
    """
    from wavemill.operators.models import knn_predict

    return knn_predict(train, queries, k, weights)
