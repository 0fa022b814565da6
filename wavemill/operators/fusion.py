"""Fusion and tabular operators: the long feature store to wide tables, imputation, scaling, reduction and selection.

Long tables are (id, name, value) with ``label`` where a class is needed; statistics of a column are small tables that
are joined back, so a feature's rows are never gathered in one window.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavemill.operators.ranks import quantiles


def flatten(scalars: DataFrame | None, arrays: DataFrame | None) -> DataFrame:
    """Feature records (subject, task, ftype, name, value or values) to (subject, feature, value); arrays get _i suffixes."""
    parts = []
    if scalars is not None:
        parts.append(scalars.select("subject", F.concat_ws("_", "task", "ftype", "name").alias("feature"), F.col("value").cast("double").alias("value")))
    if arrays is not None:
        parts.append(arrays.select("subject", F.concat_ws("_", "task", "ftype", "name").alias("base"), F.posexplode("values").alias("i", "value")).select("subject", F.concat_ws("_", "base", F.col("i").cast("string")).alias("feature"), F.col("value").cast("double").alias("value")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def subjects(*tables: DataFrame) -> DataFrame:
    """The union of the tables' subjects."""
    out = tables[0].select("subject")
    for t in tables[1:]:
        out = out.union(t.select("subject"))
    return out.distinct()


def pivot(long: DataFrame, key: str, name: str = "name", value: str = "value", names: list[str] | None = None) -> DataFrame:
    """One row for each key, one column for each feature; with the names given, no extra pass looks for them."""
    grouped = long.groupBy(key)
    return (grouped.pivot(name, names) if names else grouped.pivot(name)).agg(F.first(value, ignorenulls=True))


def per_task(long: DataFrame, names: list[str] | None = None) -> DataFrame:
    rows = long.withColumn("column", F.concat_ws("_", "ftype", "name"))
    grouped = rows.groupBy("subject", "task")
    return (grouped.pivot("column", names) if names else grouped.pivot("column")).agg(F.first("value", ignorenulls=True))


def impute_median(long: DataFrame, key: str = "name") -> DataFrame:
    """Nulls of a feature become its exact median."""
    m = quantiles(long, [0.5], key).select(key, F.get("q", F.lit(0)).alias("median"))
    return long.join(m, key, "left").withColumn("value", F.coalesce("value", "median")).drop("median")


def mode(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value that isn't null, the least of equals."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("c"))
    return counts.orderBy(F.desc("c"), F.asc(column)).limit(1).select(F.col(column).alias("mode"))


def impute_mode(df: DataFrame, column: str) -> DataFrame:
    return df.join(F.broadcast(mode(df, column)), how="left").withColumn(column, F.coalesce(column, "mode")).drop("mode")


def scale(long: DataFrame, method: str = "standard", key: str = "name") -> DataFrame:
    """standard (population deviation; a constant is only centred), minmax (a constant becomes 0), robust (median and
    quartiles) or none."""
    v = F.col("value")
    if method == "standard":
        s = long.groupBy(key).agg(F.avg("value").alias("a"), F.stddev_pop("value").alias("b"))
        new = (v - F.col("a")) / F.when(F.col("b") > 1e-300, F.col("b")).otherwise(1.0)
    elif method == "minmax":
        s = long.groupBy(key).agg(F.min("value").alias("a"), F.max("value").alias("b"))
        new = F.coalesce(F.try_divide(v - F.col("a"), F.col("b") - F.col("a")), v - v)
    elif method == "robust":
        s = quantiles(long, [0.25, 0.5, 0.75], key)
        new = (v - F.get("q", F.lit(1))) / F.when(F.get("q", F.lit(2)) > F.get("q", F.lit(0)), F.get("q", F.lit(2)) - F.get("q", F.lit(0))).otherwise(1.0)
    else:
        return long
    return long.join(s, key).withColumn("value", new).select(*long.columns)


def fit_pca(wide: DataFrame, columns: list[str], k: int) -> PipelineModel:
    """Assemble and project on k principal components; columns should be centred first (``scale``)."""
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_v", handleInvalid="skip"), PCA(k=k, inputCol="_v", outputCol="_pca")]).fit(wide)


def apply_pca(model: PipelineModel, wide: DataFrame, keep: list[str]) -> DataFrame:
    """Components as pca_component_i, each with the sign that makes its largest loading positive."""
    pc = model.stages[-1].pc.toArray()
    out = vector_to_array(F.col("_pca"))
    sign = [1.0 if pc[abs(pc[:, i]).argmax(), i] >= 0 else -1.0 for i in range(pc.shape[1])]
    return model.transform(wide).select(*keep, *[(out[i] * sign[i]).alias(f"pca_component_{i}") for i in range(pc.shape[1])])


def anova(long: DataFrame) -> DataFrame:
    """F statistic of each feature against the label, from sums by class."""
    per = long.groupBy("name", "label").agg(F.count("value").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    rows = per.groupBy("name").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"))
    between, within = F.col("between") - F.col("s") * F.col("s") / F.col("n"), F.col("ss") - F.col("between")
    return rows.select("name", F.try_divide(between / (F.col("k") - 1), within / (F.col("n") - F.col("k"))).alias("f_score"))


def mutual_information(long: DataFrame, n_bins: int = 10) -> DataFrame:
    """Mutual information (nats) of each feature, in equal bins of its range, and the label."""
    s = long.groupBy("name").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    b = F.coalesce(F.least(F.lit(n_bins - 1), F.floor(F.try_divide((F.col("value") - F.col("lo")) * n_bins, F.col("hi") - F.col("lo"))).cast("int")), F.lit(0))
    joint = long.join(s, "name").groupBy("name", b.alias("b"), "label").agg(F.count("*").alias("c"))
    h = lambda *cols: joint.groupBy("name", *cols).agg(F.sum("c").alias("c")).groupBy("name").agg((F.ln(F.sum("c")) - F.sum(F.col("c") * F.ln("c")) / F.sum("c")).alias("h_" + "_".join(cols)))
    both = h("b").join(h("label"), "name").join(h("b", "label"), "name")
    return both.select("name", (F.col("h_b") + F.col("h_label") - F.col("h_b_label")).alias("mi"))


def select_k(scores: DataFrame, score: str, k: int) -> DataFrame:
    """The k features of the highest scores, with their ranks; ties by name."""
    top = scores.orderBy(F.desc(score), F.asc("name")).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), F.asc("name"))).cast("long"))


def variance_filter(long: DataFrame, least: float) -> DataFrame:
    keep = long.groupBy("name").agg(F.var_pop("value").alias("v")).where(F.col("v") > least).select("name")
    return long.join(keep, "name", "left_semi")


def describe(long: DataFrame) -> DataFrame:
    """count, nulls, mean, sample deviation, extremes and exact quartiles of each feature."""
    rows = long.groupBy("name").agg(F.count("value").alias("count"), F.count_if(F.col("value").isNull()).cast("long").alias("nulls"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    return rows.join(quantiles(long, [0.25, 0.5, 0.75]), "name", "left").select("name", "count", "nulls", "mean", "std", "min", F.get("q", F.lit(0)).alias("q25"), F.get("q", F.lit(1)).alias("q50"), F.get("q", F.lit(2)).alias("q75"), "max")


def prefix_counts(names: DataFrame, column: str = "feature") -> DataFrame:
    """Features by the first two parts of their names."""
    parts = F.split(column, "_")
    return names.select(F.concat_ws("_", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n_features"))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
