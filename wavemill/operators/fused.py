"""The fitted chain of the feature table: fill missing values, scale, select features, project on principal components.

Fitting gives small tables, one row for each feature (and for each loading); they are saved as Parquet, loaded, and applied to
new rows by joins. Rows are long: (id, name, value), with ``label`` where features are selected.

Cases: null and missing values of a known feature are filled with the fitted median; so each id gets every fitted feature. A feature
without any value when fitting is left out, as are new rows' unknown features. A constant feature is only centred. Repeated values
of one (id, name) give the first that isn't null in value order. An empty table of new rows gives no rows; nothing to fit on raises
ValueError.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.operators import fusion
from wavemill.operators.ranks import quantiles
from wavemill.plans.shared import written


@dataclass(frozen=True)
class Settings:
    """scaling: standard, minmax, robust or none; selection: none, f_classif or mutual_info with the features to keep; components
    of the projection, none where there aren't more features."""

    scaling: str = "standard"
    selection: str = "none"
    n_features: int = 50
    n_components: int = 0


class Fitted:
    """What was fitted: ``facts`` (name, fill, shift, spread, kept) and ``loadings`` (name, component, loading)."""

    def __init__(self, settings: Settings, facts: DataFrame, loadings: DataFrame | None):
        self.settings, self.facts, self.loadings = settings, facts, loadings

    def save(self, path: str) -> None:
        spark = self.facts.sparkSession
        about = json.dumps(asdict(self.settings) | {"projected": self.loadings is not None})
        spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")
        self.facts.write.mode("overwrite").parquet(f"{path}/facts")
        if self.loadings is not None:
            self.loadings.write.mode("overwrite").parquet(f"{path}/loadings")

    def scaled(self, long: DataFrame) -> DataFrame:
        """(id, name, value) of the kept features of every id, filled and scaled."""
        facts = self.facts.where("kept").drop("kept")
        given = long.groupBy("id", "name").agg(F.min("value").alias("value"))
        names = F.array_sort(F.collect_list(F.struct("name", "fill", "shift", "spread"))).alias("facts")
        ids = long.select("id").distinct().withColumn("one", F.lit(1)).join(facts.groupBy(F.lit(1).alias("one")).agg(names), "one")
        every = ids.select("id", F.explode("facts").alias("f")).select("id", "f.*")
        return every.join(given, ["id", "name"], "left").select("id", "name", ((F.coalesce("value", "fill") - F.col("shift")) / F.col("spread")).alias("value"))

    def apply(self, long: DataFrame) -> DataFrame:
        """New rows through the chain: (id, name, value), name a feature or pca_component_i."""
        rows = self.scaled(long)
        if self.loadings is None:
            return rows
        parts = rows.join(self.loadings, "name").groupBy("id", "component").agg(F.sum(F.col("value") * F.col("loading")).alias("value"))
        return parts.select("id", F.concat(F.lit("pca_component_"), F.col("component").cast("string")).alias("name"), "value")


def load(spark: SparkSession, path: str) -> Fitted:
    about = json.loads(spark.read.text(f"{path}/settings").first()["value"])
    projected = about.pop("projected")
    return Fitted(Settings(**about), spark.read.parquet(f"{path}/facts"), spark.read.parquet(f"{path}/loadings") if projected else None)


def _scales(filled: DataFrame, scaling: str) -> DataFrame:
    """name, shift, spread."""
    by_name = filled.groupBy("name")
    if scaling == "standard":
        s = by_name.agg(F.avg("value").alias("shift"), F.stddev_pop("value").alias("spread"))
    elif scaling == "minmax":
        s = by_name.agg(F.min("value").alias("shift"), (F.max("value") - F.min("value")).alias("spread"))
    elif scaling == "robust":
        s = quantiles(filled, [0.25, 0.5, 0.75]).select("name", F.get("q", F.lit(1)).alias("shift"), (F.get("q", F.lit(2)) - F.get("q", F.lit(0))).alias("spread"))
    elif scaling == "none":
        s = by_name.agg(F.lit(0.0).alias("shift"), F.lit(1.0).alias("spread"))
    else:
        raise ValueError(f"unknown scaling {scaling}")
    return s.withColumn("spread", F.when(F.col("spread") > 1e-300, F.col("spread")).otherwise(1.0))


def fit(long: DataFrame, settings: Settings = Settings()) -> Fitted:
    """Fit on rows (id, name, value), with a label for each id where features are selected."""
    medians = quantiles(long, [0.5]).select("name", F.get("q", F.lit(0)).alias("fill"))
    facts = written(medians.withColumns({"shift": F.lit(0.0), "spread": F.lit(1.0), "kept": F.lit(True)}), "fused-fill")
    if facts.isEmpty():
        raise ValueError("nothing to fit on")
    filled = written(Fitted(settings, facts, None).scaled(long), "fused-filled")
    facts = written(medians.join(_scales(filled, settings.scaling), "name").withColumn("kept", F.lit(True)), "fused-facts")
    if settings.selection != "none":
        marked = filled.join(long.select("id", "label").distinct(), "id")
        scores = {"f_classif": lambda: (fusion.anova(marked), "f_score"), "mutual_info": lambda: (fusion.mutual_information(marked), "mi")}
        if settings.selection not in scores:
            raise ValueError(f"unknown selection {settings.selection}")
        top = fusion.select_k(*scores[settings.selection](), settings.n_features).select("name", F.lit(True).alias("chosen"))
        facts = written(facts.join(top, "name", "left").withColumn("kept", F.coalesce("chosen", F.lit(False))).drop("chosen"), "fused-kept")
    loadings = None
    names = sorted(r["name"] for r in facts.where("kept").select("name").collect()) if settings.n_components else []
    if settings.n_components and len(names) > settings.n_components:
        loadings = _loadings(Fitted(settings, facts, None).scaled(long), names, settings.n_components)
    return Fitted(settings, facts, loadings)


def _loadings(scaled: DataFrame, names: list[str], k: int) -> DataFrame:
    safe = {n: f"c{i}" for i, n in enumerate(names)}
    number = scaled.sparkSession.createDataFrame(list(safe.items()), "name string, safe string")
    wide = fusion.pivot(scaled.join(number, "name"), "id", "safe", "value", list(safe.values()))
    pc = fusion.fit_pca(wide, list(safe.values()), k).stages[-1].pc.toArray()
    sign = [1.0 if pc[abs(pc[:, i]).argmax(), i] >= 0 else -1.0 for i in range(k)]
    rows = [(n, i, float(pc[j, i] * sign[i])) for j, n in enumerate(names) for i in range(k)]
    return scaled.sparkSession.createDataFrame(rows, "name string, component int, loading double")
