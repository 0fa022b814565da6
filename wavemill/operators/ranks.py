"""Exact quantiles of very many values by counted ranges: no task holds a feature, however many rows or equal values it has."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavemill.plans.shared import written


def quantiles(long: DataFrame, shares: list[float], key: str = "name", value: str = "value") -> DataFrame:
    """(key, q): an array of the interpolated quantiles of each key's values that aren't null.

    Equal values are counted first; what is left is cut into ranges of (key, value), and a value's rank is the count of its
    key's earlier ranges plus the running count in its own. Keys without values give no row; nan counts as the greatest value.
    """
    counts = long.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    cut = written(counts.repartitionByRange("k", "v").withColumn("range_no", F.spark_partition_id()), "quantile-ranges")
    sizes = cut.groupBy("k", "range_no").agg(F.sum("c").alias("n"))
    by_key = Window.partitionBy("k")
    ahead = F.coalesce(F.sum("n").over(by_key.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = sizes.select("k", "range_no", ahead.alias("ahead"), F.sum("n").over(by_key).alias("total"))
    inside = Window.partitionBy("k", "range_no").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = cut.withColumn("upto", F.sum("c").over(inside)).join(told, ["k", "range_no"]).withColumn("upto", F.col("upto") + F.col("ahead"))
    at = [(F.lit(float(s)) * (F.col("total") - 1)) for s in shares]
    found = []
    for i, p in enumerate(at):
        for side, rank in (("lo", F.floor(p)), ("hi", F.ceil(p))):
            held = (F.col("upto") > rank) & (F.col("upto") - F.col("c") <= rank)
            found.append(F.max(F.when(held, F.col("v"))).alias(f"{side}{i}"))
    got = ranked.groupBy("k").agg(F.max("total").alias("total"), *found)
    share = lambda i, p: F.col(f"lo{i}") + F.when(F.col(f"hi{i}") == F.col(f"lo{i}"), 0.0).otherwise((F.col(f"hi{i}") - F.col(f"lo{i}")) * (p - F.floor(p)))
    return got.select(F.col("k").alias(key), F.array(*(share(i, p) for i, p in enumerate(at))).alias("q"))


def numbered(rows: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """Rows numbered from 0 in an order, range by range: no task sorts them all. What is broadcast has a row for each range."""
    cut = written(rows.repartitionByRange(*order).withColumn("range_no", F.spark_partition_id()), "numbered-ranges")
    sizes = cut.groupBy("range_no").agg(F.count("*").alias("n"))
    before = sizes.select("range_no", F.coalesce(F.sum("n").over(Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    place = F.row_number().over(Window.partitionBy("range_no").orderBy(*order)) - 1
    return cut.withColumn("place", place).join(F.broadcast(before), "range_no").withColumn(name, F.col("place") + F.col("ahead")).drop("range_no", "place", "ahead")
