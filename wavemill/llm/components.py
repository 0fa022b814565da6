"""Connected components of a link table on Spark: union-find by alternating large and small stars.

Every round lets each node tell its neighbours of the least node it knows, first the larger neighbours, then the
smaller ones, until nothing changes; the number of rounds grows with the logarithm of the longest chain. A node with
very many links is spread over ``SALTS`` salted groups: the least node is found in each of them, then over them, and
told to each group, so no task holds all its links. Tables between rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm.common import stage


SALTS = 16


def _told(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (u, v) with m, the least v of each u; and (u, m)."""
    salted = links.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    part = salted.groupBy("u", "salt").agg(F.min("v").alias("m"))
    least = part.groupBy("u").agg(F.min("m").alias("m"))
    return salted.join(part.select("u", "salt").join(least, "u"), ["u", "salt"]), least


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    told, _ = _told(both)
    return told.where("v > u").select(F.col("v").alias("a"), F.least("m", "u").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    told, least = _told(down)
    across = told.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return across.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def _facts(links: DataFrame) -> tuple:
    """Number of links and a sum over them: equal sums of two rounds mean equal links."""
    r = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.countDistinct("a").alias("d")).first()
    return r["n"], r["x"], r["d"]


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) rows of links between ids -> (id, component): the least id reachable, for every id but the least itself.

    Links of an id with itself and repeated links are allowed; null ids are left out.
    """
    now = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    before = _facts(now)
    for _ in range(max_rounds):
        if before[0] == before[2] and _is_flat(now):
            break
        now = stage(_small_star(_large_star(now)), "links")
        after = _facts(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component"))


def _is_flat(links: DataFrame) -> bool:
    """Whether no link's lesser end is itself the greater end of another: every id then points at its component."""
    return links.select("b").distinct().join(links.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()
