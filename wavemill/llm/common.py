"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Whole texts travel in these batches, so the default of 10,000 rows would hold too much at once.
ARROW_ROWS = 400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes in one Arrow batch, about; a longer row is a batch of its own.
ARROW_BYTES = 16 << 20


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound what an Arrow batch of whole texts holds in a Python worker, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the session's own checkpoint folder. Only a
    local session, whose driver and executors are one process, may do without: it writes to the machine's own folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = jvm_dir.get() if jvm_dir.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="wavemill-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage is cut, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/wavemill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key held by more than one in so many rows is hot; there are at most so many such keys.
HOT = 512


def join_hot(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """Join rows with facts that have one row for each key and in ``weight`` the number of rows that hold it.

    Hot keys, at most ``HOT`` of them whatever the size, are broadcast, so that no task gathers the rows of one; all
    others are joined through a shuffle. Both tables are read twice: stage them.
    """
    total = facts.agg(F.sum(weight).alias("n")).first()["n"] or 0
    hot = facts.where(F.col(weight) > max(1.0, total / HOT))
    if hot.isEmpty():
        return rows.join(facts, keys, how)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(facts, keys, how)
    return rest.unionByName(rows.join(F.broadcast(hot), keys))


#: Bits of a broadcast filter for each wanted key, about, and bits at most (8 MB).
FILTER_BITS, MOST_BITS = 16, 1 << 26


def likely(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """The rows whose key is wanted, and few others, in place: a bitmap of the (staged) wanted keys' hashes is broadcast, so
    that a join with them needn't shuffle the texts of all other rows. Its size is bounded; with very many wanted keys it
    only lets more rows through."""
    return _marked(rows, key, wanted, wanted_key, "inner").where("_near").drop("_near")


def parted(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> tuple[DataFrame, DataFrame]:
    """The likely rows, and all the others, none of which is wanted: for a join that keeps these too. Rows are read twice."""
    marked = _marked(rows, key, wanted, wanted_key, "left").withColumn("_near", F.coalesce("_near", F.lit(False)))
    return marked.where("_near").drop("_near"), marked.where("not _near").drop("_near")


def _marked(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str, how: str) -> DataFrame:
    n, bits = wanted.count(), 1 << 15
    while bits < min(FILTER_BITS * n, MOST_BITS):
        bits *= 2
    place = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(bits)) + 1
    pages = wanted.where(F.col(wanted_key).isNotNull()).select(place(wanted_key).alias("_h"))
    pages = pages.groupBy(F.bitmap_bucket_number("_h").alias("_page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_h")).alias("_map"))
    at = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.substring("_map", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.withColumn("_page", F.bitmap_bucket_number(place(key))).join(F.broadcast(pages), "_page", how)
    bit = F.floor(byte / F.pow(F.lit(2), F.pmod(at, F.lit(8))))
    return met.withColumn("_near", F.pmod(bit, F.lit(2)) == 1).drop("_page", "_map")


#: Rows of one key that meet its wide row in one group, about.
WIDE_ROWS = 1000


def dealt(rows: DataFrame, wide: DataFrame, key: str, by: str) -> tuple[DataFrame, DataFrame]:
    """For a join of (narrow, staged) rows with a table of wide rows, one for each key: both with a column ``group_no`` to
    join on as well. A key of many rows is dealt by the column ``by`` into groups of about ``WIDE_ROWS``, and its wide row
    goes to each group; nothing wide is broadcast."""
    sizes = stage(rows.groupBy(key).agg(F.count("*").alias("held_by")), "key-sizes")
    groups = F.ceil(F.col("held_by") / WIDE_ROWS).cast("int")
    one = join_hot(rows, sizes, [key], "held_by").withColumn("group_no", F.pmod(F.xxhash64(by), groups).cast("int")).drop("held_by")
    return one, wide.join(sizes, key).withColumn("group_no", F.explode(F.sequence(F.lit(0), groups - 1))).drop("held_by")


def crc32_mod(col: Column, m: int) -> Column:
    """crc32 of a value as text, modulo m; a null counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % F.lit(m)


def with_columns(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns, replacing any extra columns of the input whose names clash (in any case)."""
    clash = {c.lower() for c in cols}
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() not in clash]
    return df.select(*keep, *(v.alias(k) for k, v in cols.items()))
