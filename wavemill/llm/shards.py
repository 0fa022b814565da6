"""Sharding by sampled splitters, in DataFrame functions only.

Records are ordered by a key whose high half hashes the text and whose low half hashes the id, so copies of a text stand
together. Keys are sampled with a chance in proportion to the record's size, quantiles of the sample split the key space
into ranges, each range's bytes and rows are counted, and overfull ranges (a text with very many copies) are sampled
again and split inside the text's own keys. With the counts of the ranges before it, a record's place within its range
gives its place in the whole order: the law ``bytes`` cuts that order into shards of near equal bytes.

Only (id, size, hashes) is shuffled, never a text, and no task holds more than one range. The driver sees the ranges'
boundaries and counts, at most ``MAX_RANGES`` times a small factor. The shards' capacity alone decides where copies are
cut: records of one text stay in one shard, unless leaving the text whole at a shard's border would move more than
``WHOLE_SHARE`` of a shard's bytes.

Cases: a null text has no bytes (size 1, crc 0) and stands with the empty text. A null id is a value like any other.
Repeated rows are separate records. An empty table gives an empty result. Extra columns aren't carried.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavemill.llm.common import stage

N_SHARDS = 8
MIN_RANGES, MAX_RANGES = 256, 4096
RANGE_BYTES = 4 << 30
#: Sampled keys for each range.
OVERSAMPLE = 32
#: A range of more than so many times the mean is overfull.
OVERFULL = 2.0
#: The capacity law's tolerance: a text at a shard's border stays whole if it has at most so much of a shard's bytes.
WHOLE_SHARE = 0.002
_CELL = 1 << 32


def records(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, text_hash and the ordering key of every record."""
    body = F.coalesce(F.col(text), F.lit(""))
    text_hash = F.xxhash64(body)
    low = F.xxhash64(F.col(key), F.lit(3)).bitwiseAND(F.lit(_CELL - 1))
    return docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        text_hash.alias("text_hash"),
        F.shiftleft(F.shiftright(text_hash, 32), 32).bitwiseOR(low).alias("key"),
    )


def sample_keys(rows: DataFrame, step: float, seed: int) -> DataFrame:
    """Keys picked with chance min(1, size / step), each standing for max(size, step) bytes."""
    chance = F.col("size") / F.lit(float(step))
    draw = F.pmod(F.xxhash64("key", "text_hash", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return rows.where(draw < chance).select("key", F.greatest(F.col("size").cast("double"), F.lit(float(step))).alias("stands_for"))


def quantile_keys(sample: DataFrame, width: float, within: Column | None = None) -> list[int]:
    """Sampled keys at which the bytes stood for pass a multiple of ``width``, within each range. The sample is bounded."""
    part = F.lit(0) if within is None else within
    w = Window.partitionBy("part").orderBy("key")
    run = sample.select("key", "stands_for", part.alias("part")).withColumn("upto", F.sum("stands_for").over(w))
    mark = F.floor(F.col("upto") / width)
    before = F.floor((F.col("upto") - F.col("stands_for")) / width)
    return [r["key"] for r in run.where(mark > before).select("key").distinct().collect()]


def range_of(key: Column, bounds: list[int]) -> Column:
    """The number of boundaries at or below the key, by halving steps over a literal array."""
    if not bounds:
        return F.lit(0)
    array, steps, step = F.array(*[F.lit(b).cast("long") for b in bounds]), [], 1
    while step <= len(bounds):
        steps.insert(0, step)
        step *= 2
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda low, s: F.when((low + s <= len(bounds)) & (F.get(array, low + s - 1) <= key), low + s).otherwise(low),
    )


def count_ranges(rows: DataFrame, bounds: list[int]) -> list[tuple[int, int]]:
    """Bytes and rows of each range."""
    got = {r["r"]: (r["b"], r["n"]) for r in rows.groupBy(range_of(F.col("key"), bounds).alias("r")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
    return [got.get(r, (0, 0)) for r in range(len(bounds) + 1)]


def splitters(rows: DataFrame, total: int, n_ranges: int) -> tuple[list[int], list[tuple[int, int]]]:
    """Boundaries and the counts of their ranges, after overfull ranges have been subdivided."""
    width = total / n_ranges
    cells = {(k >> 32) << 32 for k in quantile_keys(sample_keys(rows, width / OVERSAMPLE, 1), width)}
    bounds = sorted(cells)
    counts = count_ranges(rows, bounds)
    seed = 2
    while full := [r for r, (b, n) in enumerate(counts) if b > OVERFULL * width and n > 1]:
        own = range_of(F.col("key"), bounds)
        sample = sample_keys(rows.where(own.isin(full)), width / OVERSAMPLE, seed)
        more = sorted({*bounds, *quantile_keys(sample, width, own)})
        if more == bounds:
            break  # what is left over are rows of one key
        bounds, counts, seed = more, count_ranges(rows, more), seed + 1
    return bounds, counts


def assign(docs: DataFrame, n_shards: int = N_SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: the law is ``bytes``) of every record."""
    rows = stage(records(docs, key, text), "shard-records")
    total = rows.agg(F.sum("size").alias("n")).first()["n"] or 0
    n_ranges = min(MAX_RANGES, max(MIN_RANGES, total // RANGE_BYTES))
    bounds, counts = splitters(rows, total, n_ranges) if total else ([], [(0, 0)])
    byte_offset = [0, *accumulate(b for b, _ in counts)][:-1]
    row_offset = [0, *accumulate(n for _, n in counts)][:-1]
    offset = lambda values: F.get(F.array(*[F.lit(v).cast("long") for v in values]), F.col("range"))

    in_order = Window.partitionBy("range").orderBy("key", "text_hash", "doc_id", "size")
    upto = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("range", "text_hash")
    placed = (
        rows.withColumn("range", range_of(F.col("key"), bounds))
        .withColumn("place", offset(row_offset) + F.row_number().over(in_order) - 1)
        .withColumn("upto", offset(byte_offset) + F.sum("size").over(upto))
        .withColumn("of_text", F.sum("size").over(same))
        .withColumn("text_upto", F.max("upto").over(same))
    )
    limit = WHOLE_SHARE * total / n_shards
    # colliding texts of one cell would interleave, so a text counts as whole only if its rows stand together
    first = F.min("upto").over(same) - F.min_by("size", "upto").over(same)
    together = (F.col("text_upto") - first) == F.col("of_text")
    middle = F.when((F.col("of_text") <= limit) & together, F.col("text_upto") - F.col("of_text") / 2).otherwise(F.col("upto") - F.col("size") / 2)
    shard = F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / F.lit(float(max(total, 1))))).cast("int")
    out = stage(placed.withColumn("shard", shard).select("doc_id", "size", "text_crc32", "shard", "place"), "shard-places")
    begins = {r["shard"]: r["place"] for r in out.groupBy("shard").agg(F.min("place").alias("place")).collect()}
    start = F.get(F.array(*[F.lit(begins.get(s, 0)).cast("long") for s in range(n_shards)]), F.col("shard"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - start).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def shard_of_place(begins: list[int], place: int) -> int:
    """The shard that holds a place of the whole order, given where the shards begin."""
    return bisect_right(begins, place) - 1


def write_shards(docs: DataFrame, placed: DataFrame, path: str, key: str = "doc_id") -> None:
    """Write the documents, ordered by slot, into one folder for each shard; ids must be distinct and not null."""
    where = placed.select(F.col("doc_id").alias(key), "shard", "slot")
    docs.drop("shard", "slot").join(where, key).repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
