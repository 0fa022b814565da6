"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark texts.

Texts are lower-cased (A-Z) and split into words of digits, a-z and characters beyond ASCII. A window is ``window``
consecutive words of one item; an item of fewer words, but not none, is one window. The automaton runs over word
numbers, so each document is scanned once; matched words are mapped back to character offsets of the original text.

The automaton's patterns are the items' consecutive parts of ``(window + 1) // 2`` words, one of which lies in every
window, and the short items: about one node for each word of the benchmark, not one for each word of each window. A part
found in a document is followed to both sides as far as the words agree, and counts if a whole window does. The benchmark
is sent to the workers in blocks of at most ``BLOCK_BYTES`` bytes of text: one for any usual benchmark, and only beyond
that do the documents pass through several automata.

Cases: a null or empty text has no words and no hits; a null or wordless item has no window; equal windows of several
items count for each of them; an item with a null id hits words like any other but isn't named; repeated rows are each
judged. An empty benchmark marks nothing. Extra columns pass through; ``n_words`` and ``hits`` are replaced. Item ids are
integers.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm.common import small_batches, stage

WINDOW = 13
#: Benchmark text in one automaton, in bytes; bounds what is broadcast and what a worker holds.
BLOCK_BYTES = 16_000_000

#: A document is contaminated if at least one word in so many is hit.
ONE_IN = 20

_ORIGINAL_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_NORMAL = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

HIT = "array<struct<first_word:int,last_word:int,start:int,end:int,item_id:bigint>>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split() if text else []


class WindowScanner:
    """The automaton over the parts of some items, given as (item_id, text)."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        self.window, part = window, (window + 1) // 2
        self.items: list[tuple[int | None, tuple[int, ...]]] = []
        places: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for item_id, text in items:
            ids = tuple([self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)])
            if not ids:
                continue
            step = part if len(ids) >= window else len(ids)
            for k in range(0, len(ids) - step + 1, step):
                places.setdefault(ids[k : k + step], []).append((len(self.items), k))
            self.items.append((item_id, ids))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for pattern, where in places.items():
            self.automaton.add_word(pattern, (len(pattern), where))
        self.empty = not places
        self.automaton.make_automaton()

    def _runs(self, ids: tuple[int, ...]) -> dict[int | None, list[list[int]]]:
        """For each item_id the runs of words that a window of it covers, as first and last word, in order."""
        reached: dict[tuple[int, int], int] = {}
        found: dict[int | None, list[list[int]]] = {}
        for last, (length, where) in self.automaton.iter(ids):
            first = last - length + 1
            for k, at in where:
                if reached.get((k, first - at), -1) >= last:
                    continue  # a part of a run that has been followed already
                item_id, own = self.items[k]
                back, end, fore = at, last + 1, at + length
                while back and first - (at - back) > 0 and own[back - 1] == ids[first - (at - back) - 1]:
                    back -= 1
                while fore < len(own) and end < len(ids) and own[fore] == ids[end]:
                    fore, end = fore + 1, end + 1
                reached[k, first - at] = end - 1
                if fore - back >= min(self.window, len(own)):
                    found.setdefault(item_id, []).append([first - (at - back), end - 1])
        return found

    def scan(self, text: str | None) -> tuple[int, list[dict]]:
        """Number of words, and for each item the maximal runs of hit words with their places in the text."""
        words = words_of(text)
        if self.empty or not words:
            return len(words), []
        number = self.number.get
        found = self._runs(tuple([number(w, 0) for w in words]))
        if not found:
            return len(words), []
        places, hits = [m.span() for m in _ORIGINAL_WORD.finditer(text)], []
        for item in sorted(found, key=lambda i: (i is None, i)):
            runs: list[list[int]] = []
            for a, b in sorted(found[item]):
                if runs and a <= runs[-1][1] + 1:
                    runs[-1][1] = max(b, runs[-1][1])
                else:
                    runs.append([a, b])
            hits += [{"first_word": a, "last_word": b, "start": places[a][0], "end": places[b][1], "item_id": item} for a, b in runs]
        return len(words), hits


_scanners: dict[str, WindowScanner] = {}


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str | None]]]:
    """The items in blocks of a bounded size, each collected on its own."""
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = -(-total // block_bytes)
    for k in range(n):
        own = items if n == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
        yield [(r["item_id"], r["text"]) for r in own.collect()]


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add ``n_words`` long and ``hits``: runs of hit words for each item, as word numbers and character offsets."""
    spark = docs.sparkSession
    small_batches(spark)
    own = ("n_words", "hits")
    out = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in own])
    names = out.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    hit_type = pa.list_(pa.struct([("first_word", pa.int32()), ("last_word", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("item_id", pa.int64())]))

    def scan_block(df: DataFrame, items: list[tuple[int, str | None]], first: bool) -> DataFrame:
        sent, key = spark.sparkContext.broadcast(items), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if key not in _scanners:
                _scanners.clear()
                _scanners[key] = WindowScanner(sent.value, window)
            scanner = _scanners[key]
            for batch in batches:
                got = [scanner.scan(t) for t in batch.column("text").to_pylist()]
                hits = [h for _, h in got]
                if not first:
                    hits = [old + new for old, new in zip(batch.column("hits").to_pylist(), hits)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([n for n, _ in got], pa.int64()), pa.array(hits, hit_type)], names=[*names, *own])

        return df.mapInArrow(run, f"{fields}, n_words bigint, hits {HIT}")

    k = -1
    for k, items in enumerate(_blocks(benchmark, block_bytes)):
        out = scan_block(stage(out, "decontaminate") if k else out, items, first=k == 0)
    return out if k >= 0 else scan_block(out, [], first=True)


def n_hit_words(hits: str = "hits"):
    """Words inside any run of ``hits``; runs of different items may overlap."""
    runs = F.array_sort(F.transform(hits, lambda h: F.struct(h["first_word"].alias("a"), h["last_word"].alias("b"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("last"))
    return F.aggregate(
        runs,
        start,
        lambda acc, r: F.struct(
            (acc["n"] + F.greatest(F.lit(0), r["b"] - F.greatest(r["a"] - 1, acc["last"]))).cast("long").alias("n"),
            F.greatest(acc["last"], r["b"]).alias("last"),
        ),
    )["n"]


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of a table with ``hits``."""
    items = F.array_sort(F.array_distinct(F.filter(F.transform("hits", lambda h: h["item_id"].cast("string")), lambda i: i.isNotNull())))
    rows = found.select("doc_id", "n_words", n_hit_words().alias("n_hit"), items.alias("items"))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
    )


def is_contaminated():
    return (F.col("n_hit") > 0) & (F.lit(ONE_IN) * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that the contamination rule does not mark, with their own columns."""
    found = find_hits(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text")), benchmark)
    return found.withColumn("n_hit", n_hit_words()).where(~is_contaminated()).select("row.*")
