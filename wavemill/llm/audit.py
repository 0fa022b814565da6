"""Audit of five text filters: what each removes in every order, and what the others would have removed anyway.

Exact copies are found by fingerprint-routed RDDs. Rows are keyed by the xxhash of their text; each input partition first
merges its own copies, then what is left goes to the partition of its fingerprint. A store there holds, for each fingerprint,
a chain of the different texts that share it, each with its full text and its least doc_id. When two ids of one text meet, the
greater is emitted as a copy at once; the least is emitted when the partition ends. So each row comes out once, nothing is
joined, copies of a text travel at most once from each input partition, and a third of all rows being equal costs no task more
than one row for each input partition. What comes out is narrow (doc_id, part, mask of failed filters, rows); labels meet it
there, and ``combineByKey`` merges counts by mask into one vector for each part. All orders are read off these vectors.

Cases: a null text is the empty text; a null source is the empty part. A null doc_id is smaller than nothing and nothing is
smaller than it: it neither fails E nor makes others fail, and has no label. Rows that repeat a doc_id with one text are no
copies of each other, and each counts. Labels that repeat a doc_id count as 1 where any of them is 1. An empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
#: Bytes of text for which there is one store, about; copies count too, so a store holds less.
STORE_BYTES = 32 << 20
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
_SIGNS = re.compile(r"[#$%&*|]")
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RESULT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def failed(text: str) -> int:
    """The mask of the filters A to D that a text fails; bit k stands for letter k."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    mask = len(words) < LEAST_WORDS
    mask |= (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1
    mask |= (100 * (len(data) - len(data.translate(None, _CAPITALS))) > MOST_CAPITALS * len(text)) << 2
    return mask | (_SIGNS.search(text) is not None) << 3


_E = 1 << LETTERS.index("E")


class Store:
    """Chains of different texts by fingerprint: [text, least doc_id, {(part, mask): rows}]."""

    def __init__(self) -> None:
        self.chains: dict[int, list[list]] = {}

    def meet(self, fingerprint: int, text: str, doc_id: int, rows: dict) -> Iterator[tuple]:
        """Take rows of one doc_id in; gives what is now known to be a copy as (doc_id, part, mask, rows)."""
        chain = self.chains.setdefault(fingerprint, [])
        for entry in chain:
            if entry[0] != text:
                continue
            if doc_id == entry[1]:
                for k, n in rows.items():
                    entry[2][k] = entry[2].get(k, 0) + n
                return
            copy_id, copies = (doc_id, rows) if doc_id > entry[1] else (entry[1], entry[2])
            if doc_id < entry[1]:
                entry[1:] = doc_id, rows
            for (part, mask), n in copies.items():
                yield copy_id, part, mask | _E, n
            return
        chain.append([text, doc_id, rows])

    def rest(self) -> Iterator[tuple[int, str, int, dict]]:
        for fingerprint, chain in self.chains.items():
            for text, doc_id, rows in chain:
                yield fingerprint, text, doc_id, rows


def _own_copies(rows: Iterable) -> Iterator[tuple]:
    """Of an input partition: (fingerprint, (text, doc_id, counts)) to route; what is settled as (a running number, (None,
    outcome)), so that it is dealt evenly."""
    store, settled = Store(), 0
    for doc_id, text, part, fingerprint in rows:
        mask = failed(text)
        out = [(None, part, mask, 1)] if doc_id is None else store.meet(fingerprint, text, doc_id, {(part, mask): 1})
        for outcome in out:
            yield settled, (None, outcome)
            settled += 1
    for fingerprint, text, doc_id, counts in store.rest():
        yield fingerprint, (text, doc_id, counts)


def _routed(pairs: Iterable) -> Iterator[tuple]:
    store = Store()
    for fingerprint, value in pairs:
        if value[0] is None:
            yield value[1]
        else:
            yield from store.meet(fingerprint, *value)
    for _, _, doc_id, counts in store.rest():
        for (part, mask), n in counts.items():
            yield doc_id, part, mask, n


def _place(fingerprint: int) -> int:
    return fingerprint


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask of failed filters, n rows; one row for each combination."""
    rows = docs.select(
        F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part")
    ).withColumn("fingerprint", F.xxhash64("text"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    stores = rows.rdd.mapPartitions(_own_copies).partitionBy(max(8, -(-size // STORE_BYTES)), _place)
    outcomes = docs.sparkSession.createDataFrame(stores.mapPartitions(_routed), "doc_id long, part string, mask int, n long")
    return outcomes.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each order and step, which masks are kept, removed and redundant; and the filter's letter."""
    mask = np.arange(1 << len(LETTERS))
    kept, removed, redundant, letters = [], [], [], []
    for order in ORDERS:
        before = np.zeros(len(mask), bool)
        for letter in order:
            k = LETTERS.index(letter)
            fails = (mask >> k & 1).astype(bool)
            removed.append(fails & ~before)
            redundant.append(fails & before)
            before = before | fails
            kept.append(~before)
            letters.append(k)
    return np.array(kept, np.int64), np.array(removed, np.int64), np.array(redundant, np.int64), np.array(letters)


_KEPT, _REMOVED, _REDUNDANT, _LETTER = _tables()


def _vector(row: tuple[int, int, int, int]) -> np.ndarray:
    """Counts by mask: all rows, those of good and those of toxic documents."""
    mask, n, good, toxic = row
    v = np.zeros((3, 1 << len(LETTERS)), np.int64)
    v[:, mask] = n, n * good, n * toxic
    return v


def _add(v: np.ndarray, row: tuple) -> np.ndarray:
    mask, n, good, toxic = row
    v[:, mask] += (n, n * good, n * toxic)
    return v


def _orders(pair: tuple[str, np.ndarray]) -> Iterator[tuple]:
    part, (n, good, toxic) = pair
    kept, removed, redundant = _KEPT @ n, _REMOVED @ n, _REDUNDANT @ n
    good_lost, toxic_lost = _REMOVED @ good, _REMOVED @ toxic
    shapley = [removed[_LETTER == k].sum() for k in range(len(LETTERS))]
    for i, k in enumerate(_LETTER):
        yield (
            part, ORDERS[i // len(LETTERS)], i % len(LETTERS) + 1, int(kept[i]), int(removed[i]), int(redundant[i]), int(n[1 << k]),
            int(good_lost[i]), int(toxic_lost[i]), int(shapley[k]),
        )


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    marked = masks(docs).join(marks, "doc_id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    vectors = marked.rdd.map(lambda r: (r[0], tuple(r)[1:])).combineByKey(_vector, _add, lambda a, b: a + b)
    return docs.sparkSession.createDataFrame(vectors.flatMap(_orders), RESULT)


def oracle_sql() -> str:
    return r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
least AS (SELECT t, min(doc_id) AS least_id FROM d GROUP BY t),
f AS (
  SELECT w.part, w.doc_id, len(words) < 50 AS fa, 100 * len(list_distinct(words)) < 65 * len(words) AS fb,
    100 * length(regexp_replace(w.t, '[^A-Z]', '', 'g')) > 5 * length(w.t) AS fc, regexp_matches(w.t, '[#$%&*|]') AS fd,
    coalesce(w.doc_id > least_id, false) AS fe
  FROM w JOIN least ON w.t = least.t),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN fa THEN 'A' ELSE '' END || CASE WHEN fb THEN 'B' ELSE '' END || CASE WHEN fc THEN 'C' ELSE '' END || CASE WHEN fd THEN 'D' ELSE '' END || CASE WHEN fe THEN 'E' ELSE '' END) AS fails
  FROM f LEFT JOIN (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || p.x || q.x || r.x AS filter_order FROM x a, x b, x p, x q, x r
  WHERE length(regexp_replace(a.x || b.x || p.x || q.x || r.x, 'A', '')) = 4 AND len(list_distinct([a.x, b.x, p.x, q.x, r.x])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS letter, filter_order[1:step - 1] AS earlier FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
g AS (
  SELECT part, filter_order, step, letter,
    sum(CASE WHEN NOT contains(fails, letter) AND NOT early THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN contains(fails, letter) AND NOT early THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(fails, letter) AND early THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = letter THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(fails, letter) AND NOT early THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(fails, letter) AND NOT early THEN toxic ELSE 0 END) AS toxic_lost
  FROM (SELECT *, length(translate(fails, earlier, '')) < length(fails) AS early FROM c, s)
  GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM g"""
