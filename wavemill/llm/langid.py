"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased; everything but letters becomes a space; its character n-grams of 1 to ``ORDERS`` letters are
hashed into ``BUCKETS`` columns. Fitting counts them on Spark over a bounded sample of labelled documents, at most
about ``per_language`` documents of each language picked by a hash of doc_id; the priors count all of them. The matrix
of log-probabilities (BUCKETS x languages, its size checked) is broadcast, and each Arrow batch is scored as a sparse
matrix: the rows' n-gram columns are gathered and summed by document.

Cases: a null text, or one without a letter, is ``und`` with score 0. Rows with a null lang are never learned from.
Ties go to the first language in order of its name. Repeated rows are each judged. With nothing to learn from, every
text is ``und``. Extra columns are not carried: the result is doc_id, held_out, lang_pred and score.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm.common import crc32_mod, small_batches

BUCKETS = 1 << 16
ORDERS = 3
PER_LANGUAGE = 4000
#: Languages whose log-probabilities fit in one broadcast: 512 columns of BUCKETS floats are 128 MB.
MAX_LANGUAGES = 512
UNKNOWN = "und"
#: Log-probabilities gathered at once.
GATHERED = 4_000_000


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)


def letter_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, lower-cased, with 0 for what isn't a letter; and where each text begins.

    Each text is followed by ORDERS zeros, so that no n-gram reaches into the next.
    """
    gap = "\0" * ORDERS
    parts = [(t.lower() if t else "") + gap for t in texts]
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=starts[1:])
    high = codes > 0xFFFF
    letter = _letters()[np.where(high, 0, codes)]
    if high.any():
        letter[high] = [chr(c).isalpha() for c in codes[high]]
    return np.where(letter, codes, 0).astype(np.uint32), starts


def ngram_columns(codes: np.ndarray, order: int) -> np.ndarray:
    """The hashed column of the n-gram that begins at each place."""
    h = codes.copy()
    for k in range(1, order):
        h[:-k] = h[:-k] * np.uint32(0x01000193) + codes[k:]
    h = (h + np.uint32(order)) * np.uint32(0x9E3779B1)
    return (h >> np.uint32(16)).astype(np.int64)


def n_letters(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat((codes > 0).astype(np.int64), starts[:-1]) if len(starts) > 1 else np.zeros(0, np.int64)


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, text: str = "text", lang: str = "lang", key: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """Languages in order, and log-probabilities of shape (BUCKETS + 1, languages) whose last row holds the priors."""
    small_batches(labelled.sparkSession)
    usable = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return [], np.zeros((BUCKETS + 1, 0), np.float32)
    langs = sorted(sizes)
    rate = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    picked = usable.where(F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1 << 30)) < rate[F.col("lang")] * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            codes, starts = letter_codes(batch.column("text").to_pylist())
            own = batch.column("lang").to_pylist()
            which = np.repeat(np.arange(len(own)), np.diff(starts))
            for name in set(own):
                rows = np.array([x == name for x in own])[which]
                t = totals.setdefault(name, np.zeros(BUCKETS, np.int64))
                for order in range(1, ORDERS + 1):
                    t += np.bincount(ngram_columns(codes, order)[rows & (codes > 0)], minlength=BUCKETS)
        for name, t in totals.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(t[at], pa.int64())], names=["lang", "bucket", "n"])

    counted = picked.select("lang", "text").mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counted.toPandas()  # at most BUCKETS rows for each language
    counts = np.zeros((BUCKETS, len(langs)))
    counts[got["bucket"].to_numpy(np.int64), got["lang"].map({k: i for i, k in enumerate(langs)}).to_numpy(np.int64)] = got["n"].to_numpy(float)
    smooth = np.log((counts + 0.5) / (counts + 0.5).sum(axis=0))
    prior = np.log(np.array([sizes[k] for k in langs], float) / sum(sizes.values()))
    return langs, np.vstack([smooth, prior]).astype(np.float32)


def score(texts: list[str | None], langs: list[str], logp: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Predicted language and its posterior probability for each text."""
    if not langs or not texts:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    codes, starts = letter_codes(texts)
    letters = n_letters(codes, starts)
    total = np.zeros((len(texts), len(langs)))
    begins = codes > 0
    at = np.flatnonzero(begins)
    which = np.repeat(np.arange(len(texts)), letters)
    step = max(1, GATHERED // len(langs))
    for order in range(1, ORDERS + 1):
        columns = ngram_columns(codes, order)[at]
        for lo in range(0, len(at), step):
            rows, own = logp[columns[lo : lo + step]], which[lo : lo + step]
            for k in range(len(langs)):
                total[:, k] += np.bincount(own, weights=rows[:, k], minlength=len(texts))
    total += logp[-1]
    best = total.argmax(axis=1)
    p = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    known = letters > 0
    return [langs[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, p, 0.0)


def predict(docs: DataFrame, langs: list[str], logp: np.ndarray, held_out_mod: int = 4, held_out: int = 2) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast((langs, logp))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = sent.value
        for batch in batches:
            lang, p = score(batch.column("text").to_pylist(), names, matrix)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(p, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", (crc32_mod(F.col("doc_id"), held_out_mod) == held_out).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, held_out_mod: int = 4, held_out: int = 2) -> DataFrame:
    """Fit on the documents that aren't held out and predict all of them."""
    langs, logp = fit(docs.where(crc32_mod(F.col("doc_id"), held_out_mod) != held_out))
    return predict(docs, langs, logp, held_out_mod, held_out)
