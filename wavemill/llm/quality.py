"""Quality classifier: a linear-chain conditional random field labels every line of a document good or bad.

Each line has features of its own text and of its neighbours (mean word length, shares of character classes, repeated
words, and so on). The chain's two states are tied to their neighbours by learned transition weights. The forward-
backward algorithm gives each line's marginal probability of being good, and a document's score is their mean weighted
by line length. For fitting, each line takes its document's label; at most about ``MAX_TRAIN`` labelled documents of at
most ``MAX_TRAIN_BYTES`` bytes and ``MAX_TRAIN_LINES`` lines, picked by a hash of doc_id, are used: less than 200 MB of
features. Scoring takes whole texts, a batch at a time.

Cases: a null or empty text is one empty line, scored like any other; ties in nothing matter; repeated rows are each
scored; documents without a label are scored but not learned from; a label row without a quality is left out, and a
document labelled more than once counts as labelled good only if all its labels are. If nothing is labelled, or all
labels are equal, every score is the share of good labels (0.5 with none). Extra columns of the input play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm.common import crc32_mod, small_batches

MAX_TRAIN = 3000
MAX_TRAIN_BYTES, MAX_TRAIN_LINES = 20_000, 500
#: A document of a lower score is rejected.
THRESHOLD = 0.3

_CLASSES = 11


def _class_table() -> np.ndarray:
    """A byte's class: other, space, lower, upper, digit, sentence mark, '!' and '?', '|', symbols, quotes, non-ASCII."""
    t = np.zeros(256, np.uint8)
    for k, chars in enumerate((b" \t\r\x0b\x0c", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".,;:", b"!?", b"|", b"#$%&*@^~+=<>/\\_{}[]", b"'\"()-"), 1):
        t[list(chars)] = k
    t[128:] = 10
    return t


_TABLE = _class_table()
OWN = 16


@dataclass
class Lines:
    """Lines of some texts: feature rows, lengths, and the number of lines of each text."""

    x: np.ndarray
    length: np.ndarray
    n: np.ndarray


def line_features(texts: list[str | None]) -> Lines:
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.flatnonzero(buf == 10)
    n = np.fromiter((r.count(b"\n") + 1 for r in raw), np.int64, len(raw))
    length = np.diff(ends, prepend=-1) - 1
    line = np.repeat(np.arange(len(ends)), length + 1)
    counts = np.bincount(line * _CLASSES + _TABLE[buf], minlength=len(ends) * _CLASSES).reshape(-1, _CLASSES).astype(np.float64)
    counts[:, 0] -= 1  # the line's own end
    words = np.empty((len(ends), 3))
    k = 0
    for r in raw:
        seen: set[bytes] = set()
        for text in r.split(b"\n"):
            own = text.split()
            distinct = set(own)
            words[k] = (len(own), len(distinct), len(distinct & seen) if seen else 0)
            seen |= distinct
            k += 1
    size = np.maximum(length, 1)[:, None]
    n_words = np.maximum(words[:, 0], 1)
    share = counts / size
    letters = np.maximum(counts[:, 2] + counts[:, 3] + counts[:, 10], 1)
    x = np.column_stack([
        share,
        counts[:, 3] / letters,
        np.log1p(length),
        (length - counts[:, 1]) / n_words,
        words[:, 1] / n_words,
        words[:, 2] / np.maximum(words[:, 1], 1),
    ])
    return Lines(x, length, n)


def with_neighbours(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each line's features, their squares, those of the lines before and after it, and whether there are such lines."""
    last = np.cumsum(n) - 1
    first = last - n + 1
    before, after = np.vstack([z[:1] * 0, z[:-1]]), np.vstack([z[1:], z[:1] * 0])
    before[first] = 0
    after[last] = 0
    is_first, is_last = np.zeros(len(z)), np.zeros(len(z))
    is_first[first] = 1
    is_last[last] = 1
    return np.column_stack([z, z * z, before, after, is_first, is_last, np.ones(len(z))])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray  #: score of the state good over bad, by feature
    trans: np.ndarray  #: trans[a, b]: weight of state b after state a

    def emissions(self, lines: Lines) -> np.ndarray:
        z = np.clip((lines.x - self.mean) / self.scale, -4, 4)
        return with_neighbours(z, lines.n) @ self.weight


def _steps(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts by falling number of lines, where each begins, and how many have a line t for each t."""
    order = np.argsort(-n, kind="stable")
    first = (np.cumsum(n) - n)[order]
    sizes = n[order]
    alive = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")
    return first, alive, order


def forward_backward(e: np.ndarray, n: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the state good, and the expected number of each transition; e: emission of good over bad.

    At step t only the texts that have a line t take part, so that one long text doesn't widen the rest.
    """
    first, alive, _ = _steps(n)
    m, t01 = len(e), np.exp(trans - trans.max())
    up = np.exp(-np.maximum(-e, 0))  # relative weights of good and bad, the larger one 1
    down = np.exp(-np.maximum(e, 0))
    emit = np.column_stack([down, up])
    f, b = np.empty((m, 2)), np.ones((m, 2))
    for t, k in enumerate(alive):
        at = first[:k] + t
        v = emit[at] if t == 0 else (f[at - 1] @ t01) * emit[at]
        f[at] = v / v.sum(axis=1, keepdims=True)
    pairs = np.zeros((2, 2))
    for t in range(len(alive) - 2, -1, -1):
        k = alive[t + 1]
        at = first[:k] + t
        w = emit[at + 1] * b[at + 1]
        v = w @ t01.T
        b[at] = v / v.sum(axis=1, keepdims=True)
        joint = f[at][:, :, None] * t01[None] * w[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    p = f * b
    return p[:, 1] / p.sum(axis=1), pairs


def _pairs_of(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.zeros((2, 2))
    inner = np.ones(len(y), bool)
    inner[np.cumsum(n) - 1] = False
    a = np.flatnonzero(inner)
    np.add.at(out, (y[a], y[a + 1]), 1)
    return out


def train(lines: Lines, label: np.ndarray, rounds: int = 120, l2: float = 1.0) -> Model:
    """Fit by gradient steps (Adam) on the conditional log-likelihood, L2-regularised."""
    mean, scale = lines.x.mean(axis=0), lines.x.std(axis=0) + 1e-6
    x = with_neighbours(np.clip((lines.x - mean) / scale, -4, 4), lines.n)
    y = np.repeat(label, lines.n).astype(np.int64)
    gold = _pairs_of(y, lines.n)
    theta = np.zeros(x.shape[1] + 4)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        w, trans = theta[:-4], theta[-4:].reshape(2, 2)
        p, pairs = forward_backward(x @ w, lines.n, trans)
        grad = np.concatenate([x.T @ (y - p), (gold - pairs).ravel()]) - l2 * theta
        grad /= len(y)
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        theta = theta + 0.05 * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8)
    return Model(mean, scale, theta[:-4], theta[-4:].reshape(2, 2))


def score(texts: list[str | None], model: Model | float) -> np.ndarray:
    """The length-weighted mean of the lines' marginals for each text."""
    if not texts:
        return np.zeros(0)
    if not isinstance(model, Model):
        return np.full(len(texts), float(model))
    lines = line_features(texts)
    p, _ = forward_backward(model.emissions(lines), lines.n, model.trans)
    w = np.maximum(lines.length, 1)
    start = np.cumsum(lines.n) - lines.n
    return np.clip(np.add.reduceat(p * w, start) / np.add.reduceat(w, start), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_bytes: int = MAX_TRAIN_BYTES, max_lines: int = MAX_TRAIN_LINES) -> Model | float:
    """Fit on a bounded sample of the labelled documents."""
    spark = docs.sparkSession
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = marked.count()
    if not n:
        return 0.5
    rate = min(1.0, max_train / n)
    picked = marked.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < rate * (1 << 30))
    n_lines = F.octet_length("text") - F.octet_length(F.translate("text", "\n", "")) + 1
    rows = docs.select("doc_id", "text").where((F.octet_length("text") <= max_bytes) & (n_lines <= max_lines)).join(picked, "doc_id").select("doc_id", "text", "quality")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lines = line_features(batch.column("text").to_pylist())
            offsets = np.concatenate([[0], np.cumsum(lines.n)]).astype(np.int32)
            width = lines.x.shape[1]
            x = pa.ListArray.from_arrays(pa.array(offsets * width), pa.array(lines.x.ravel()))
            length = pa.ListArray.from_arrays(pa.array(offsets), pa.array(lines.length.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()), batch.column("quality").cast(pa.int32()), x, length], names=["doc", "quality", "x", "length"])

    small_batches(spark)
    got = rows.mapInArrow(features, "doc string, quality int, x array<double>, length array<bigint>").toPandas().sort_values("doc", kind="stable")
    y = (got["quality"].to_numpy() > 0).astype(np.int64)
    if len(y) == 0 or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    n_lines = np.array([len(v) for v in got["length"]])
    width = len(got["x"].iloc[0]) // n_lines[0]
    lines = Lines(np.concatenate(got["x"].to_list()).reshape(-1, width), np.concatenate(got["length"].to_list()), n_lines)
    return train(lines, y)


def add_score(docs: DataFrame, model: Model | float, column: str = "score") -> DataFrame:
    """Add each whole text's score; a column of that name is replaced."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != column.lower()])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = score(batch.column("text").to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], names=[*batch.schema.names, column])

    return base.mapInArrow(run, f"{fields}, `{column}` double")


def classify(docs: DataFrame, labels: DataFrame, fold_mod: int = 5, held_out: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every document; only documents that aren't held out are learned from."""
    fold = crc32_mod(F.col("doc_id"), fold_mod)
    model = fit(docs, labels.where(fold != held_out))
    rows = add_score(docs.select("doc_id", (fold == held_out).alias("held_out"), "text"), model)
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_rejected(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents of a score of ``threshold`` or more, with their own columns."""
    model = fit(docs, labels)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    return add_score(rows, model).where(F.col("score") >= threshold).select("row.*")
