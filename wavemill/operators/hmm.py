"""Hidden-Markov microstates: states with Gaussian channel values (own variances) that follow each other by a chain.

The model is one for all recordings and is fitted by expectation and maximisation. Recordings are cut into blocks, and no task
holds a recording: a block's effect on the chain is a product of small matrices (states x states), made where the block is; the
products of a recording are chained in one small group, which tells each block what comes in from both sides; then the blocks add
up their expected counts, along a tree. Most likely paths are found alike, with greatest sums instead of sums.

Cases: samples are (subject, ch, n, x). A missing, null or infinite value says nothing about its time's state; a time without any value
follows the chain. Missing times between a block's first and last are such times; whole missing blocks are passed over. An empty
table, or one without a finite value, raises ValueError in fitting. Equal paths give the lesser state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.operators.ica import Block, _blocks_of, blocks

BLOCK = 4096
#: A variance is at least this share of the channel's own.
LEAST_VARIANCE = 1e-3
_LINK = "subject string, n0 long, first array<double>, rest array<double>"
_ENDS = "subject string, n0 long, before array<double>, after array<double>, likelihood double"


@dataclass
class Chain:
    """Shares of first states, shares of next states (rows), means and variances (states x channels)."""

    channels: list[str]
    start: np.ndarray
    step: np.ndarray
    mean: np.ndarray
    var: np.ndarray

    def log_step(self) -> np.ndarray:
        return np.log(self.step + 1e-300)

    def logs(self, x: np.ndarray) -> np.ndarray:
        """Log densities (times x states) of channels x times."""
        seen = np.isfinite(x)
        z = np.where(seen, x, 0.0).T[:, None, :]
        one = -0.5 * ((z - self.mean) ** 2 / self.var + np.log(2 * np.pi * self.var))
        return (one * seen.T[:, None, :]).sum(axis=2)


def _own(b: Block, channels: list[str]) -> np.ndarray:
    return b.own(b.rows(channels))


def _sum_of(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _best_of(x: np.ndarray, axis: int) -> np.ndarray:
    return x.max(axis=axis)


Added = Callable[[np.ndarray, int], np.ndarray]


def _rest(m: Chain, logs: np.ndarray, add: Added) -> np.ndarray:
    """Log weights from a block's first state to its last, over the times after the first."""
    k = len(m.start)
    if add is _best_of:
        out, step = np.where(np.eye(k) > 0, 0.0, -1e300), m.log_step()
        for row in logs:
            out = (out[:, :, None] + step).max(axis=1) + row
        return out
    out, scale = np.eye(k), 0.0
    for row, top in zip(logs, logs.max(axis=1, initial=-np.inf)):
        out = out @ m.step * np.exp(row - top)
        size = out.sum()
        out, scale = out / size, scale + top + np.log(size)
    return np.log(out + 1e-300) + scale


def _chained(cut: DataFrame, m: Chain, add: Added) -> DataFrame:
    """For each block the log weights of the state before it (null for a recording's first block) and, by its last state, of all
    that comes after it; with the first block the recording's log likelihood. A group holds a recording's small matrices."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b in _blocks_of(batch):
                logs = m.logs(_own(b, m.channels))
                out.append((b.subject, b.n0, logs[0].tolist(), _rest(m, logs[1:], add).ravel().tolist()))
            kinds = (pa.string(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, kinds)], names=["subject", "n0", "first", "rest"])

    k, step, start = len(m.start), m.log_step(), np.log(m.start + 1e-300)

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n0")
        first, rest = np.array(pdf["first"].to_list()), np.array(pdf["rest"].to_list()).reshape(-1, k, k)
        last, before = np.zeros((len(pdf), k)), [None]
        for t in range(len(pdf)):
            entering = start if t == 0 else add(last[t - 1][:, None] + step, 0)
            last[t] = add((entering + first[t])[:, None] + rest[t], 0)
            before.append(last[t].tolist())
        after = np.zeros((len(pdf), k))
        for t in range(len(pdf) - 2, -1, -1):
            after[t] = add(step + first[t + 1] + add(rest[t + 1] + after[t + 1], 1), 1)
        whole = [float(add(last[-1], 0))] + [0.0] * (len(pdf) - 1)
        return pd.DataFrame({"subject": pdf["subject"], "n0": pdf["n0"], "before": before[:-1], "after": after.tolist(), "likelihood": whole})

    ends = cut.mapInArrow(link, _LINK).groupBy("subject").applyInPandas(chain, _ENDS)
    return cut.join(ends, ["subject", "n0"])


def _expected(m: Chain, logs: np.ndarray, before: np.ndarray | None, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of states at each time of a block, and expected steps, the one into the block included."""
    n, k = logs.shape
    weight = np.exp(logs - logs.max(axis=1, keepdims=True))
    ahead, behind = np.zeros((n, k)), np.zeros((n, k))
    prior = None if before is None else np.exp(before - before.max())
    at = (m.start if prior is None else prior @ m.step) * weight[0]
    for t in range(n):
        if t:
            at = ahead[t - 1] @ m.step * weight[t]
        ahead[t] = at / at.sum()
    back = np.exp(after - after.max())
    for t in range(n - 1, -1, -1):
        if t < n - 1:
            back = m.step @ (weight[t + 1] * behind[t + 1])
        behind[t] = back / back.sum()
    shares = ahead * behind
    shares /= shares.sum(axis=1, keepdims=True)
    pairs = ahead[:-1, :, None] * m.step * (weight[1:] * behind[1:])[:, None, :]
    steps = (pairs / pairs.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    if prior is not None:
        pair = prior[:, None] * m.step * (weight[0] * behind[0])
        steps += pair / pair.sum()
    return shares, steps


_TOLD = ["subject", "n0", "lead", "core", "channels", "data", "before", "after", "likelihood"]


def _told_blocks(rows: Iterator) -> Iterator[tuple[Block, np.ndarray | None, np.ndarray, float]]:
    for subject, n0, lead, core, channels, data, before, after, likelihood in rows:
        b = Block(subject, n0, lead, core, channels, np.frombuffer(data).reshape(len(channels), -1))
        yield b, None if before is None else np.array(before), np.array(after), likelihood


def _counts(cut: DataFrame, m: Chain) -> np.ndarray:
    """Of all recordings, as one vector: likelihood, first states, steps, and by state and channel weight, sum and squares."""
    k, d = m.mean.shape

    def part(rows: Iterator) -> Iterator[np.ndarray]:
        out = np.zeros(1 + k + k * k + 3 * k * d)
        for b, before, after, likelihood in _told_blocks(rows):
            x = _own(b, m.channels)
            shares, steps = _expected(m, m.logs(x), before, after)
            seen = np.isfinite(x)
            z = np.where(seen, x, 0.0)
            first = shares[0] if before is None else np.zeros(k)
            out += np.concatenate([[likelihood], first, steps.ravel(), (shares.T @ seen.T).ravel(), (shares.T @ z.T).ravel(), (shares.T @ (z * z).T).ravel()])
        yield out

    return _chained(cut, m, _sum_of).select(*_TOLD).rdd.mapPartitions(part).treeReduce(lambda a, b: a + b)


def _first_guess(cut: DataFrame, channels: list[str], k: int, seed: int) -> Chain:
    """Means spread along random directions of the channels' deviations, even chances, the channels' variances."""
    d = len(channels)

    def part(rows: Iterator) -> Iterator[np.ndarray]:
        out = np.zeros((3, d))
        for b, *_ in _told_blocks((*r, None, [], 0.0) for r in rows):
            x = _own(b, channels)
            seen = np.isfinite(x)
            z = np.where(seen, x, 0.0)
            out += np.stack([seen.sum(1), z.sum(1), (z * z).sum(1)])
        yield out

    n, s, q = cut.select(*_TOLD[:6]).rdd.mapPartitions(part).treeReduce(lambda a, b: a + b)
    if not (n > 0).all():
        raise ValueError("nothing to fit on: a channel has no finite value")
    mean, var = s / n, np.maximum(q / n - (s / n) ** 2, 1e-12)
    sides = np.random.default_rng(seed).choice([-1.0, 1.0], (k, d))
    return Chain(channels, np.full(k, 1 / k), np.full((k, k), 0.1 / k) + 0.9 * np.eye(k), mean + 0.7 * sides * np.sqrt(var), np.tile(var, (k, 1)))


def _again(m: Chain, v: np.ndarray, least: np.ndarray) -> Chain:
    k, d = m.mean.shape
    first, steps, n, s, q = np.split(v[1:], np.cumsum([k, k * k, k * d, k * d]))
    n, s, q, steps = n.reshape(k, d), s.reshape(k, d), q.reshape(k, d), steps.reshape(k, k)
    full = n > 1e-9
    mean = np.where(full, s / np.maximum(n, 1e-9), m.mean)
    var = np.where(full, np.maximum(q / np.maximum(n, 1e-9) - mean**2, least), m.var)
    rows = steps.sum(axis=1, keepdims=True)
    return Chain(m.channels, first / first.sum(), np.where(rows > 1e-9, steps / np.maximum(rows, 1e-9), m.step), mean, var)


def cut_blocks(samples: DataFrame, block: int = BLOCK) -> DataFrame:
    return blocks(samples, block, 0)


def fit(cut: DataFrame, n_states: int = 4, max_iter: int = 50, tol: float = 1e-4, seed: int = 42) -> tuple[Chain, list[float]]:
    """The model of all recordings of the blocks, and the log likelihood before each step; it ends where a step gains less than
    ``tol`` of its size. States are numbered by falling expected time."""
    channels = sorted(r["ch"] for r in cut.select(F.explode("channels").alias("ch")).distinct().collect())
    if not channels:
        raise ValueError("nothing to fit on")
    m = _first_guess(cut, channels, n_states, seed)
    least, said = LEAST_VARIANCE * m.var[0], []
    for _ in range(max_iter):
        v = _counts(cut, m)
        said.append(float(v[0]))
        new = _again(m, v, least)
        weight = v[1 + n_states + n_states**2 :][: n_states * len(channels)].reshape(n_states, -1).sum(axis=1)
        order = np.argsort(-weight, kind="stable")
        m = new
        if len(said) > 1 and said[-1] - said[-2] < tol * abs(said[-1]):
            break
    return Chain(channels, m.start[order], m.step[np.ix_(order, order)], m.mean[order], m.var[order]), said


def _path(m: Chain, logs: np.ndarray, before: np.ndarray | None, after: np.ndarray) -> np.ndarray:
    step, n = m.log_step(), len(logs)
    best = (np.log(m.start + 1e-300) if before is None else (before[:, None] + step).max(axis=0)) + logs[0]
    came = np.zeros((n, len(m.start)), np.int64)
    for t in range(1, n):
        ways = best[:, None] + step
        came[t] = ways.argmax(axis=0)
        best = ways.max(axis=0) + logs[t]
    out = np.zeros(n, np.int64)
    out[-1] = (best + after).argmax()
    for t in range(n - 1, 0, -1):
        out[t - 1] = came[t][out[t]]
    return out


def paths(cut: DataFrame, m: Chain) -> DataFrame:
    """(subject, n, state): the most likely path of each recording."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, before, after, _ in _told_blocks(zip(*(batch.column(c).to_pylist() for c in _TOLD))):
                path = _path(m, m.logs(_own(b, m.channels)), before, after)
                yield pa.RecordBatch.from_arrays([pa.array([b.subject] * len(path)), pa.array(b.n0 + np.arange(len(path))), pa.array(path.astype("i4"))], names=["subject", "n", "state"])

    return _chained(cut, m, _best_of).select(*_TOLD).mapInArrow(run, "subject string, n long, state int")


def templates(spark, m: Chain) -> DataFrame:
    """(state, ch, v): the states' mean values by channel."""
    return spark.createDataFrame([(k, c, float(m.mean[k, i])) for k in range(len(m.start)) for i, c in enumerate(m.channels)], "state int, ch string, v double")
