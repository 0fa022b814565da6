"""Sums over time for all pairs of a recording's channels (or of a table's features), as products of matrices.

Samples are brought together in blocks of ``ROWS`` numbers; a task turns each block into a matrix (numbers x channels), adds the
products up by key, and hands on one cell for each pair when its sums have grown to ``HELD_BYTES`` or the task ends. So what is
shuffled after the blocks grows with pairs and tasks, not with pairs times samples. ``row`` is a whole number. A pair's sums are
over the numbers at which both have a value; null values are none, and the least of repeated values counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 4096
HELD_BYTES = 64 << 20

Products = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _moments(x: np.ndarray, seen: np.ndarray) -> np.ndarray:
    m = seen.astype(float)
    return np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])


def _phasors(x: np.ndarray, seen: np.ndarray) -> np.ndarray:
    m, c, s = seen.astype(float), np.where(seen, np.cos(x), 0), np.where(seen, np.sin(x), 0)
    return np.stack([m.T @ m, c.T @ c + s.T @ s, s.T @ c - c.T @ s])


def _codes(levels: int) -> Products:
    def run(x: np.ndarray, seen: np.ndarray) -> np.ndarray:
        one = (np.where(seen, x, 0)[:, :, None] == np.arange(1, levels + 1)).astype(float)
        n = x.shape[1]
        flat = one.reshape(len(x), n * levels)
        return (flat.T @ flat).reshape(n, levels, n, levels).transpose(1, 3, 0, 2).reshape(levels * levels, n, n)

    return run


def _summed(long: DataFrame, keys: list[str], row: str, name: str, value: str, products: Products, columns: list[str], levels: int = 0) -> DataFrame:
    """With ``levels``, sums are counts of pairs of codes and come as rows (keys, i, j, x, y, c) of those that aren't 0."""
    n = F.col(row).cast("long")
    given = long.where(F.col(value).isNotNull() & F.col(name).isNotNull() & n.isNotNull())
    packed = given.groupBy(*keys, F.floor(n / ROWS).alias("_block")).agg(F.collect_list(F.struct(n.alias("n"), F.col(name).cast("string").alias("c"), F.col(value).cast("double").alias("v"))).alias("p"))
    fields = {f.name: f.dataType.simpleString() for f in long.schema.fields}
    ends = ["i string", "j string", *(["x int", "y int"] if levels else []), *(f"`{c}` double" for c in columns)]
    schema = ", ".join([*(f"`{k}` {fields[k]}" for k in keys), *ends])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[list[str], np.ndarray]] = {}
        kinds: list[pa.DataType] = []

        def cells() -> Iterator[pa.RecordBatch]:
            for key, (names, sums) in held.items():
                a, b = np.triu_indices(len(names), 1)
                upper = sums[:, a, b]
                code, some = np.nonzero(upper) if levels else (None, np.flatnonzero(np.abs(upper).any(axis=0)))
                a, b, at = a[some], b[some], np.array(names, object)
                cols = [pa.array([k] * len(a), t) for k, t in zip(key, kinds)] + [pa.array(at[a].tolist(), pa.string()), pa.array(at[b].tolist(), pa.string())]
                if levels:
                    cols += [pa.array((code // levels + 1).astype("i4")), pa.array((code % levels + 1).astype("i4")), pa.array(upper[code, some])]
                else:
                    cols += [pa.array(v) for v in upper[:, some]]
                yield pa.RecordBatch.from_arrays(cols, names=[*keys, "i", "j", *(["x", "y"] if levels else []), *columns])
            held.clear()

        for batch in batches:
            kinds = [batch.column(k).type for k in keys]
            by_key = list(zip(*(batch.column(k).to_pylist() for k in keys))) if keys else [()] * batch.num_rows
            for key, p in zip(by_key, batch.column("p")):
                at, c, v = (p.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                names, which = np.unique(c.astype(str), return_inverse=True)
                times, when = np.unique(at, return_inverse=True)
                x = np.full((len(times), len(names)), np.inf)
                np.minimum.at(x, (when, which), v)
                seen = x < np.inf
                sums = products(np.where(seen, x, 0.0), seen)
                known = held.get(key)
                if known is not None and known[0] != names.tolist():
                    union = sorted(set(known[0]) | set(names.tolist()))
                    place = {c: k for k, c in enumerate(union)}
                    both = np.zeros((len(sums), len(union), len(union)))
                    for some, part in (known, (names.tolist(), sums)):
                        to = [place[c] for c in some]
                        both[np.ix_(range(len(sums)), to, to)] += part
                    held[key] = union, both
                else:
                    held[key] = names.tolist(), sums if known is None else known[1] + sums
            if sum(s.nbytes for _, s in held.values()) > HELD_BYTES:
                yield from cells()
        yield from cells()

    parts = packed.drop("_block").mapInArrow(run, schema)
    return parts.groupBy(*keys, "i", "j", *(["x", "y"] if levels else [])).agg(*(F.sum(c).alias(c) for c in columns))


def moments(long: DataFrame, keys: list[str], row: str = "id", name: str = "name", value: str = "value") -> DataFrame:
    """(keys, i, j, n, si, sj, sii, sjj, sij) for i < j."""
    return _summed(long, keys, row, name, value, _moments, ["n", "si", "sj", "sii", "sjj", "sij"])


def phasors(long: DataFrame, keys: list[str], row: str = "n", name: str = "ch", value: str = "x") -> DataFrame:
    """(keys, i, j, n, re, im): the sum of exp(i (x - y)) over time."""
    return _summed(long, keys, row, name, value, _phasors, ["n", "re", "im"])


def joint_codes(long: DataFrame, keys: list[str], levels: int, row: str = "n", name: str = "ch", value: str = "code") -> DataFrame:
    """(keys, i, j, x, y, c): how often codes x and y (1 to ``levels``) come together."""
    return _summed(long, keys, row, name, value, _codes(levels), ["c"], levels)
