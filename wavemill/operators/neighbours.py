"""Exact nearest neighbours in cells of blocks: vectors are dealt to cells around pivots, and packed into matrices on the
executors. Queries first meet the blocks of their own cell; the distance of the k-th found there bounds which other cells
can hold a nearer vector, by the distance to a cell's pivot less its radius, and only those are met. The k best of all
meetings are merged by query. Pivots are training rows of lowest hash, at most ``PIVOTS``; they and the radii reach the driver.
Vectors that lie in no clusters can't be pruned in many dimensions: then every block of queries meets every block. Blocks travel
in groups for that: a task compares the blocks of two groups, so a block is sent once for each group that it meets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.plans.shared import written

#: Vectors in one block.
BLOCK = 4096
#: Blocks of one group: at most so many, and so few that small tables make several groups.
GROUP, GROUPS = 16, 8
#: Queries whose distances to a block are held at once.
AT_ONCE = 128
#: Cells at most.
PIVOTS = 512
_NEAR = "array<struct<d:double,id:bigint,label:int>>"


def _plain(rows: DataFrame, labelled: bool) -> DataFrame:
    label = F.col("label").cast("int") if labelled else F.lit(0)
    return rows.where(F.col("id").isNotNull() & F.col("xs").isNotNull()).select(F.col("id").cast("long").alias("id"), label.alias("label"), F.col("xs").cast("array<double>").alias("xs"))


def _in_cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Rows with their cell, that of the nearest pivot, and their distance r to it."""
    if len(pivots) < 2:
        return rows.withColumns({"cell": F.lit(0), "r": F.lit(0.0)})

    @F.pandas_udf("cell int, r double")
    def nearest(xs: pd.Series) -> pd.DataFrame:
        x = np.stack(xs.to_numpy()) if len(xs) else np.zeros((0, pivots.shape[1]))
        cell = ((pivots * pivots).sum(axis=1)[None] - 2 * x @ pivots.T).argmin(axis=1)
        return pd.DataFrame({"cell": cell, "r": np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))})

    return rows.withColumn("near", nearest("xs")).select("id", "label", "xs", "near.cell", "near.r")


def _sizes(rows: DataFrame, n_cells: int) -> tuple[list[int], np.ndarray]:
    """Rows and radius of each cell; at most ``PIVOTS`` rows reach the driver. An empty cell's radius is minus infinity."""
    n, radius = [0] * n_cells, np.full(n_cells, -np.inf)
    for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("r").alias("radius")).collect():
        n[r["cell"]], radius[r["cell"]] = r["n"], r["radius"]
    return n, radius


def _packed(rows: DataFrame, sizes: list[int], block: int) -> tuple[DataFrame, list[int]]:
    """A row for each block of about ``block`` vectors of one cell: ids, labels and their matrix; and the blocks of each cell."""
    parts = [max(1, -(-n // block)) for n in sizes]
    part = F.pmod(F.xxhash64("id"), F.element_at(F.array(*map(F.lit, parts)), F.col("cell") + 1)).cast("int")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        x = np.stack(pdf["xs"].to_numpy()).astype(np.float64).tobytes()
        return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "part": [pdf["part"].iloc[0]], "ids": [pdf["id"].to_numpy(np.int64)], "labels": [pdf["label"].to_numpy(np.int32)], "x": [x]})

    rows = rows.select("cell", part.alias("part"), "id", "label", "xs")
    return rows.groupBy("cell", "part").applyInPandas(pack, "cell int, part int, ids array<bigint>, labels array<int>, x binary"), parts


def _needed(pivots: np.ndarray, radius: np.ndarray):
    """The cells other than its own that may hold a vector nearer than a query's bound, with room for rounding."""

    @F.pandas_udf("array<int>")
    def cells(xs: pd.Series, cell: pd.Series, bound: pd.Series) -> pd.Series:
        x = np.stack(xs.to_numpy()) if len(xs) else np.zeros((0, pivots.shape[1]))
        away = np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None] - 2 * x @ pivots.T, 0))
        limit = bound.fillna(np.inf).to_numpy(float)
        slack = 1e-6 * (1 + (x * x).sum(axis=1) + (pivots * pivots).sum(axis=1).max())
        may = (np.maximum(away - radius[None], 0) ** 2 <= (limit + slack)[:, None]) & (radius >= 0)[None]
        may[np.arange(len(x)), cell.to_numpy()] = False
        return pd.Series([np.flatnonzero(m).astype(np.int32) for m in may], dtype=object)

    return cells


def _merged(found: DataFrame, k: int) -> DataFrame:
    return found.select("id", F.explode("near").alias("n")).groupBy("id").agg(F.slice(F.array_sort(F.collect_list("n")), 1, k).alias("near"))


def k_nearest(train: DataFrame, queries: DataFrame, k: int, block: int = BLOCK, max_pivots: int = PIVOTS) -> DataFrame:
    """id and near: the k training rows of another id that are nearest, as (squared distance to nine places, id, label), ties
    by id. Fewer where there are fewer; vectors of one length."""
    train, queries = _plain(train, True), _plain(queries, False)
    n_pivots = min(max_pivots, -(-train.count() // block))
    first = train.orderBy(F.xxhash64("id"), "id").limit(n_pivots).select("xs").collect() if n_pivots > 1 else []
    pivots = np.array([r["xs"] for r in first])
    n_cells = max(1, len(pivots))
    train, queries = _in_cells(train, pivots), _in_cells(queries, pivots)
    if n_cells > 1:
        train, queries = written(train, "neighbour-vectors"), written(queries, "neighbour-queries")
    sizes, radius = _sizes(train, n_cells)
    left, parts = _packed(train, sizes, block)
    if n_cells == 1:
        return _merged(_met(left, parts, queries, block, k), k)
    left = written(left, "neighbour-blocks")
    home = written(_merged(_met(left, parts, queries, block, k), k), "neighbours-at-home")
    bound = F.get("near", F.lit(k - 1))["d"].alias("bound")
    asked = queries.join(home.select("id", bound), "id", "left").withColumn("cells", _needed(pivots, radius)("xs", "cell", "bound"))
    asked = written(asked.where(F.size("cells") > 0), "neighbours-asked")
    return _merged(home.unionByName(_met(left, parts, asked, block, k)), k)


def _grouped(parts: list[int]) -> tuple[Column, list[int], list[int]]:
    """The group of a block (cell, part), and the first and last group of each cell: blocks in a row, cell by cell."""
    before = np.cumsum([0, *parts])
    size = max(1, min(GROUP, -(-int(before[-1]) // GROUPS)))
    number = F.element_at(F.array(*(F.lit(int(b)) for b in before[:-1])), F.col("cell") + 1) + F.col("part")
    return F.floor(number / size).cast("int"), (before[:-1] // size).tolist(), ((before[1:] - 1) // size).tolist()


def _met(left: DataFrame, parts: list[int], queries: DataFrame, block: int, k: int, at_once: int = AT_ONCE) -> DataFrame:
    """The k best of each query in each group of blocks that holds a cell it asks for. Queries may have a bound on the distance
    of the k-th (null: none) and the cells they ask for, else they ask for their own. A task holds two groups of blocks, and
    the distances of at most ``at_once`` queries to a block."""
    if "cells" not in queries.columns:
        queries = queries.withColumns({"bound": F.lit(None).cast("double"), "cells": F.array("cell")})
    own = [max(1, -(-n // block)) for n in _sizes(queries, len(parts))[0]]
    part = F.pmod(F.xxhash64("id"), F.element_at(F.array(*map(F.lit, own)), F.col("cell") + 1)).cast("int")
    group, lo, hi = _grouped(parts)
    of = lambda known, c: F.element_at(F.array(*map(F.lit, known)), c + 1)
    to = F.array_distinct(F.flatten(F.transform("cells", lambda c: F.sequence(of(lo, c), of(hi, c)))))
    sent = queries.withColumn("part", part).select(_grouped(own)[0].alias("q_group"), F.explode(to).alias("group"), "id", "xs", "bound", "cells")
    met = sent.select(F.col("q_group").alias("q_to"), F.col("group").alias("to")).distinct()
    given = left.withColumn("to", group).join(met, "to").select("q_to", "to", "cell", "ids", "labels", "x")

    def run(key: tuple, asked: pa.Table, own_blocks: pa.Table) -> pa.Table:
        found = []
        if asked.num_rows:
            q_ids, bound = asked.column("id").to_numpy(), asked.column("bound").to_numpy(zero_copy_only=False).astype(float)
            q = np.array(asked.column("xs").combine_chunks().flatten()).reshape(len(q_ids), -1)
            cells = asked.column("cells").combine_chunks()
            ends = np.cumsum([0, *cells.value_lengths().to_pylist()])
            owner, wanted = np.repeat(np.arange(len(q_ids)), np.diff(ends)), cells.flatten().to_numpy(zero_copy_only=False)
            blocks = [b for batch in own_blocks.to_batches() for b in _blocks_of(batch)]
            for start in range(0, len(q_ids), at_once):
                asks = slice(ends[start], ends[min(start + at_once, len(q_ids))])
                best, limit = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)], np.where(np.isnan(bound), np.inf, bound)[start : start + at_once]
                for cell, ids, labels, x in blocks:
                    at = owner[asks][wanted[asks] == cell]
                    if len(at):
                        best = _better(best, limit, at - start, q[at], q_ids[at], ids, labels, x, k)
                found.append([q_ids[start + best[0]], *best[1:]])
        who, d, ids, labels = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, t) for t in (np.int64, float, np.int64, np.int64))
        starts = np.flatnonzero(np.diff(who, prepend=who[:1] - 1))
        near = pa.StructArray.from_arrays([pa.array(d), pa.array(ids), pa.array(labels.astype(np.int32))], names=["d", "id", "label"])
        return pa.table({"id": pa.array(who[starts], pa.int64()), "near": pa.ListArray.from_arrays(pa.array(np.append(starts, len(who)).astype(np.int32)), near)})

    return sent.groupBy("q_group", "group").cogroup(given.groupBy("q_to", "to")).applyInArrow(run, f"id bigint, near {_NEAR}")


def _blocks_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    for r in range(batch.num_rows):
        ids, labels = (batch.column(c)[r].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ids", "labels"))
        yield batch.column("cell")[r].as_py(), ids, labels, np.frombuffer(batch.column("x")[r].as_buffer()).reshape(len(ids), -1)


def _better(best: list[np.ndarray], limit: np.ndarray, at: np.ndarray, q: np.ndarray, q_ids: np.ndarray, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, k: int) -> list[np.ndarray]:
    """The k best (query's number, distance, id, label) of each query after a block, sorted; ``limit`` by number is lowered."""
    rough = (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None] - 2 * q @ x.T
    most, new = limit[at].copy(), np.flatnonzero(np.isinf(limit[at]))
    if len(new):
        nth = min(k, len(ids) - 1)
        most[new] = np.partition(rough[new], nth, axis=1)[:, nth]
    # what rounding may have moved is kept, and measured again
    i, j = np.nonzero((rough <= (most + 1e-6 * (1 + np.abs(rough).max(axis=1)))[:, None]) & (ids[None] != q_ids[:, None]))
    step = range(0, len(j), 8192)
    d = np.concatenate([np.round(((x[j[s : s + 8192]] - q[i[s : s + 8192]]) ** 2).sum(axis=1), 9) for s in step] or [np.zeros(0)])
    every = [np.concatenate([b, n]) for b, n in zip(best, (at[i], d, ids[j], labels[j]))]
    order = np.lexsort((every[2], every[1], every[0]))
    every = [b[order] for b in every]
    starts = np.flatnonzero(np.diff(every[0], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    last = rank == k - 1
    limit[every[0][last]] = np.minimum(limit[every[0][last]], every[1][last])
    return [b[rank < k] for b in every]


def votes(near: DataFrame, weights: str = "uniform") -> DataFrame:
    """id, prediction (the class of most votes, the least of equals) and probability (its classes' shares of the votes)."""
    vote = F.lit(1.0) if weights == "uniform" else F.try_divide(F.lit(1.0), F.sqrt("n.d") + 1e-12)
    by = near.select("id", F.explode("near").alias("n")).groupBy("id", F.col("n.label").alias("label")).agg(F.sum(vote).alias("v"))
    shares = F.map_from_entries(F.collect_list(F.struct("label", "v")))
    return by.groupBy("id").agg(F.max_by("label", F.struct("v", -F.col("label"))).alias("prediction"), shares.alias("votes"), F.sum("v").alias("total"))
