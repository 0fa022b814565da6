"""Nearest neighbours by cells against plain sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.operators import neighbours

SCHEMA = "id long, label int, xs array<double>"


def brute(train, queries, k):
    out = {}
    for i, _, q in queries:
        ds = sorted((round(float(((np.array(q) - np.array(x)) ** 2).sum()), 9), j, label) for j, label, x in train if j != i and x is not None)
        out[i] = ds[:k]
    return out


def clustered(n, seed, spread):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 20, (12, 5))
    return [(i, i % 3, (centres[r.integers(12)] + r.normal(0, spread, 5)).tolist()) for i in range(n)]


@pytest.mark.parametrize("spread, k, pivots", [(0.5, 5, 512), (15.0, 3, 512), (0.5, 40, 8), (0.0, 4, 512), (0.5, 1, 1)])
def test_neighbours_equal_plain_sorting(spark, spread, k, pivots):
    rows = clustered(300, int(spread * 2) + k, spread)
    train = [*rows[:260], (260, 1, None)]
    queries = rows[40:]
    got = neighbours.k_nearest(spark.createDataFrame(train, SCHEMA), spark.createDataFrame(queries, SCHEMA), k, block=20, max_pivots=pivots)
    assert {r["id"]: [(n["d"], n["id"], n["label"]) for n in r["near"]] for r in got.collect()} == brute(train, queries, k)


def test_far_cells_are_not_asked(spark):
    """Queries of tight clusters ask few cells but their own, and empty sides give nothing."""
    rows = clustered(300, 1, 0.1)
    pivots = np.array([x for _, _, x in rows[:12]])
    df = neighbours._in_cells(spark.createDataFrame(rows, SCHEMA), pivots)
    sizes, radius = neighbours._sizes(df, 12)
    assert sum(sizes) == 300
    asked = df.withColumn("cells", neighbours._needed(pivots, radius)("xs", "cell", F.lit(0.5))).agg(F.sum(F.size("cells"))).first()[0]
    assert asked < 300 * 3
    some, none = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SCHEMA)
    assert neighbours.k_nearest(none, some, 3, block=20).count() == 0
    assert neighbours.k_nearest(some, none, 3, block=20).count() == 0


def test_a_meeting_in_steps_gives_the_same(spark):
    """The distances of few queries are held at once, and the results don't depend on how many."""
    rows = clustered(60, 4, 2.0)
    plain = neighbours._plain(spark.createDataFrame(rows, SCHEMA), True).withColumns({"cell": F.lit(0), "r": F.lit(0.0)})
    left, parts = neighbours._packed(plain, [60], 60)
    for at_once in (1, 7, 128):
        met = neighbours._met(left, parts, plain, 60, 3, at_once)
        assert {r["id"]: [(n["d"], n["id"], n["label"]) for n in r["near"]] for r in met.collect()} == brute(rows, rows, 3)


def test_blocks_are_sent_to_groups_not_to_queries(spark):
    """Without clusters every query asks for every cell; it is sent once for each group of blocks."""
    rows = clustered(400, 9, 40.0)
    plain = neighbours._plain(spark.createDataFrame(rows, SCHEMA), True).withColumns({"cell": F.pmod("id", F.lit(40)).cast("int"), "r": F.lit(0.0)})
    left, parts = neighbours._packed(plain, [10] * 40, 10)
    assert set(neighbours._grouped(parts)[2]) == set(range(8))
    asked = plain.withColumns({"bound": F.lit(None).cast("double"), "cells": F.sequence(F.lit(0), F.lit(39))})
    met = neighbours._met(left, parts, asked, 10, 4).collect()
    assert len(met) == 400 * 8
    got = {}
    for r in met:
        got.setdefault(r["id"], []).extend((n["d"], n["id"], n["label"]) for n in r["near"])
    assert {i: sorted(n)[:4] for i, n in got.items()} == brute(rows, rows, 4)
