"""Graph features of thresholded connectivity: edges (subject, i, j, w), i < j, and nodes (subject, node).

Graphs have at most a few hundred nodes (channels) but there may be very many of them, so every operator groups by
subject; paths and betweenness, which need a whole graph, run on one packed row for each graph.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.functions import dsp
from wavemill.operators.connectivity import both_ways

THRESHOLD = 0.5


def build(edges: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The graph's edges: those of a weight of at least the threshold and not zero."""
    return edges.where((F.col("w") >= threshold) & (F.col("w") != 0) & (F.col("i") != F.col("j")))


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select("subject", F.explode(F.array("i", "j")).alias("node")).distinct()


def triangles(graph: DataFrame) -> DataFrame:
    """Closed pairs of neighbours of each node, by joining a node's neighbour list with the edges between them."""
    near = both_ways(graph).groupBy("subject", F.col("a").alias("node")).agg(F.array_sort(F.collect_set("b")).alias("near"))
    pairs = near.select("subject", "node", "near", F.posexplode("near").alias("k", "x")).select("subject", "node", "x", F.explode(F.slice("near", F.col("k") + 2, F.size("near"))).alias("y"))
    closed = pairs.join(graph.select("subject", F.col("i").alias("x"), F.col("j").alias("y")), ["subject", "x", "y"])
    return closed.groupBy("subject", "node").agg(F.count("*").alias("t"))


def degrees(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    d = both_ways(graph).groupBy("subject", F.col("a").alias("node")).agg(F.count("*").alias("d"))
    return nodes.join(d, ["subject", "node"], "left").select("subject", "node", F.coalesce("d", F.lit(0)).alias("d"))


def _local(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    rows = degrees(graph, nodes).join(triangles(graph), ["subject", "node"], "left")
    possible = F.col("d") * (F.col("d") - 1) / 2
    return rows.select("subject", "d", F.coalesce("t", F.lit(0)).alias("t"), F.when(F.col("d") >= 2, F.coalesce("t", F.lit(0)) / possible).alias("c"))


def clustering(edges: DataFrame, nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Mean of triangles over possible ones, of nodes with two neighbours over the threshold or more; 0 without such."""
    return _local(edges.where(F.col("w") > threshold), nodes).groupBy("subject").agg(F.coalesce(F.avg("c"), F.lit(0.0)).alias("clustering_coefficient"))


def average_clustering(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """The same over all nodes; those of fewer neighbours count as 0."""
    return _local(graph, nodes).groupBy("subject").agg(F.avg(F.coalesce("c", F.lit(0.0))).alias("average_clustering"))


def density(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    m = graph.groupBy("subject").agg(F.count("*").alias("m"))
    n = nodes.groupBy("subject").agg(F.count("*").alias("n"))
    m_ = F.coalesce("m", F.lit(0))
    return n.join(m, "subject", "left").select("subject", F.coalesce(F.try_divide(2.0 * m_, F.col("n") * (F.col("n") - 1)), F.lit(0.0)).alias("density"), m_.alias("number_of_edges"), F.col("n").alias("number_of_nodes"))


def degree_centrality(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.groupBy("subject").agg(F.count("*").alias("n"))
    c = F.coalesce(F.try_divide(F.col("d"), F.col("n") - 1), F.lit(0.0))
    rows = degrees(graph, nodes).join(n, "subject").withColumn("c", c)
    return rows.groupBy("subject").agg(F.avg("c").alias("mean_degree_centrality"), F.stddev_pop("c").alias("std_degree_centrality"), F.min("d").alias("min_degree"), F.max("d").alias("max_degree"))


def _whole(graph: DataFrame, nodes: DataFrame, fn, schema: str) -> DataFrame:
    """fn(n, edges) -> a tuple of numbers for each packed graph."""
    edges = graph.groupBy("subject").agg(F.collect_list(F.struct("i", "j")).alias("e"))
    packed = nodes.groupBy("subject").agg(F.array_sort(F.collect_list("node")).alias("v")).join(edges, "subject", "left")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for s, v, e in zip(*(batch.column(c).to_pylist() for c in ("subject", "v", "e"))):
                at = {x: k for k, x in enumerate(v)}
                out.append((s, *fn(len(v), [(at[x["i"]], at[x["j"]]) for x in e or []])))
            cols = list(zip(*out)) if out else [[]] * len(names)
            kinds = [pa.string(), *(pa.bool_() if c.endswith("boolean") else pa.int64() if c.endswith("bigint") else pa.float64() for c in schema.split(", ")[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return packed.mapInArrow(run, schema)


def _hops(n: int, edges: list[tuple[int, int]]) -> np.ndarray:
    """Distances of all pairs by growing reach, infinite where there is no path."""
    adjacent = np.zeros((n, n), bool)
    for a, b in edges:
        adjacent[a, b] = adjacent[b, a] = True
    out = np.full((n, n), np.inf)
    np.fill_diagonal(out, 0)
    reach = np.eye(n, dtype=bool)
    for step in range(1, n):
        new = (reach.astype(np.int64) @ adjacent > 0) & np.isinf(out)
        if not new.any():
            break
        out[new] = step
        reach = new
    return out


def paths(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """Connectedness, mean shortest path and diameter (null if not connected), and global efficiency."""
    def fn(n: int, edges: list[tuple[int, int]]) -> tuple:
        d = _hops(n, edges)
        off = d[~np.eye(n, dtype=bool)]
        whole = n > 0 and not np.isinf(off).any()
        efficiency = float((1 / off).mean()) if len(off) else 0.0
        return whole, float(off.mean()) if whole and len(off) else (0.0 if whole else None), int(off.max()) if whole and len(off) else (0 if whole else None), efficiency

    return _whole(graph, nodes, fn, "subject string, is_connected boolean, average_shortest_path double, diameter bigint, global_efficiency double")


def local_efficiency(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mean over nodes of the efficiency among a node's neighbours, paths running among them alone; 0 for fewer than two."""
    def fn(n: int, edges: list[tuple[int, int]]) -> tuple:
        near: list[list[int]] = [[] for _ in range(n)]
        for a, b in edges:
            if a != b:
                near[a].append(b)
                near[b].append(a)
        total = 0.0
        for around in map(sorted, map(set, near)):
            at = {v: k for k, v in enumerate(around)}
            among = [(at[a], at[b]) for a in around for b in near[a] if b in at and a < b]
            d = _hops(len(around), among)
            off = d[~np.eye(len(around), dtype=bool)]
            total += float((1 / off).mean()) if len(off) else 0.0
        return (total / n if n else 0.0,)

    return _whole(graph, nodes, fn, "subject string, local_efficiency double")


def betweenness_centrality(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    def fn(n: int, edges: list[tuple[int, int]]) -> tuple:
        b = dsp.betweenness(n, edges)
        return (float(b.mean()), float(b.std())) if n else (0.0, 0.0)

    return _whole(graph, nodes, fn, "subject string, mean_betweenness_centrality double, std_betweenness_centrality double")
