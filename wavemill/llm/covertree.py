"""Embedding near-deduplication by dual traversal of cover trees: exact threshold pairs, by label.

Equal unit vectors of one label are one class with a weight, so copies are counted and never compared. The classes of a
label form a tree. Its upper levels are made on Spark: a cell of more than ``block`` vectors gets pivots (a sample of
at most about ``PIVOTS`` of its vectors), each vector goes to its nearest pivot, and the new cells are divided again
until each holds at most ``block``. Such a block becomes a cover tree, built once and stored: nested levels whose radii
halve, each node knowing the true radius that covers what lies below it.

The traversal goes down the upper levels as joins: a pair of cells lives on as the pairs of its children, unless their
centres' distance and covering radii rule out every link. What is left are pairs of blocks, whose trees are traversed
together: a pair of nodes is dropped if its least possible distance exceeds the threshold's, counted at once if its
greatest one doesn't reach it, and split otherwise; leaves are compared by their cosines in double precision. Links
inside dense groups are therefore counted, not listed; each pair of blocks gives only a spanning forest of its links,
from which components are found on Spark.

Cases: a vector whose label or embedding is null, that has no or only zero components, or a null or non-finite one,
links with nothing and is its own component. Vectors of different lengths don't link. Rows that repeat a vec_id are
separate vectors with one name: links among them count, and the row's count is that of the name. A null vec_id links
with nothing. Extra columns aren't carried. An empty table gives an empty result. Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavemill.llm.common import join_hot, stage
from wavemill.llm.components import components

COSINE = 0.98
BLOCK = 1024
#: Pivots of one cell, about: as many as make the new cells half a block, within these bounds. And vectors that meet them in
#: one task.
FEW_PIVOTS, PIVOTS = 8, 64
CHUNK = 8192
#: Vectors of neighbouring blocks that travel together: a task traverses the pairs of blocks of two such groups.
GROUP = 4096
#: Upper levels at most; a cell that is still too large then is divided by hash, into blocks of about the right size,
#: which costs pairs but loses none.
LEVELS = 12
#: Distances nearer than this to a bound are settled by splitting, leaves by their cosines.
MARGIN = 1e-7
TOP_RADIUS = 2.0
#: A node of so few vectors, or of so small a radius, has no children.
LEAF, LEAF_RADIUS = 12, 1e-6


class CoverTree:
    """A cover tree over unit vectors x (n, d). order[lo:hi] are the vectors below a node; its children are the nodes
    first_kid .. first_kid + kids - 1, the first of which has the same centre."""

    NODE = np.dtype([("center", np.int64), ("lo", np.int64), ("hi", np.int64), ("first_kid", np.int64), ("kids", np.int64), ("radius", np.float64)])

    def __init__(self, x: np.ndarray, order: np.ndarray | None = None, nodes: np.ndarray | None = None):
        self.x = x
        if nodes is None:
            order, nodes = self._built() if len(x) else (np.zeros(0, np.int64), np.zeros(0, self.NODE))
        self.order, self.nodes = order, nodes
        self.center, self.radius, self.kids, self.first_kid = nodes["center"], nodes["radius"], nodes["kids"], nodes["first_kid"]
        self.lo, self.hi = nodes["lo"], nodes["hi"]

    def _built(self) -> tuple[np.ndarray, np.ndarray]:
        order = np.arange(len(self.x))
        rows: list[list] = []

        def node(center: int, lo: int, hi: int, far: np.ndarray) -> int:
            rows.append([center, lo, hi, 0, 0, float(far.max())])
            return len(rows) - 1

        far = self._from(order, 0)
        stack = [(node(0, 0, len(order), far), TOP_RADIUS, far)]
        while stack:
            k, half, far = stack.pop()
            center, lo, hi, _, _, radius = rows[k]
            if hi - lo <= LEAF or radius <= LEAF_RADIUS:
                continue
            while half >= radius:  # levels at which nothing would change
                half /= 2
            own, at, first = order[lo:hi].copy(), lo, len(rows)
            while len(own):
                if at > lo:
                    center = int(own[0])
                    far = self._from(own, center)
                near = far <= half  # the centre's own distance is 0, and that of the farthest vector exceeds half
                mine = own[near]
                order[at : at + len(mine)] = mine
                stack.append((node(center, at, at + len(mine), far[near]), half, far[near]))
                at += len(mine)
                own, far = own[~near], far[~near]
            rows[k][3:5] = first, len(rows) - first
        return order, np.array([tuple(r) for r in rows], self.NODE)

    def _from(self, own: np.ndarray, center: int) -> np.ndarray:
        """Distances of some vectors from one of them; exactly 0 for itself, whatever rounding says."""
        far = distances(self.x[own], self.x[center])
        far[own == center] = 0.0
        return far

    def below(self, node: int) -> np.ndarray:
        return self.order[self.lo[node] : self.hi[node]]

    def children(self, node: int) -> np.ndarray:
        return self.first_kid[node] + np.arange(self.kids[node])


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ c)))


class Forest:
    """Union-find over the vectors of a pair of blocks."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)

    def join_all(self, ids: np.ndarray) -> None:
        for i in ids[1:].tolist():
            self.join(int(ids[0]), i)


def dual_links(a: CoverTree, b: CoverTree | None, cosine: float = COSINE, weight_a: np.ndarray | None = None, weight_b: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, Forest]:
    """Weights of what each vector of a and of b links with, and the forest over a's vectors and then b's. b None: a with
    itself. Without weights each vector weighs 1."""
    same = b is None
    wa = np.ones(len(a.x), np.int64) if weight_a is None else weight_a
    b, wb = (a, wa) if same else (b, np.ones(len(b.x), np.int64) if weight_b is None else weight_b)
    na, nb = len(a.x), 0 if same else len(b.x)
    links_a = np.zeros(na, np.int64)
    links_b = links_a if same else np.zeros(nb, np.int64)
    forest = Forest(na + nb)
    shift = 0 if same else na
    reach = np.sqrt(2.0 - 2.0 * cosine)
    if not len(a.x) or not len(b.x):
        return links_a, links_b, forest

    def all_pairs(u: int, v: int) -> None:
        own, other = a.below(u), b.below(v)
        if same and u == v:
            links_a[own] += wa[own].sum() - wa[own]
            forest.join_all(own)
            return
        links_a[own] += wb[other].sum()
        links_b[other] += wa[own].sum()
        forest.join_all(np.concatenate([own, other + shift]))

    def leaves(u: int, v: int) -> None:
        own, other = a.below(u), b.below(v)
        hit = a.x[own] @ b.x[other].T >= cosine
        if same and u == v:
            hit = np.triu(hit, 1)
        links_a[own] += hit @ wb[other]
        links_b[other] += wa[own] @ hit
        i, j = np.nonzero(hit)
        for p, q in zip(own[i].tolist(), (other[j] + shift).tolist()):
            forest.join(p, q)

    stack = [(0, 0)]
    while stack:
        u, v = stack.pop()
        itself = same and u == v
        if itself and 2 * a.radius[u] <= reach - MARGIN:
            all_pairs(u, u)
            continue
        if not a.kids[u] and not b.kids[v]:
            leaves(u, v)
            continue
        cu = a.children(u) if a.kids[u] else np.array([u])
        cv = b.children(v) if b.kids[v] else np.array([v])
        dist = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a.x[a.center[cu]] @ b.x[b.center[cv]].T)))
        spread = a.radius[cu][:, None] + b.radius[cv][None, :]
        linked = dist + spread <= reach - MARGIN
        open_ = ~linked & (dist - spread <= reach + MARGIN)
        if itself:
            upper = np.triu(np.ones(dist.shape, bool), 1)
            linked &= upper
            open_ &= upper
            stack.extend((int(k), int(k)) for k in cu)
        for i, j in zip(*np.nonzero(linked)):
            all_pairs(int(cu[i]), int(cv[j]))
        stack.extend((int(cu[i]), int(cv[j])) for i, j in zip(*np.nonzero(open_)))
    return links_a, links_b, forest


def valid(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label and the unit vector (double) of the vectors that can link."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    size = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    rows = vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), x.alias("x"), finite.alias("finite"))
    # the largest component is divided out first, so that no square over- or underflows
    rows = rows.where(F.col("finite") & (F.size("x") > 0)).withColumn("top", F.array_max(F.transform("x", lambda v: F.abs(v)))).where("top > 0")
    rows = rows.withColumn("x", F.transform("x", lambda v: v / F.col("top"))).withColumn("norm", size)
    return rows.select("vec_id", F.concat_ws("/", "label", F.size("x").cast("string")).alias("label"), F.transform("x", lambda v: v / F.col("norm")).alias("x"))


def hashed(rows: DataFrame) -> DataFrame:
    """Add 128 bits that tell the classes of equal vectors of one label apart."""
    return rows.withColumn("h1", F.xxhash64("label", "x")).withColumn("h2", F.xxhash64(F.lit(17), "x", "label"))


def classes_of(rows: DataFrame) -> DataFrame:
    """label, x and weight of each class of equal vectors, and its name: the least vec_id."""
    return rows.groupBy("h1", "h2").agg(F.first("label").alias("label"), F.min("vec_id").alias("name"), F.count("*").alias("weight"), F.first("x").alias("x"))


def _divide(big: DataFrame, sizes: DataFrame, block: int, pivots: int, level: int) -> DataFrame:
    """The vectors of overfull cells in new cells: each vector goes to the nearest pivot of its cell."""
    of = sizes.select("cell", "n", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    rows = big.join(of, "cell")
    draw = F.pmod(F.xxhash64("h1", "h2", F.lit(level)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    enough = F.least(F.lit(pivots), F.greatest(F.lit(FEW_PIVOTS), F.ceil(2 * F.col("n") / block)))
    picked = rows.where(draw * F.col("n") < enough).select(F.col("cell").alias("of"), F.col("x").alias("pivot"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("part"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("h2", "h1"), F.col("chunks")).cast("int")).drop("n", "chunks")
    fields, columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in big.schema.fields), big.columns

    def nearest(key: tuple, own: pa.Table, pivot: pa.Table) -> pa.Table:
        got = own.select(columns)
        if pivot.num_rows and own.num_rows:
            p = _matrix(pivot.column("pivot"))
            p = p[np.lexsort(p.T[::-1])]  # every chunk of a cell numbers its pivots alike
            at = (_matrix(own.column("x")) @ p.T).argmax(axis=1)
            names = [f"{c}.{k}" for c, k in zip(own.column("cell").to_pylist(), at.tolist())]
            got = got.set_column(got.schema.get_field_index("cell"), "cell", pa.array(names, pa.string()))
        return got

    return rows.groupBy("cell", "chunk").cogroup(picked.groupBy("of", "part")).applyInArrow(nearest, fields)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).reshape(len(column), -1)


def blocks(found: DataFrame, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """Add each class's cell, a path of pivot numbers below its label, so that a cell holds at most ``block`` classes."""
    whole = found.withColumn("cell", F.col("label"))
    done, level = [], 0
    while True:
        sizes = whole.groupBy("cell").agg(F.count("*").alias("n"))
        large = stage(sizes.where(F.col("n") > block), "large-cells")
        if large.isEmpty():
            return _union([*done, whole])
        done.append(whole.join(large, "cell", "left_anti"))
        big = whole.join(large, "cell", "left_semi")
        if level == LEVELS:
            salt = F.pmod(F.xxhash64("h1", "h2"), F.ceil(F.col("n") / block))
            return _union([*done, big.join(large, "cell").withColumn("cell", F.concat_ws(".", "cell", salt.cast("string"))).drop("n")])
        whole, level = stage(_divide(big.select(*found.columns, "cell"), large, block, pivots, level), "vector-cells"), level + 1


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def packed(spread: DataFrame) -> DataFrame:
    """One row for each block: ids, weights, matrix, its cover tree, and a centre and radius that cover it."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["name", "h1", "h2"], kind="stable")
        x = np.stack(pdf["x"].to_numpy()).astype(np.float64)
        tree = CoverTree(x)
        mean = x.mean(axis=0)
        size = np.linalg.norm(mean)
        c = mean / size if size > 1e-9 else x[0]
        return pd.DataFrame({
            "cell": [pdf["cell"].iloc[0]], "matrix": [x.tobytes()], **{out: [pdf[c].to_numpy(np.int64)] for c, out in (("name", "ids"), ("weight", "weights"), ("h1", "h1"), ("h2", "h2"))},
            "vectors": [tree.order.tobytes()], "nodes": [tree.nodes.tobytes()], "centre": [c], "radius": [float(distances(x, c).max())],
        })

    kind = "cell string, matrix binary, ids array<bigint>, weights array<bigint>, h1 array<bigint>, h2 array<bigint>, vectors binary, nodes binary, centre array<double>, radius double"
    return stage(spread.groupBy("cell").applyInPandas(pack, kind), "vector-blocks")


def _dot(p: str, q: str) -> Column:
    return F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)


def _apart(p: str, q: str) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * _dot(p, q)))


def upper_levels(leaves: DataFrame) -> list[DataFrame]:
    """The cells above and with the blocks, from the labels down: level k has (cell, parent, centre, radius) of the paths
    of k pivots. A cell's centre is that of one of its children, and its radius covers them all."""
    depth = F.size(F.split("cell", r"\.(?=[0-9]+(\.[0-9]+)*$)")) - 1
    rows = stage(leaves.select("cell", "centre", "radius", depth.alias("depth")), "cell-0")
    deepest = rows.agg(F.max("depth").alias("d")).first()["d"] or 0
    levels, below = [], None
    for d in range(deepest, -1, -1):
        own = rows.where(F.col("depth") == d).select("cell", "centre", "radius")
        now = own if below is None else own.unionByName(below)
        now = now.withColumn("parent", F.regexp_replace("cell", r"\.[0-9]+$", "") if d else F.lit(""))
        now = stage(now, f"cell-level-{d}")
        levels.append(now)
        heads = now.groupBy("parent").agg(F.min_by("centre", "cell").alias("centre"))
        below = now.join(heads.withColumnRenamed("centre", "head"), "parent").groupBy("parent").agg(F.first("head").alias("centre"), F.max(_apart("centre", "head") + F.col("radius")).alias("radius")).withColumnRenamed("parent", "cell")
    return levels[::-1]


def block_pairs(leaves: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Pairs (one, two) of blocks, one <= two, that their own and their cells' centres and radii don't rule out."""
    reach = float(np.sqrt(2.0 - 2.0 * cosine))
    levels = upper_levels(leaves)
    alive = levels[0].select(F.col("cell").alias("one"), F.col("cell").alias("two"))
    ended = []
    for level in levels[1:]:
        kids = lambda tag, name: level.select(F.col("parent").alias(tag), F.col("cell").alias(name), F.col("centre").alias(f"c_{name}"), F.col("radius").alias(f"r_{name}"))  # noqa: E731, B023
        # a block that has no children meets the other's children itself
        far = alive.join(kids("one", "a"), "one", "left").join(kids("two", "b"), "two", "left")
        far = far.where((F.col("one") != F.col("two")) | (F.col("a") <= F.col("b")) | F.col("a").isNull())
        known = leaves.select(F.col("cell"), F.col("centre"), F.col("radius"))
        both = far.where(F.col("a").isNotNull() & F.col("b").isNotNull())
        near = both.where((F.col("a") == F.col("b")) | (_apart("c_a", "c_b") - F.col("r_a") - F.col("r_b") <= reach + MARGIN)).select(F.col("a").alias("one"), F.col("b").alias("two"))
        half_a = far.where(F.col("a").isNotNull() & F.col("b").isNull()).select(F.col("two").alias("cell"), F.col("a").alias("kid"), F.col("c_a").alias("c"), F.col("r_a").alias("r"))
        half_b = far.where(F.col("b").isNotNull() & F.col("a").isNull()).select(F.col("one").alias("cell"), F.col("b").alias("kid"), F.col("c_b").alias("c"), F.col("r_b").alias("r"))
        mixed = half_a.unionByName(half_b).join(known, "cell").where(_apart("c", "centre") - F.col("r") - F.col("radius") <= reach + MARGIN).select(F.col("cell").alias("one"), F.col("kid").alias("two"))
        ended.append(far.where(F.col("a").isNull() & F.col("b").isNull()).select("one", "two"))
        alive = stage(near.unionByName(mixed), "cell-pairs")
    return _union([alive, *ended]).select(F.least("one", "two").alias("one"), F.greatest("one", "two").alias("two"))


def _groups(leaves: DataFrame, group: int) -> DataFrame:
    """The group of each block: blocks of one label, in the order of their cells, make groups of about ``group`` vectors. Only
    names and sizes of blocks are ordered, no vectors."""
    label = F.regexp_extract("cell", r"^(.*?)(\.[0-9]+)*$", 1)
    before = F.sum("n").over(Window.partitionBy("label").orderBy("cell")) - F.col("n")
    sizes = leaves.select("cell", label.alias("label"), F.size("ids").cast("long").alias("n"))
    return stage(sizes.select("cell", F.xxhash64("label").alias("of"), F.floor(before / group).alias("part")).select("cell", F.struct("of", "part").alias("group")), "block-groups")


def traverse(leaves: DataFrame, cosine: float = COSINE, group: int = GROUP) -> DataFrame:
    """For each pair of blocks that may hold links, a row for each class with any: h1, h2 and a (its name), the weight n of
    its links, and b, the name of its root in the pair's forest.

    The pairs of the blocks of two groups are one task's: so a block is sent once for each group that it meets, not once for
    each block. Both tables are shuffled whatever their size: pairs are many, and pack so well that Spark would take them for
    a small table and broadcast them.
    """
    columns = ("ids", "weights", "h1", "h2", "matrix", "vectors", "nodes")
    known = _groups(leaves, group)
    of = lambda name, tag: known.select(F.col("cell").alias(name), F.col("group").alias(tag))
    pairs = stage(block_pairs(leaves, cosine).hint("shuffle_merge").join(of("one", "g"), "one").join(of("two", "k"), "two"), "block-pairs")
    met = pairs.select("g", "k", F.explode(F.array("one", "two")).alias("cell")).distinct()
    sent = met.hint("shuffle_merge").join(leaves.select("cell", *columns), "cell")
    fields = "h1 bigint, h2 bigint, a bigint, b bigint, n bigint"

    def run(key: tuple, own: pa.Table, asked: pa.Table) -> pa.Table:
        block = {r["cell"]: r for batch in own.select(["cell", *columns]).to_batches(1) for r in _blocks_of(batch)}
        out = []
        for one, two in zip(asked.column("one").to_pylist(), asked.column("two").to_pylist()):
            both = [block[one]] if one == two else [block[one], block[two]]
            w = [r["weights"] for r in both]
            links = dual_links(both[0]["tree"], None if one == two else both[1]["tree"], cosine, *w)
            n, forest = links[0] if one == two else np.concatenate(links[:2]), links[2]
            at = np.flatnonzero(n)
            if len(at):
                ids, h1, h2 = (np.concatenate([r[c] for r in both]) for c in ("ids", "h1", "h2"))
                out.append(np.stack([h1[at], h2[at], ids[at], ids[[forest.find(int(i)) for i in at]], n[at]]))
        found = np.concatenate(out, axis=1) if out else np.zeros((5, 0), np.int64)
        return pa.table([pa.array(c, pa.int64()) for c in found], names=["h1", "h2", "a", "b", "n"])

    asked = pairs.select(F.col("g").alias("p"), F.col("k").alias("q"), "one", "two")
    return sent.groupBy("g", "k").cogroup(asked.groupBy("p", "q")).applyInArrow(run, fields)


def _blocks_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """The blocks of a batch with their cover trees."""
    for row in range(batch.num_rows):
        longs = {c: batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in ("ids", "weights", "h1", "h2")}
        matrix, vectors, nodes = (batch.column(c)[row].as_buffer() for c in ("matrix", "vectors", "nodes"))
        tree = CoverTree(np.frombuffer(matrix).reshape(len(longs["ids"]), -1), np.frombuffer(vectors, np.int64), np.frombuffer(nodes, CoverTree.NODE))
        yield {"cell": batch.column("cell")[row].as_py(), "tree": tree, **longs}


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept for every vector."""
    rows = stage(hashed(valid(vectors)), "unit-vectors")
    found = stage(classes_of(rows), "vector-classes")
    links = stage(traverse(packed(blocks(found, block)), cosine), "vector-links")
    facts = stage(found.select("h1", "h2", "name", "weight").join(links.groupBy("h1", "h2").agg(F.sum("n").alias("n")), ["h1", "h2"], "left"), "class-links")
    members = stage(join_hot(rows.select("vec_id", "h1", "h2"), facts, ["h1", "h2"], "weight"), "vector-members")
    # a name that stands for several classes joins them
    names = members.groupBy("vec_id").agg(F.min("name").alias("least"), F.max("name").alias("most"), F.sum(F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    torn = names.where("least <> most").select("vec_id")
    joined = members.join(torn, "vec_id", "left_semi").select(F.col("vec_id").alias("a"), F.col("name").alias("b"))
    where = components(links.select("a", "b").union(joined)).withColumnRenamed("id", "least")
    sizes = names.groupBy("least").agg(F.count("*").alias("names"))
    labels = stage(where.join(sizes, "least"), "vector-components")
    known = join_hot(stage(names.select("vec_id", "least", "n_links"), "vector-names"), labels, ["least"], "names", "left")
    out = vectors.select("vec_id").join(known, "vec_id", "left")
    component = F.coalesce("component", "least", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
