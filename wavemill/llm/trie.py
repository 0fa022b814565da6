"""The trie of conversations by their first turns, and what its subtrees share.

Turns are numbered, hashed to 128 bits and from then on travel as narrow rows; a prefix is known by the exclusive or of its
turns' hashes, each taken with its place. Nodes are groups of equal prefixes. A node's owner is its smallest member; a
conversation owns the nodes from where it leaves all smaller ones down to its last turn, so (owner, depth) names a node and the
trie falls into paths, one for each owner.

Totals come by leaf-peeling message passing over these paths: each path holds the number of child paths that hang off it; a path
without any left is complete and sends its total to the node it hangs off, whose path counts one less; this goes on until only
the root's path finishes. Chains of single children lie within one path, so a round costs one join of the paths left, and there
are as many rounds as owners stand below each other (a conversation of a thousand turns that no other one follows is one path).
Totals of the nodes of a path are running sums of what it got.

No group is gathered: numbering, prefixes and totals of a path are running sums over ranges (``running``), so that one
conversation may hold a third of all turns; parents with very many children are joined by ``join_hot``; the ids that end in a
node are joined to texts range by range and, where a node spans several ranges, streamed through one digest.

Cases: a null role or text is empty, a null turn comes first. Turns of one number are ordered by role, then by the first 64
characters of the text, then by hash; repeated rows are repeated turns. Rows without a conv_id are left out. An empty table gives
no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavemill.llm.common import join_hot, stage

#: Conversations of one hundred ids share the first turns of the first of them, fewer than ``SHARED``.
BLOCK, SHARED = 100, 6
#: Narrow rows in one range, about.
RANGE_ROWS = 1 << 18


def running(rows: DataFrame, key: str, order: list[Column], n_rows: int, sums: dict[str, str], xors: dict[str, str] | None = None) -> DataFrame:
    """Add inclusive running sums and exclusive ors (name -> long column) in ``order`` within each key.

    Rows are cut into ranges of (key, order); each range is summed by itself, and a key that reaches over several ranges gets
    what its earlier ranges hold. So no task holds a whole key. Only keys at a border between ranges reach over several, so
    what is broadcast has at most two rows for each range.
    """
    ranges = max(1, -(-n_rows // RANGE_ROWS))
    cut = stage(rows.repartitionByRange(ranges, F.col(key), *order).withColumn("range_no", F.spark_partition_id()), "ranges")
    aggs = [(n, c, F.sum, lambda a, b: a + b) for n, c in sums.items()] + [(n, c, F.bit_xor, lambda a, b: a.bitwiseXOR(b)) for n, c in (xors or {}).items()]
    inside = Window.partitionBy(key, "range_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.select("*", *(agg(c).over(inside).alias(f"{n}_here") for n, c, agg, _ in aggs))
    spans = cut.groupBy(key).agg(F.min("range_no").alias("first_no"), F.max("range_no").alias("last_no")).where("first_no < last_no").select(key)
    before = Window.partitionBy(key).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut.join(F.broadcast(spans), key).groupBy(key, "range_no").agg(*(agg(c).alias(f"{n}_all") for n, c, agg, _ in aggs))
    ahead = parts.select(key, "range_no", *(agg(f"{n}_all").over(before).alias(f"{n}_ahead") for n, _, agg, _ in aggs))
    joined = local.join(F.broadcast(ahead), [key, "range_no"], "left")
    return joined.select(*rows.columns, *(both(F.coalesce(f"{n}_ahead", F.lit(0)), F.col(f"{n}_here")).cast("long").alias(n) for n, _, _, both in aggs))


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, head, ha, hb (128 bits of role and text), chars."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.substring(text, 1, 64).alias("head"),
        F.xxhash64(role, text).alias("ha"), F.xxhash64(F.lit("second"), text, role).alias("hb"), F.length(text).cast("long").alias("chars"),
    )


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("head"), F.col("ha"), F.col("hb"), F.col("row_no")]


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Rows of the rebuilt conversations: conv_id, depth, last (whether it is the conversation's end), xa, xb (hashes with
    place; 0 at depth 0), chars. Depth 0 is the root, a row for each conversation."""
    turns = stage(_turns(conversations).withColumn("row_no", F.monotonically_increasing_id()).withColumn("one", F.lit(1)), "turns")
    numbered = stage(running(turns, "conv_id", _order(), turns.count(), {"place": "one"}).select("conv_id", "place", "ha", "hb", "chars"), "numbered")
    sizes = stage(numbered.groupBy("conv_id").agg(F.count("*").alias("n")), "sizes")
    base = F.col("conv_id") - F.col("conv_id") % F.lit(BLOCK)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % F.lit(SHARED)).cast("long")
    based = sizes.withColumn("base", base).withColumn("h", h).join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
    facts = stage(based.withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0)))).withColumn("size", F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h"))), "facts")

    own = join_hot(numbered, facts.select("conv_id", "h", "taken", "size", "n"), ["conv_id"], "n").where("place > h")
    own = own.select("conv_id", (F.col("taken") + F.col("place") - F.col("h")).alias("depth"), "size", "ha", "hb", "chars")
    heads = numbered.where((F.col("place") < SHARED) & (F.col("conv_id") == base)).withColumnRenamed("conv_id", "base")
    lent = facts.where("taken > 0").select("conv_id", "base", "taken", "size").join(heads, "base").where("place <= taken")
    lent = lent.select("conv_id", F.col("place").alias("depth"), "size", "ha", "hb", "chars")
    rows = own.unionByName(lent).select(
        "conv_id", "depth", (F.col("depth") == F.col("size")).alias("last"), F.xxhash64("depth", "ha").alias("xa"), F.xxhash64("hb", "depth").alias("xb"), "chars"
    )
    zero = F.lit(0).cast("long")
    roots = facts.select("conv_id", zero.alias("depth"), (F.col("size") == 0).alias("last"), zero.alias("xa"), zero.alias("xb"), zero.alias("chars"))
    return rows.unionByName(roots)


def _nodes(rows: DataFrame) -> DataFrame:
    """One row for each prefix: depth, pa, pb, qa, qb (its parent's), conv_id (owner), n_convs, chars."""
    return rows.groupBy("depth", "pa", "pb").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("chars").alias("chars"),
        F.min(F.col("pa").bitwiseXOR(F.col("xa"))).alias("qa"), F.min(F.col("pb").bitwiseXOR(F.col("xb"))).alias("qb"),
    )


def _with_parents(nodes: DataFrame) -> DataFrame:
    """Add n_children and parent_conv_id (the parent's owner; null for the root)."""
    above = nodes.where("depth > 0").withColumn("up", F.col("depth") - 1)
    children = above.groupBy(F.col("up").alias("depth"), F.col("qa").alias("pa"), F.col("qb").alias("pb")).agg(F.count("*").alias("n_children"))
    counted = stage(nodes.join(children, ["depth", "pa", "pb"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-nodes")
    parents = counted.where("n_children > 0").select(
        F.col("depth").alias("up"), F.col("pa").alias("qa"), F.col("pb").alias("qb"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("held_by")
    )
    below = join_hot(counted.where("depth > 0").withColumn("up", F.col("depth") - 1), parents, ["up", "qa", "qb"], "held_by").drop("up", "held_by")
    root = counted.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return below.unionByName(root).withColumn("own_saved", (F.col("n_convs") - 1) * F.col("chars")).drop("qa", "qb", "chars")


def peel(paths: DataFrame) -> DataFrame:
    """Leaf-peeling: (path, parent, leaves, saved), leaves and saved a path's own -> path, with the totals of all that hangs
    off it added. A path without a parent is a root."""
    counters = paths.where("parent is not null").groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("remaining"))
    waiting = stage(paths.join(counters, "path", "left").withColumn("remaining", F.coalesce("remaining", F.lit(0))), "peel-0")
    done = None
    turn = 0
    while True:
        complete = waiting.where("remaining = 0")
        totals = complete.select("path", "leaves", "saved")
        done = totals if done is None else done.unionByName(totals)
        left = waiting.where("remaining > 0")
        sent = complete.where("parent is not null").groupBy(F.col("parent").alias("path")).agg(
            F.count("*").alias("n_sent"), F.sum("leaves").alias("leaves_sent"), F.sum("saved").alias("saved_sent")
        )
        turn += 1
        waiting = stage(
            left.join(sent, "path", "left").select(
                "path", "parent", *((F.col(c) + F.coalesce(f"{c}_sent", F.lit(0))).alias(c) for c in ("leaves", "saved")),
                (F.col("remaining") - F.coalesce("n_sent", F.lit(0))).alias("remaining"),
            ), f"peel-{turn}",
        )
        if waiting.isEmpty():
            return done


def _totals(nodes: DataFrame, n_nodes: int) -> DataFrame:
    """Add n_leaves and saved_tokens of each node's subtree."""
    leaf = (F.col("n_children") == 0).cast("long")
    hangs = ~F.col("parent_conv_id").eqNullSafe(F.col("conv_id"))
    own = nodes.groupBy(F.col("conv_id").alias("path")).agg(
        F.max(F.when(hangs, F.col("parent_conv_id"))).alias("parent"), F.min("depth").alias("top"), F.sum(leaf).alias("leaves"), F.sum("own_saved").alias("saved")
    )
    paths = stage(own, "paths")
    totals = stage(peel(paths.drop("top")), "path-totals")
    hung = totals.join(paths.where("parent is not null").select("path", "parent", "top"), "path").groupBy(
        F.col("parent").alias("conv_id"), (F.col("top") - 1).alias("depth")
    ).agg(F.sum("leaves").alias("hung_leaves"), F.sum("saved").alias("hung_saved"))
    got = nodes.join(hung, ["conv_id", "depth"], "left").withColumns(
        {"got_leaves": leaf + F.coalesce("hung_leaves", F.lit(0)), "got_saved": F.col("own_saved") + F.coalesce("hung_saved", F.lit(0))}
    ).drop("hung_leaves", "hung_saved", "own_saved")
    return running(got, "conv_id", [F.col("depth").desc()], n_nodes, {"n_leaves": "got_leaves", "saved_tokens": "got_saved"})


_NODE = "depth long, pa long, pb long, ends_sha256 string"


def _streamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts of ids, in the order of nodes and ranges, through one running digest for each node."""
    node, digest = None, None
    for batch in batches:
        out = []
        for depth, pa, pb, ids in zip(batch["depth"], batch["pa"], batch["pb"], batch["ids"]):
            if (depth, pa, pb) != node:
                if node is not None:
                    out.append((*node, digest.hexdigest()))
                node, digest = (depth, pa, pb), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield pd.DataFrame(out, columns=["depth", "pa", "pb", "ends_sha256"])
    if node is not None:
        yield pd.DataFrame([(*node, digest.hexdigest())], columns=["depth", "pa", "pb", "ends_sha256"])


def end_digests(ends: DataFrame, n_ends: int) -> DataFrame:
    """depth, pa, pb, ends_sha256 of the ids that end in each node, in numeric order."""
    ranges = max(1, -(-n_ends // RANGE_ROWS))
    key = ["depth", "pa", "pb"]
    cut = stage(ends.repartitionByRange(ranges, *key, "conv_id").withColumn("range_no", F.spark_partition_id()), "ends")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = stage(cut.groupBy(*key, "range_no").agg(ids.alias("ids")), "ends-ids")
    spans = stage(pieces.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key), "ends-spans")
    whole = pieces.join(F.broadcast(spans), key, "left_anti").select(*key, F.sha2("ids", 256).alias("ends_sha256"))
    several = pieces.join(F.broadcast(spans), key).repartition(*key).sortWithinPartitions(*key, "range_no")
    return whole.unionByName(several.select(*key, "ids").mapInPandas(_streamed, _NODE))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256; one row for each node."""
    rows = stage(rebuilt(conversations), "rebuilt")
    n_rows = rows.count()
    prefixes = stage(running(rows, "conv_id", [F.col("depth")], n_rows, {}, {"pa": "xa", "pb": "xb"}), "prefixes")
    ends = prefixes.where("last")
    n_ends = ends.count()
    nodes = stage(_with_parents(_nodes(prefixes)), "trie-parents")
    totals = _totals(nodes, nodes.count())
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    found = totals.join(end_digests(ends.select("depth", "pa", "pb", "conv_id"), n_ends), ["depth", "pa", "pb"], "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )


def _crc32_sql(text: str) -> str:
    """Unsigned crc32 of an ASCII text, bit by bit, by its reversed polynomial."""
    bits = "list_reduce(list_prepend(xor(c, ch), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, bit: xor(v >> 1, 3988292384 * (v & 1)))"
    chars = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {chars}), lambda c, ch: {bits}), 4294967295::BIGINT)"


def oracle_sql() -> str:
    return f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, count(*) AS n, {_crc32_sql("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM t GROUP BY conv_id),
f AS (SELECT s.conv_id, s.h, least(s.h, coalesce(b.n, 0)) AS taken FROM s LEFT JOIN s b ON b.conv_id = s.conv_id - s.conv_id % 100),
r AS (
  SELECT f.conv_id, taken + place - h AS depth, role, text FROM f JOIN t USING (conv_id) WHERE place > h
  UNION ALL
  SELECT f.conv_id, place, role, text FROM f JOIN t ON t.conv_id = f.conv_id - f.conv_id % 100 AND place <= taken),
p AS (
  SELECT conv_id, depth, text, list({{'r': role, 't': text}}) OVER (PARTITION BY conv_id ORDER BY depth) AS prefix FROM r
  UNION ALL
  SELECT conv_id, 0, '', [] FROM f),
z AS (SELECT conv_id, max(depth) AS size FROM p GROUP BY conv_id),
n AS (
  SELECT depth, prefix, min(p.conv_id) AS owner, count(*) AS n_convs, (count(*) - 1) * length(any_value(text)) AS saved,
    coalesce(string_agg(CAST(CASE WHEN z.size = depth THEN p.conv_id END AS VARCHAR), ',' ORDER BY p.conv_id), '') AS ends
  FROM p JOIN z ON p.conv_id = z.conv_id GROUP BY depth, prefix),
m AS (SELECT p.conv_id, p.depth, n.owner FROM p JOIN n ON p.depth = n.depth AND p.prefix = n.prefix),
u AS (SELECT n.*, up.owner AS parent FROM n LEFT JOIN m up ON up.conv_id = n.owner AND up.depth = n.depth - 1),
k AS (SELECT parent AS owner, depth - 1 AS depth, count(*) AS n_children FROM u WHERE depth > 0 GROUP BY ALL),
v AS (SELECT u.*, coalesce(k.n_children, 0) AS n_children FROM u LEFT JOIN k ON k.owner = u.owner AND k.depth = u.depth),
g AS (
  SELECT a.owner, a.depth, sum(v.saved) AS saved_tokens, count(*) FILTER (v.n_children = 0) AS n_leaves
  FROM v JOIN m a ON a.conv_id = v.owner AND a.depth <= v.depth GROUP BY ALL)
SELECT v.owner AS conv_id, v.depth, v.parent AS parent_conv_id, v.n_convs, v.n_children, g.n_leaves, CAST(g.saved_tokens AS BIGINT) AS saved_tokens, sha256(v.ends) AS ends_sha256
FROM v JOIN g ON g.owner = v.owner AND g.depth = v.depth"""
