"""MinHash near-deduplication with SuperMinHash signatures.

A document's set holds its distinct word shingles as 64-bit hashes. Each element draws a random permutation of the
signature's slots step by step, and step j can only give values from j to j + 1; a signature is done, and the drawing
stops, as soon as all slots lie below the next step. Documents of equal sets form one class. Class representatives that
agree in all slots of a band are candidates; a pair is a link only if the full sets say so.

Within a bucket not all pairs are formed: members are compared with a hub, the member that lies in most buckets, and
components are made of these links by stars on Spark. Two members of a hub's group that are then still in different
components can only be similar if they differ from the hub in common elements (``left_apart`` says why), so only those
that do are compared as well, on their full sets. No link that a bucket shows is lost, and a group of n edited copies
costs about n comparisons.

With 4 slots a band and 32 bands, two sets of similarity 0.8 share no bucket with a chance of 5e-8, at 0.9 of 1e-15.

Cases: a text without words has an empty set and links with nothing, as does a null text. With fewer words than a
shingle, the whole sequence is the one shingle. A row with a null doc_id is linked with nothing and its component is
null; rows of one doc_id, with one text or several, are one document: each text's links count, and all rows share the
component of the least doc_id that any of them reaches. ``kept`` is true of every row of the least doc_id;
``drop_near_duplicates`` keeps one row of those, that of the least text.
Extra columns aren't carried by ``near_duplicates``. An empty table gives an empty result. Ids may be of any type that
orders.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavemill.llm.common import dealt, join_hot, likely, parted, small_batches, stage
from wavemill.llm.components import components
from wavemill.llm.words import mix, word_hashes

SHINGLE = 5
SLOTS, BAND = 128, 4
PERCENT = 80
_G, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_mix = mix


def shingles(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text."""
    h, n = word_hashes(texts)
    whole = _mix(_rolled(h, size) + np.uint64(size))
    out, at = [], 0
    for k in n.tolist():
        if k >= size:
            out.append(np.unique(whole[at : at + k - size + 1]))
        elif k:
            out.append(_mix(_rolled(h[at : at + k], k) + np.uint64(k)))
        else:
            out.append(h[:0])
        at += k
    return out


def _rolled(v: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k values from each place on."""
    n = max(0, len(v) - k + 1)
    out = v[:n].copy()
    for j in range(1, k):
        out = _mix(out + _G) ^ v[j : j + n] * _A
    return out


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures, one row for each set that isn't empty."""
    h = np.full((len(sets), slots), np.inf)
    flat = h.ravel()
    todo = [k for k, s in enumerate(sets) if len(s)]
    todo.sort(key=lambda k: len(sets[k]))  # like sizes stop at like steps
    at = 0
    while at < len(todo):
        group, size = [], 0
        while at < len(todo) and (not group or size + len(sets[todo[at]]) <= 40_000):
            group.append(todo[at])
            size += len(sets[todo[at]])
            at += 1
        _sign_group(flat, [sets[k] for k in group], np.array(group), slots)
    return h


def _sign_group(flat: np.ndarray, sets: list[np.ndarray], row: np.ndarray, slots: int) -> None:
    seed = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    base = row[owner] * slots
    perm = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(seed), 1))
    own = np.arange(len(seed))
    h = flat.reshape(-1, slots)
    live = row
    for j in range(slots):
        z = _mix(seed[own] + np.uint64(int(_G) * (j + 1) % (1 << 64)))
        k = j + (((z >> np.uint64(32)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)
        slot = perm[own, k]
        perm[own, k] = perm[own, j]
        np.minimum.at(flat, base[own] + slot, j + (z & np.uint64(0xFFFFFFFF)).astype(np.float64) / 2.0**32)
        left = h[live].max(axis=1) >= j + 1
        if not left.all():
            live = live[left]
            if not len(live):
                break
            going = np.zeros(len(h), bool)
            going[live] = True
            own = own[going[row[owner[own]]]]


def band_hashes(signature: np.ndarray, band: int = BAND) -> np.ndarray:
    """A 64-bit hash of each band of each row; the band's number is part of it."""
    bits = signature.view(np.uint64).reshape(len(signature), -1, band)
    out = np.broadcast_to(np.arange(1, bits.shape[1] + 1, dtype=np.uint64) * _G, bits.shape[:2]).copy()
    for j in range(band):
        out = _mix(out + _G) ^ bits[:, :, j] * _B
    return _mix(out).view(np.int64)


def signed(docs: DataFrame, size: int, slots: int = SLOTS, band: int = BAND) -> DataFrame:
    """doc_id, n_shingles, the set's 128-bit digest (null: empty set or id) and its band hashes."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}
        for batch in batches:
            ids, sets = batch.column("doc_id"), shingles(batch.column("text").to_pylist(), size)
            has_id = ids.is_valid().to_pylist()
            digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) and ok else None for s, ok in zip(sets, has_id)]
            new = {d: s for d, s in zip(digest, sets) if d is not None and d not in known}
            if len(known) > 20_000:
                known.clear()
                new = {d: s for d, s in zip(digest, sets) if d is not None}
            if new:
                known |= dict(zip(new, band_hashes(signatures(list(new.values()), slots), band)))
            n_bands = slots // band
            rows = [known[d] for d in digest if d is not None]
            offsets = np.concatenate([[0], np.cumsum([n_bands if d is not None else 0 for d in digest])]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), bands], names=["doc_id", "n_shingles", "digest", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles bigint, digest binary, bands array<bigint>")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """id and its set as an array, of documents with an ``id``, a ``text`` and the ``digest`` of the set: a text with another
    set, of the same doc_id, is left out."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = shingles(batch.column("text").to_pylist(), size)
            own = [k for k, (s, d) in enumerate(zip(got, batch.column("digest").to_pylist())) if xxhash.xxh3_128_digest(s.tobytes()) == d]
            sets = [got[k].view(np.int64) for k in own]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            elements = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(own, pa.int64())), elements], names=["id", "elements"])

    return docs.select("id", "text", "digest").mapInArrow(run, "id bigint, elements array<bigint>")


def compared(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Staged pairs (a, b) with the sizes of their sets (na, nb) and of what they have in common, the elements that b has and a
    hasn't, and whether the common part is at least ``percent`` hundredths of the union."""
    left = sets.select(F.col("id").alias("a"), F.col("elements").alias("ea"))
    right = sets.select(F.col("id").alias("b"), F.col("elements").alias("eb"))
    narrow, hubs = dealt(pairs, left, "a", "b")
    both = narrow.join(right, "b").join(hubs, ["a", "group_no"]).withColumn("added", F.array_except("eb", "ea"))
    na, nb = F.size("ea").cast("long"), F.size("eb").cast("long")
    common = nb - F.size("added")
    return both.select(*pairs.columns, na.alias("na"), nb.alias("nb"), common.alias("common"), "added", (100 * common >= percent * (na + nb - common)).alias("linked"))


def hub_pairs(members: DataFrame) -> DataFrame:
    """Each member of a bucket with the bucket's hub: the member that lies in most buckets, then the least id.

    The common original of edited copies shares more buckets with them than they do with one another.
    """
    known = members.groupBy("id").agg(F.count("*").alias("n"))
    scored = stage(members.join(known, "id"), "scored")
    hubs = stage(scored.groupBy("bucket").agg(F.min(F.struct((-F.col("n")).alias("few"), "id")).alias("hub"), F.count("*").alias("size")).select("bucket", F.col("hub.id").alias("a"), "size"), "bucket-hubs")
    return join_hot(scored, hubs, ["bucket"], "size").where(F.col("a") != F.col("id")).select("a", F.col("id").alias("b")).distinct()


def labelled(rows: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    """Add the component of an id as a column; an id without links is its own."""
    sizes = rows.groupBy(column).agg(F.count("*").alias("_n"))
    by = stage(labels.select(F.col("id").alias(column), F.col("component")).join(sizes, column), "labels")
    return join_hot(rows, by, [column], "_n", "left").withColumn(name, F.coalesce("component", column)).drop("component", "_n")


def left_apart(groups: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (x, y) of one hub's group that may be links though hub and x aren't, from rows (a, b, na, nb, common, added,
    la, lb): hub a, member b, and their components.

    Let b add A and lack R of the hub's elements. x and y are similar only if their sets differ in at most a share q of
    the sum of their sizes, q = (100 - percent) / (100 + percent). As both differ from the hub in known elements, that
    needs 2 |A_x and A_y| >= g_x - (1 - q) h_y, with g_x = |A_x| + |R_x| - q (|x| + |hub|), positive as x isn't similar
    to the hub, and h_y = |R_y| - |A_y|. So x and y must share added elements, which are rare within a group of copies,
    unless y is so much smaller than the hub that the right side isn't positive. Nothing else can be a link.

    The same holds with x and y exchanged, and their sizes differ by the share ``percent`` at most, which bounds h_y for
    an x and a class of sizes. So x needs a least weight t of common elements, and with the elements in one order, rare
    ones first, the first common one has at least t of weight from it on, in x as in y. Only such elements are joined:
    those that most members of a group add are at the end of the order and make no pairs.
    """
    p, q, slack = percent / 100, (100 - percent) / (100 + percent), 1e-6
    added, lacking = F.size("added"), F.col("na") - F.col("common")
    rows = groups.withColumn("g", added + lacking - q * (F.col("na") + F.col("nb"))).withColumn("h", (lacking - added).cast("double"))
    held = (
        rows.select("a", "b", "lb", F.explode("added").alias("e"))
        .groupBy("a", "e")
        .agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("b")).alias("who"), F.min("b").alias("lo"), F.max("b").alias("hi"), F.min("lb").alias("one"), F.max("lb").alias("two"))
        .where("one <> two")
    )
    # elements that the same members add (an inserted passage) are one element with a weight
    weight = held.groupBy("a", "n", "who", "lo", "hi").agg(F.min("e").alias("e"), F.count("*").alias("w")).select("a", "e", "n", "w")
    from_here = Window.partitionBy("a", "b").orderBy(F.desc("n"), F.desc("e")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = ["a", "b", "la", "lb", "na", "nb", "g", "h"]
    elements = rows.select(*own, F.explode("added").alias("e")).join(weight, ["a", "e"]).withColumn("s", F.sum("w").over(from_here))
    needed = lambda least_size: (F.col("g") - (1 - q) * (F.col("na") - least_size) - slack) / 2
    x_classes = F.sequence(_size_class(p * F.col("nb")), _size_class(F.col("nb") / p))
    x_named = lambda df: df.select("a", F.col("b").alias("x"), F.col("lb").alias("lx"), F.col("g").alias("gx"), F.col("h").alias("hx"), "c", *([c for c in df.columns if c in ("e", "s")]))
    y_named = lambda df: df.select("a", F.col("b").alias("y"), F.col("lb").alias("ly"), F.col("g").alias("gy"), F.col("h").alias("hy"), _size_class(F.col("nb")).alias("c"), *([c for c in df.columns if c in ("e", "s")]))
    least_of_class = F.pow(F.lit(_SIZE_STEP), F.col("c")) * (1 - 1e-9)
    ex = x_named(elements.where("la <> lb").withColumn("c", F.explode(x_classes)).where(F.col("s") >= needed(F.greatest(p * F.col("nb"), least_of_class)))).withColumnRenamed("s", "sx")
    ey = y_named(elements.where(F.col("s") >= needed(p * F.col("nb")))).withColumnRenamed("s", "sy")
    apart = F.col("lx") != F.col("ly")
    need = F.greatest(F.col("gx") - (1 - q) * F.col("hy"), F.col("gy") - (1 - q) * F.col("hx")) - slack
    sharing = ex.join(ey, ["a", "c", "e"]).where(apart & (2 * F.least("sx", "sy") >= need))
    x = x_named(rows.where("la <> lb").withColumn("c", F.explode(x_classes)))
    smaller = x.join(y_named(rows.where("h > 0")), ["a", "c"]).where(apart & (need <= 0))
    return sharing.select("x", "y").union(smaller.select("x", "y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


#: Sizes of one class differ by less than this factor.
_SIZE_STEP = 1.12


def _size_class(size: Column) -> Column:
    return F.floor(F.log(size.cast("double")) / F.lit(math.log(_SIZE_STEP)) + F.lit(1e-9))


def links_between(members: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Confirmed links (a, b) that connect all candidates of (bucket, id) as far as their sets do."""
    groups = stage(compared(stage(hub_pairs(members), "hub-pairs"), sets, percent), "hub-groups")
    links = groups.where("linked").select("a", "b")
    labels = components(links)
    named = stage(labelled(stage(labelled(groups, labels, "a", "la"), "hub-named"), labels, "b", "lb"), "both-named")
    more = stage(compared(stage(left_apart(named, percent), "apart-pairs"), sets, percent).where("linked").select("a", "b"), "apart-links")
    return links.union(more)


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row."""
    rows = _judged(docs.select("doc_id", "text"), size, percent)
    component = F.coalesce("component_id", "doc_id")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _judged(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, the digest of the set, and component_id (null: no set) of every row."""
    rows = stage(signed(docs, size), "signatures")
    # one node for each class of equal sets, numbered; its rows' least doc_id is its name
    classes = rows.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("name"), F.min("bands").alias("bands"), F.count("*").alias("n"))
    classes = stage(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    exploded = classes.select("id", F.explode("bands").alias("bucket"))
    several = exploded.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("bucket")
    members = stage(exploded.join(several, "bucket"), "buckets")
    links = links_between(members, stage(_sets_of(docs, members, classes, size), "sets"), percent)
    return _named(rows, classes, links)


def _sets_of(docs: DataFrame, members: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """id and full set of the classes that have candidates, made of the text of one document of each."""
    wanted = stage(classes.join(members.select("id").distinct(), "id", "left_semi").select("name", "id", "digest"), "wanted")
    near = likely(docs, "doc_id", wanted, "name")
    found = full_sets(near.join(wanted, near["doc_id"] == wanted["name"]), size)
    return found.groupBy("id").agg(F.first("elements").alias("elements"))  # of repeated rows


def _named(rows: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """Add to every row the least doc_id of its component; texts of one doc_id are one document."""
    own = F.xxhash64("digest")
    torn = rows.where(F.col("digest").isNotNull()).groupBy("doc_id").agg(F.min(own).alias("lo"), F.max(own).alias("hi")).where("lo <> hi").select("doc_id")
    texts = rows.join(torn, "doc_id", "left_semi").select("doc_id", "digest").distinct().join(classes.select("digest", "id"), "digest")
    same = texts.join(texts.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").select("a", F.col("id").alias("b"))
    found = components(links.union(same))
    nodes = stage(found.unionByName(found.select(F.col("component").alias("id"), "component").distinct()).join(classes.select("id", "name"), "id"), "linked")
    least = stage(nodes.groupBy("component").agg(F.min("name").alias("component_id"), F.count("*").alias("nodes")), "component-names")
    by_node = join_hot(nodes, least, ["component"], "nodes").select("id", "component_id")
    named = stage(classes.select("digest", "id", "n", "name").join(by_node, "id", "left").select("digest", F.coalesce("component_id", "name").alias("component_id"), "n"), "named")
    return join_hot(rows.select("doc_id", "n_shingles", "digest"), named, ["digest"], "n", "left").drop("n")


def drop_near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each component stays, the one of the smallest doc_id, with its own columns."""
    rows = stage(_judged(docs.select("doc_id", "text"), size, percent).where(F.col("digest").isNotNull()).select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id")), "judged")
    gone = stage(rows.where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    again = stage(rows.where("component_id = doc_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    every = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"))
    near, others = parted(every, "id", gone, "doc_id")  # only texts that may go are shuffled to the ids that go
    kept = near.join(gone, near["id"] == gone["doc_id"], "left_anti").unionByName(others).select("row.*")
    if again.isEmpty():
        return kept
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct(F.col("text").isNull(), "text")).alias("row")).select("row.*")
    return kept.join(again, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(one)
