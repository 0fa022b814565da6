"""Near-duplicates of texts and vectors, components and passages against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.llm import common, components, covertree, minhash, passages, words as word_module
from wavemill.llm.words import word_hashes


def union_find(n, links):
    up = {i: i for i in n}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in n}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "none"])
def test_components(spark, kind):
    r = random.Random(4)
    links = {"chain": [(k, k + 1) for k in range(60)], "star": [(7, k) for k in range(40)] + [(100, 100)], "random": [(r.randrange(80), r.randrange(80)) for _ in range(50)], "none": []}[kind]
    got = {x["id"]: x["component"] for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = union_find({x for p in links for x in p}, links)
    assert {i: got.get(i, i) for i in want} == want


def grams(t, k):
    w = [x.lower() for x in (t or "").split()]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k):
    sets = {i: grams(t, k) for i, t in rows if i is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, union_find(sets, links)


def copies(r, n, words, edits, vocabulary=5000):
    base = [f"w{r.randrange(vocabulary)}" for _ in range(words)]
    out = [base]
    for _ in range(n):
        c = list(base)
        for _ in range(r.randrange(edits + 1)):
            at = r.randrange(len(c))
            kind = r.randrange(3)
            if kind == 0:
                c[at] = f"e{r.randrange(vocabulary)}"
            elif kind == 1:
                c.insert(at, "extra")
            elif len(c) > 3:
                del c[at]
        out.append(c)
    return [" ".join(c) for c in out]


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_against_all_pairs(spark, size):
    r = random.Random(size)
    texts = copies(r, 60, 80, 14) + copies(r, 25, 30, 4) + copies(r, 10, 200, 40) + ["", None, "one", "one", "One", "two words", "Two  words", "a b c d e f"] + [" ".join(f"u{r.randrange(999)}" for _ in range(50)) for _ in range(20)]
    texts += texts[:15] + ["long " * 3000]
    r.shuffle(texts)
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + [(None, texts[0])], "doc_id long, text string").withColumn("kept", F.lit("clash"))
    got = minhash.near_duplicates(df, size).collect()
    n, want = brute(rows, size)
    assert len(got) == len(rows) + 1
    by = {x["doc_id"]: x for x in got if x["doc_id"] is not None}
    assert {i: x["component_id"] for i, x in by.items()} == want
    assert {i: x["n_shingles"] for i, x in by.items()} == n
    assert all(x["kept"] == (x["component_id"] == i) for i, x in by.items())
    null = next(x for x in got if x["doc_id"] is None)
    assert null["component_id"] is None and null["kept"]


def test_pairs_apart_from_their_hub_are_found(spark):
    """Two families share a bucket whose hub is of the first; the links of the second family aren't lost."""
    base = [f"b{i}" for i in range(40)]
    other = base[:26] + [f"o{i}" for i in range(14)]
    sets = {1: base, 2: base[:39], 3: other, 4: other[:39], 5: base[:24], 6: base[:23]}
    table = spark.createDataFrame([(i, [hash(x) for x in s]) for i, s in sets.items()], "id long, elements array<long>")
    members = spark.createDataFrame([(7, i) for i in sets] + [(8, 1), (9, 1)], "bucket long, id long")
    links = [(r["a"], r["b"]) for r in minhash.links_between(members, table).collect()]
    like = lambda a, b: 100 * len(set(sets[a]) & set(sets[b])) >= 80 * len(set(sets[a]) | set(sets[b]))
    want = [(a, b) for a in sets for b in sets if a < b and like(a, b)]
    assert union_find(sets, links) == union_find(sets, want)


def test_signatures_estimate_similarity():
    r = np.random.default_rng(0)
    got = []
    for _ in range(60):
        x = r.integers(0, 2**63, 300, dtype=np.uint64)
        h = minhash.signatures([np.unique(x[:200]), np.unique(x[50:250])])
        got.append((h[0] == h[1]).mean())
    assert np.mean(got) == pytest.approx(0.6, abs=0.02)
    assert np.isfinite(minhash.signatures([np.array([5], np.uint64)])).all()


def test_dropping_keeps_one_of_each_group(spark):
    r = random.Random(9)
    texts = copies(r, 5, 60, 1) + [None, ""]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    kept = minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(x["doc_id"] for x in kept.collect()) == [0, 6, 7]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_texts_of_one_id_are_one_document(spark):
    r = random.Random(10)
    one, two, three = copies(r, 6, 40, 2), copies(r, 6, 50, 2), copies(r, 2, 30, 1)
    rows = [(4, one[0]), (9, one[1]), (9, two[0]), (12, two[1]), (12, two[1]), (3, three[0]), (3, "something else altogether here now"), (8, three[1]), (20, "alone")]
    rows = [(str(i).zfill(2), t, k) for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id string, text string, n_shingles int")
    got = {(x["doc_id"], x["n_shingles"]): x["component_id"] for x in minhash.near_duplicates(df, 2, 60).collect()}
    texts = {i: [] for i, _, _ in rows}
    for i, t, _ in rows:
        texts[i].append(grams(t, 2))
    links = [(a, b) for a in texts for b in texts if any(100 * len(x & y) >= 60 * len(x | y) for x in texts[a] for y in texts[b])]
    want = union_find(sorted(texts), links)
    assert {i: c for (i, _), c in got.items()} == want
    kept = minhash.drop_near_duplicates(df, 2, 60)
    assert kept.columns == df.columns and sorted(x["doc_id"] for x in kept.collect()) == sorted({c for c in want.values()})


def test_cover_tree_covers_and_nests():
    r = np.random.default_rng(3)
    x = r.standard_normal((300, 8))
    x[100:200] = x[0] + 0.05 * r.standard_normal((100, 8))
    x[250:260] = x[250]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = covertree.CoverTree(x)
    assert sorted(t.order) == list(range(300))
    for k in range(len(t.center)):
        own = t.below(k)
        assert covertree.distances(x[own], x[t.center[k]]).max() <= t.radius[k] + 1e-6
        if t.kids[k]:
            assert sum(len(t.below(c)) for c in t.children(k)) == len(own) and t.center[t.first_kid[k]] == t.center[k]


@pytest.mark.parametrize("dim", [12, 64, 128, 384, 768])
def test_trees_of_copies_end(dim):
    r = np.random.default_rng(dim)
    for _ in range(200):
        v = r.standard_normal(dim)
        x = np.tile(v / np.linalg.norm(v), (int(r.integers(1, 60)), 1))
        links, _, forest = covertree.dual_links(covertree.CoverTree(x), None)
        assert (links == len(x) - 1).all() and len({forest.find(i) for i in range(len(x))}) == 1
    x = x[:1] + 1e-8 * r.standard_normal((400, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert (covertree.dual_links(covertree.CoverTree(x), None)[0] == 399).all()


@pytest.mark.parametrize("spread", [0.02, 0.3, 3.0])
def test_dual_traversal_against_all_pairs(spread):
    r = np.random.default_rng(7)
    x = np.repeat(r.standard_normal((20, 10)), 15, axis=0) + spread * r.standard_normal((300, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w = r.integers(1, 5, 300)
    near = x @ x.T >= 0.98
    np.fill_diagonal(near, False)
    assert (covertree.dual_links(covertree.CoverTree(x), None, 0.98, w)[0] == near @ w).all()
    a, b, _ = covertree.dual_links(covertree.CoverTree(x[:130]), covertree.CoverTree(x[130:]), 0.98, w[:130], w[130:])
    assert (a == near[:130, 130:] @ w[130:]).all() and (b == near[130:, :130] @ w[:130]).all()


def test_cells_of_several_levels_keep_every_pair(spark):
    """Pivots of pivots: with small blocks the upper levels are three deep, and repeated names stand for several vectors."""
    r = np.random.default_rng(8)
    x = np.repeat(r.standard_normal((150, 6)), 8, axis=0) + 0.05 * r.standard_normal((1200, 6))
    x[400:700] = x[5]
    name = [int(i) for i in r.permutation(1200)]
    name[10:14] = name[20:24]
    label = (np.arange(1200) % 11 == 0).astype(int)
    df = spark.createDataFrame([(name[i], int(label[i]), x[i].tolist()) for i in range(1200)], "vec_id long, label int, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    links = {}
    for i in range(1200):
        links[name[i]] = links.get(name[i], 0) + int(near[i].sum())
    want = union_find(set(name), [(name[a], name[b]) for a, b in zip(*np.nonzero(near)) if a < b])
    rows = covertree.hashed(covertree.valid(df))
    cells = covertree.blocks(covertree.classes_of(rows), 16, 4)
    assert max(c.count(".") for c, in cells.select("cell").distinct().collect()) >= 3 and cells.groupBy("cell").count().agg(F.max("count")).first()[0] <= 16
    assert cells.count() == len({(label[i], *x[i]) for i in range(1200)})
    got = covertree.near_duplicates(df, block=16).collect()
    assert {v["vec_id"]: (v["n_links"], v["component_id"]) for v in got} == {i: (links[i], want[i]) for i in links}


@pytest.mark.parametrize("most", [1 << 26, 1 << 17])
def test_likely_rows_hold_all_that_are_wanted_and_few_others(spark, monkeypatch, most):
    monkeypatch.setattr(common, "MOST_BITS", most)
    rows = spark.range(-20_000, 20_000).select(F.when(F.col("id") != 5, F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    wanted = spark.range(-20_000, 20_000, 4).withColumnRenamed("id", "name")
    got = common.likely(rows, "doc_id", wanted, "name")
    assert got.columns == rows.columns
    got = [r["doc_id"] for r in got.collect()]
    assert len(got) == len(set(got)) and set(range(-20_000, 20_000, 4)) <= set(got) and len(got) < 10_000 + 30_000 * (10_000 / most + 0.08)
    assert common.likely(rows, "doc_id", wanted.limit(0), "name").count() == 0
    text = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    assert common.likely(text, "doc_id", wanted.selectExpr("cast(name as string) name"), "name").where("doc_id % 4 = 0").count() == 10_000


def test_texts_without_candidates_are_not_shuffled(spark):
    r = random.Random(21)
    docs = spark.createDataFrame([(i, " ".join(words(r, 40))) for i in range(200)] + [(900, "a b c d e f"), (901, "a b c d e f g")], "doc_id long, text string")
    members = spark.createDataFrame([(0, 7), (1, 7)], "id long, bucket long")
    rows = minhash.signed(docs.where("doc_id >= 900"), 2).where("digest is not null")
    classes = common.stage(rows.select("digest", F.col("doc_id").alias("name"), "bands", (F.col("doc_id") - 900).alias("id")), "some-classes")
    got = minhash._sets_of(docs, members, classes, 2)
    assert sorted(r["id"] for r in got.collect()) == [0, 1]
    assert "_map" in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("most", [1 << 26, 1 << 15])
def test_parted_rows_are_all_there_once(spark, monkeypatch, most):
    monkeypatch.setattr(common, "MOST_BITS", most)
    rows = spark.range(-3_000, 3_000).select(F.when(F.col("id") != 5, F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    wanted = spark.range(-3_000, 3_000, 4).withColumnRenamed("id", "name")
    parts = common.parted(rows, "doc_id", wanted, "name")
    near, rest = (sorted(r["doc_id"] for r in x.where("doc_id is not null").collect()) for x in parts)
    assert sorted(near + rest) == [k for k in range(-3_000, 3_000) if k != 5] and set(range(-3_000, 3_000, 4)) <= set(near) and len(near) < 3_000
    assert all(x.columns == rows.columns for x in parts) and sum(x.where("doc_id is null").count() for x in parts) == 1
    near, rest = common.parted(rows, "doc_id", wanted.limit(0), "name")
    assert near.count() == 0 and rest.count() == 6_000


def test_texts_that_stay_as_they_are_are_not_shuffled(spark):
    """Without a broadcast of what is joined, as with many documents, only texts that may change or go are dealt out."""
    r = random.Random(22)
    p = words(r, 60)
    docs = [(i, " ".join(words(r, 40))) for i in range(300)] + [(900, " ".join(words(r, 30) + p)), (901, " ".join(p + words(r, 30))), (902, " ".join(p + words(r, 31)))] + [(None, "x"), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    again = df.union(df.where("doc_id < 10").withColumn("doc_id", F.col("doc_id") + 5000))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for got, changed in ((passages.cut(df), {901, 902}), (minhash.drop_near_duplicates(again), set())):
            rows = got.collect()
            plan = got._jdf.queryExecution().optimizedPlan().toString()
            assert "_map" in plan and "Union" in plan
            assert sorted(str(x["doc_id"]) for x in rows) == sorted(str(i) for i, _ in docs)
            assert {x["doc_id"] for x in rows if x["doc_id"] is not None and x["text"] != dict(docs)[x["doc_id"]]} == changed
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_an_overfull_cell_makes_few_blocks_and_no_pairs_are_broadcast(spark):
    x = np.random.default_rng(3).standard_normal((1100, 8))
    df = spark.createDataFrame([(i, 1, v) for i, v in enumerate(x.tolist())], "vec_id long, label int, embedding array<double>")
    cells = covertree.blocks(covertree.classes_of(covertree.hashed(covertree.valid(df))))
    leaves = covertree.packed(cells)
    assert 2 <= leaves.count() <= 24
    assert "Broadcast" not in covertree.traverse(leaves)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [16, 1024])
def test_vectors_against_all_pairs(spark, block):
    r = np.random.default_rng(block)
    x = r.standard_normal((240, 12))
    for k in range(60, 160):
        x[k] = x[r.integers(0, 6)] * r.uniform(0.5, 3) + 0.08 * r.standard_normal(12)
    x[160:175] = x[3]
    label = r.integers(0, 3, 240)
    label[60:175] = 1
    label[:6] = 1
    rows = [(int(i), int(label[i]), x[i].tolist()) for i in range(240)]
    odd = [(500, None, [1.0] * 12), (501, 1, None), (502, 1, [0.0] * 12), (503, 1, [float("nan")] * 12), (504, 1, []), (505, 1, [1.0, None]), (506, 1, [1e300] * 12), (507, 1, [2e-300] * 12), (None, 1, [1.0] * 12)]
    df = spark.createDataFrame(rows + odd, "vec_id long, label int, embedding array<double>").withColumn("n_links", F.lit("clash"))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    got = {v["vec_id"]: v for v in covertree.near_duplicates(df, block=block).collect()}
    assert len(got) == 249
    want = union_find(range(240), [(int(a), int(b)) for a, b in zip(*np.nonzero(near)) if a < b])
    for i in range(240):
        assert (got[i]["n_links"], got[i]["component_id"]) == (near[i].sum(), want[i])
    assert got[506]["component_id"] == 506 and got[507]["component_id"] == 506 and got[507]["n_links"] == 1
    for i in (500, 501, 502, 503, 504, 505):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[None]["n_links"] == 0 and got[None]["component_id"] is None
    assert covertree.near_duplicates(df.limit(0)).count() == 0


def words(r, n):
    return [f"w{r.randrange(50_000)}" for _ in range(n)]


def test_planted_passages_are_found_and_cut(spark):
    r = random.Random(5)
    p, q, z = words(r, 60), words(r, 80), words(r, 55)
    fuzzy = list(q)
    for at in (7, 23, 41, 60):
        fuzzy[at] = "changed"
    docs = [
        (1, " ".join(words(r, 100) + p + words(r, 30))), (2, " ".join(p + words(r, 20))), (3, " ".join(words(r, 33) + [x.upper() for x in p])), (4, " ".join(q + words(r, 10))),
        (5, "\n".join(words(r, 20) + fuzzy + words(r, 30))), (6, " ".join(words(r, 400))), (7, None), (8, ""), (9, "a b c"), (10, " ".join(words(r, 10) + z + words(r, 5) + z)),
        (11, " ".join(words(r, 3) + z[:30] + words(r, 40) + z[30:])), (12, " ".join(words(r, 2) + z + words(r, 9))), (None, " ".join(p)),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    got = {(x["doc_id"], x["source_id"]): (x["start_word"], x["end_word"]) for x in passages.find(df).collect()}
    assert got[(2, 1)] == (0, 60) and got[(3, 1)] == (33, 93) and got[(12, 10)] == (2, 57)
    a, b = got[(5, 4)]
    assert abs(a - 20) <= 2 and abs(b - 100) <= 2 and {d for d, _ in got} == {2, 3, 5, 12}
    cut = passages.cut(df)
    assert cut.columns == df.columns
    left = {x["doc_id"]: x for x in cut.collect()}
    text = dict(docs)
    assert len(left[2]["text"].split()) == 20 and left[2]["n_chars"] == len(left[2]["text"]) and left[1]["text"] == text[1] and left[6]["text"] == text[6] and left[7]["text"] is None
    assert left[None]["text"] == text[None]
    assert passages.find(df.limit(0)).count() == 0


def test_hashes_of_words(monkeypatch):
    monkeypatch.setattr(word_module, "PIECE", 300)
    r = random.Random(3)
    alphabet = "abAB \t\n\x0b\x1c\xa0é𝒜\u2028"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(900))) for _ in range(60)] + [None, "", " ", "x" * 1000, "\ud800 a"]
    h, n = word_hashes(texts)
    own = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts]
    assert n.tolist() == [len(x) for x in own] and len(h) == n.sum()
    flat = [w for x in own for w in x]
    assert len(set(h.tolist())) == len(set(flat)) == len(set(zip(flat, h.tolist())))


def test_keys_do_not_depend_on_the_batch():
    r = random.Random(4)
    texts = [" ".join(words(r, r.randrange(120))) for _ in range(40)] + ["again " * 300, "", None, "again " * 60]
    key, owner, at = passages.keys_of(*word_hashes(texts))
    for k, t in enumerate(texts):
        one, _, where = passages.keys_of(*word_hashes([t]))
        assert sorted(zip(key[owner == k].tolist(), at[owner == k].tolist())) == sorted(zip(one.tolist(), where.tolist()))


def test_seeds_of_a_shared_run_meet():
    r = random.Random(6)
    for _ in range(50):
        run = words(r, passages.K + passages.W - 1)
        a, b = words(r, r.randrange(40)) + run + words(r, 30), words(r, r.randrange(40)) + run + words(r, 9)
        one, two = (set(passages.seeds(*word_hashes([" ".join(t)]))[0].tolist()) for t in (a, b))
        assert one & two


def test_chains_against_plain_dynamic_programming():
    r = random.Random(7)
    for _ in range(200):
        at = sorted({(r.randrange(60), r.randrange(60)) for _ in range(r.randrange(1, 25))})
        xs, ys = [x for x, _ in at], [y for _, y in at]
        best = []
        for i in range(len(at)):
            best.append(passages.K + max([0.0, *(best[j] - passages.GAP_COST * (xs[i] - xs[j] + ys[i] - ys[j]) for j in range(i) if xs[j] < xs[i] and ys[j] < ys[i])]))
        cx, cy = passages.chain(xs, ys)[0]
        assert all(a < b for a, b in zip(cx, cx[1:])) and all(a < b for a, b in zip(cy, cy[1:]))
        score = passages.K
        for p in range(1, len(cx)):
            score = passages.K + max(0.0, score - passages.GAP_COST * (cx[p] - cx[p - 1] + cy[p] - cy[p - 1]))
        if max(xs) - min(xs) <= passages.MAX_SHIFT and max(ys) - min(ys) <= passages.MAX_SHIFT:
            assert score == pytest.approx(max(best))


def test_long_and_repetitive_texts(spark):
    docs = [(1, "again " * 5000), (2, "again " * 4000 + "end"), (3, " ".join(f"t{i}" for i in range(30_000))), (4, " ".join(f"t{i}" for i in range(10_000, 30_000)))]
    got = {x["doc_id"]: x for x in passages.find(spark.createDataFrame(docs, "doc_id long, text string")).where("n_words > 1000").collect()}
    assert got[4]["start_word"] == 0 and got[4]["end_word"] == 20_000 and got[4]["source_start"] == 10_000


def test_a_line_said_again_and_again_asks_for_words_once_a_pair(spark, monkeypatch):
    r, staged = random.Random(14), {}
    docs = [(i, " ".join(words(r, 30) + ["is", "one."] * (40 + i) + words(r, 30))) for i in range(12)]
    monkeypatch.setattr(passages, "stage", lambda df, name: staged.setdefault(name, common.stage(df, name)))
    found = passages.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x["doc_id"] for x in found} == set(range(1, 12))
    pairs = staged["chains"].select(*passages.PAIR).distinct().count()
    assert staged["chains"].count() == pairs and staged["requests"].agg(F.sum("n")).first()[0] == 2 * pairs


def test_chains_get_their_own_words_out_of_the_words_of_all():
    r = random.Random(15)
    for _ in range(200):
        n = r.randrange(30, 2000)
        h = list(range(n))
        chains = [sorted(r.sample(range(max(0, at - 40), min(n - 1, at + 40)), 3)) for at in (r.randrange(n) for _ in range(r.randrange(1, 9)))]
        first, end = passages.reached(chains)
        assert all(a < b for a, b in zip(first, end)) and all(b < a for a, b in zip(first[1:], end))
        every = [w for a, b in zip(first, end) for w in h[a:b]]
        for c in chains:
            lo, own = passages.own_words(every, first, end, c)
            assert lo == max(0, c[0] - passages.REACH) and own == h[lo : c[-1] + passages.B + passages.REACH]


def test_passages_with_other_words_between_are_judged_apart(spark):
    r = random.Random(11)
    docs, want = [], []
    for d in range(0, 40, 2):
        same = [words(r, 51) for _ in range(4)]
        one, two = words(r, 5), words(r, 9)
        for p in same:
            want.append((d + 1, len(two), len(two) + 51))
            one, two = one + p + words(r, 20), two + p + words(r, 20)
        docs += [(d, " ".join(one)), (d + 1, " ".join(two))]
    got = passages.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    missed = [x for x in want if not any(g["doc_id"] == x[0] and g["start_word"] <= x[1] and g["end_word"] >= x[2] for g in got)]
    assert not missed


def test_passages_whose_pieces_stand_in_earlier_documents(spark):
    r = random.Random(12)
    docs, want = [], []
    for d in range(0, 800, 20):
        lines = [words(r, 10) for _ in range(6)]
        docs += [(d + i, " ".join(words(r, 20) + lines[i] + lines[i + 1] + words(r, 20))) for i in range(5)]
        p = [x for line in lines for x in line]
        docs += [(d + 8, " ".join(words(r, 15) + p + words(r, 20))), (d + 9, " ".join(words(r, 25) + p + words(r, 11)))]
        want.append(d + 9)
    got = {g["doc_id"]: (g["region_start"], g["region_end"]) for g in passages.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {d: (25, 85) for d in want}


def test_exact_passages_of_the_least_length_share_a_run_of_seeds(spark):
    """Passages of 50 words whose pieces of 14 words all stand in earlier documents, so that no strobe leads to the source."""
    r = random.Random(7)
    draw = lambda n: [f"w{r.randrange(100000)}" for _ in range(n)]
    docs, want = [], {}
    for k in range(1500):
        p = draw(50)
        pair = [" ".join(draw(40) + p + draw(40)) for _ in range(2)]
        if k in (36, 589, 1109):
            docs += [(len(docs) + i, " ".join([f"x{k}.{i}.{j}" for j in range(8)] + p[at : at + 14] + [f"y{k}.{i}.{j}" for j in range(8)])) for i, at in enumerate(range(0, 37, 2))]
            docs += [(len(docs), pair[0]), (len(docs) + 1, pair[1])]
            want[len(docs) - 1] = (len(docs) - 2, 40, 90)
    got = passages.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {g["doc_id"]: (g["source_id"], g["start_word"], g["end_word"]) for g in got} == want


@pytest.mark.parametrize(("every", "step"), [(5, 5), (7, 5), (7, 2), (10, 5), (10, 2), (20, 2)])
def test_changed_passages_whose_short_pieces_stand_in_earlier_documents(spark, every, step):
    r = random.Random(31 * every + step)
    docs, pairs = [], []
    for _ in range(30):
        p = words(r, 80)
        for at in range(0, 76, step):  # a document for each piece of five words
            docs.append((len(docs), " ".join(words(r, 8) + p[at : at + 5] + words(r, 8))))
        q = list(p)
        for at in range(every // 2, 80, every):
            q[at] = f"x{r.random()}"
        pairs.append((" ".join(words(r, 40) + p + words(r, 30)), " ".join(words(r, 22) + q + words(r, 50))))
    first = len(docs) + len(docs) % 2
    docs += [(first + 2 * k + side, text) for k, pair in enumerate(pairs) for side, text in enumerate(pair)]
    got = passages.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    caught = {g["doc_id"] for g in got if g["source_id"] == g["doc_id"] - 1 and g["doc_id"] % 2 and g["region_start"] <= 38 and g["region_end"] >= 86}
    assert len(caught) >= 0.9 * len(pairs)
    assert {g["doc_id"] for g in got} <= {first + 2 * k + 1 for k in range(len(pairs))}


def best_local_alignment(a, b):
    """Score, first and last word + 1 in a, and agreeing words of the best local alignment: 1 for a match, else -2."""
    best, above = (0, 0, 0, 0), [(0, 0, 0)] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        row = [(0, i, 0)]
        for j, y in enumerate(b, 1):
            s, start, same = above[j - 1]
            s, start = (s, start) if s else (0, i - 1)
            one = (s + 1, start, same + 1 if s else 1) if x == y else (s - 2, start, same)
            two = max((above[j][0] - 2, *above[j][1:]), (row[-1][0] - 2, *row[-1][1:]))
            row.append(max(one, two) if max(one, two)[0] > 0 else (0, i, 0))
            best = max(best, (row[-1][0], row[-1][1], i, row[-1][2]))
        above = row
    return best


def test_find_against_all_local_alignments(spark):
    r = random.Random(77)
    stock = [words(r, n) for n in (55, 60, 70, 90)]
    docs = []
    for d in range(18):
        text = words(r, r.randrange(0, 30))
        for p in r.sample(stock, r.randrange(0, 3)):
            for w in p:  # words changed, left out and put in
                edit = r.random()
                text += words(r, 1) if edit < 0.05 else [] if edit < 0.065 else [w, *words(r, 1)] if edit < 0.08 else [w]
            text += words(r, r.randrange(15, 40))
        docs.append((d, " ".join(text)))
    split = [t.split() for _, t in docs]
    got = passages.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    covered = {d: set() for d, _ in docs}
    for g in got:
        covered[g["doc_id"]] |= set(range(g["region_start"], g["region_end"]))
        score, start, end, _ = best_local_alignment(split[g["doc_id"]][g["start_word"] : g["end_word"]], split[g["source_id"]][g["source_start"] : g["source_end"]])
        assert score >= 10 and end - start >= 20  # nothing is found that isn't alike
    want = found = 0
    for d in range(18):
        alignments = [best_local_alignment(split[d], split[e]) for e in range(d)]
        for _, start, end, same in alignments:
            if end - start >= 55 and same >= 0.88 * (end - start):
                want += 1
                found += len(covered[d] & set(range(start, end))) >= 0.8 * (end - start)
    assert want >= 10 and found >= 0.9 * want


@pytest.mark.parametrize("every", [5, 7, 10, 20])
def test_passages_with_evenly_changed_words(spark, every):
    r = random.Random(every)
    docs, least = [], 0.9
    for t in range(40):
        p = words(r, 80)
        q = list(p)
        for at in range(every // 2, 80, every):
            q[at] = "changed"
        docs += [(2 * t, " ".join(words(r, 40) + p + words(r, 30))), (2 * t + 1, " ".join(words(r, 22) + q + words(r, 50)))]
    got = passages.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    caught = {g["doc_id"] for g in got if g["source_id"] == g["doc_id"] - 1 and g["region_start"] <= 38 and g["region_end"] >= 86}
    assert len(caught) >= least * 40
    assert all(abs(g["region_start"] - 22) <= 16 and abs(g["region_end"] - 102) <= 16 for g in got)


def test_keys_are_made_of_few_texts_at_once_whatever_the_batch():
    """_matches asks for batches of 20,000 rows, and the texts before it stand in the same query."""
    import pyarrow as pa

    texts = ["word " * 1000, None, "", "x" * (3 << 20), *["other words " * 2000] * 300]
    parts = list(passages.parts_of(pa.RecordBatch.from_pydict({"doc_id": range(len(texts)), "text": texts})))
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts
    assert [i for p in parts for i in p.column("doc_id").to_pylist()] == list(range(len(texts)))
    sizes = [[len(t or "") for t in p.column("text").to_pylist()] for p in parts]
    assert all(sum(s) - max(s) <= passages.TEXT_BYTES for s in sizes)
