"""Decontamination, language, quality, shards and licences on small tables and against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.llm import decontaminate, langid, licences, quality, shards
from wavemill.llm.queries import QUERIES

W = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_hits(text, items, window=13):
    words = W.findall(low(text))
    hit, found = set(), set()
    for item, t in items:
        w = W.findall(low(t))
        for k in range(max(1, len(w) - window + 1)):
            part = w[k : k + window]
            for a in range(len(words) - len(part) + 1) if part else ():
                if words[a : a + len(part)] == part:
                    hit |= set(range(a, a + len(part)))
                    found.add(item)
    return len(words), len(hit), found


ITEMS = [(10, " ".join(f"q{i}" for i in range(20))), (9, "Only four WORDS here"), (2, None), (3, "..."), (11, " ".join(f"q{i}" for i in range(4, 18)))]
DOCS = [
    (1, "x " + " ".join(f"Q{i}," for i in range(20)) + " y"), (2, "nothing at all"), (3, None), (4, ""), (5, "only-four words; here! only four words here"),
    (6, " ".join(f"q{i}" for i in range(12))), (7, "é" * 10 + " only four words hereé"), (1, "x"), (8, " ".join(["pad"] * 400) + " only four words here"),
]


@pytest.mark.parametrize("block", [1_000_000, 40])
def test_contamination_against_brute_force(spark, block):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("hits", F.lit("clash"))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.report(decontaminate.find_hits(docs, bench, block_bytes=block)).collect()
    want = []
    for i, t in DOCS:
        n, h, items = brute_hits(t, ITEMS)
        want.append((i, n, h, len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), h > 0 and 20 * h >= n))
    assert sorted(map(tuple, got)) == sorted(want)


def test_scanner_against_brute_force():
    """Few different words, so that windows overlap, repeat and touch in every way."""
    import random

    r = random.Random(2)
    for _ in range(150):
        window = r.choice([2, 3, 5, 13])
        items = [(i, " ".join(r.choice("abc") for _ in range(r.randrange(1, 3 * window)))) for i in range(r.randrange(1, 6))] + [(None, "z z")]
        scanner = decontaminate.WindowScanner(items, window)
        for _ in range(6):
            text = " ".join(r.choice("abcz" if r.random() < 0.5 else "abc") for _ in range(r.randrange(60)))
            n, hits = scanner.scan(text)
            want = brute_hits(text, items, window)
            assert n == want[0] and {h["item_id"] for h in hits} == want[2]
            assert len({w for h in hits for w in range(h["first_word"], h["last_word"] + 1)}) == want[1]


def test_very_long_texts_and_items_without_an_id(spark):
    docs = spark.createDataFrame([(1, "pad " * 300_000 + "a b c"), (2, "q r")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "q r"), (7, "A b C"), (7, "A b C"), (None, None)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.report(decontaminate.find_hits(docs, bench)).collect()}
    assert (got[1]["n_words"], got[1]["n_hit"], got[1]["n_items"], got[1]["contaminated"]) == (300_003, 3, 1, False)
    assert (got[2]["n_hit"], got[2]["n_items"], got[2]["contaminated"]) == (2, 0, True)


def test_spans_point_into_the_original(spark):
    docs = spark.createDataFrame([(5, "So: Only FOUR words, here. End")], "doc_id long, text string")
    h = decontaminate.find_hits(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).first()["hits"][0]
    assert "So: Only FOUR words, here. End"[h["start"] : h["end"]] == "Only FOUR words, here"


def test_dropping_keeps_columns_and_an_empty_benchmark_drops_nothing(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("n_words", F.lit("mine"))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 6, 7, 8]
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == len(DOCS)


def test_language_held_out_accuracy_and_edges(spark, data):
    got = QUERIES["op7_language_naive_bayes"](spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").toPandas()
    assert len(held) > 20 and (held.lang == held.lang_pred).mean() > 0.95
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in got.select("doc_id", "held_out").collect())
    docs = spark.createDataFrame([(1, "der die das und ist nicht", "de"), (3, "the and of is not", "en"), (4, None, "de"), (5, "12 !!", "en"), (6, "the " * 5000, None), (7, "", None)], "doc_id long, text string, lang string")
    rows = {r["doc_id"]: r for r in langid.predict(docs, *langid.fit(docs)).collect()}
    assert [rows[i]["lang_pred"] for i in (1, 3, 4, 5, 6, 7)] == ["de", "en", "und", "und", "en", "und"]
    assert rows[4]["score"] == 0.0 and 0 <= rows[6]["score"] <= 1
    assert {r["lang_pred"] for r in langid.predict(docs, *langid.fit(docs.limit(0))).collect()} == {"und"}


def plain_grams(text):
    """Hashed columns of a text's n-grams, one letter at a time."""
    codes = [ord(c) if c.isalpha() else 0 for c in (text or "").lower()] + [0] * langid.ORDERS
    for i, c in enumerate(codes):
        for order in range(1, langid.ORDERS + 1):
            if c:
                h = c
                for k in range(1, order):
                    h = (h * 0x01000193 + codes[i + k]) & 0xFFFFFFFF
                yield ((h + order) * 0x9E3779B1 & 0xFFFFFFFF) >> 16


def test_language_query_against_plain_bayes(spark, data):
    import math
    from collections import Counter

    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang").collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    counts, sizes = {}, Counter()
    for r in docs:
        if r["lang"] is not None and r["text"] is not None and not held(r["doc_id"]):
            counts.setdefault(r["lang"], Counter()).update(plain_grams(r["text"]))
            sizes[r["lang"]] += 1
    total = {k: sum(c.values()) + 0.5 * langid.BUCKETS for k, c in counts.items()}
    got = {r["doc_id"]: r for r in QUERIES["op7_language_naive_bayes"](spark, data).collect()}
    assert len(got) == len(docs)
    for r in docs:
        own, g = Counter(plain_grams(r["text"])), got[r["doc_id"]]
        if not own:
            assert (g["lang_pred"], g["score"]) == ("und", 0.0)
            continue
        logs = {k: math.log(sizes[k] / sum(sizes.values())) + sum(n * math.log((c[b] + 0.5) / total[k]) for b, n in own.items()) for k, c in counts.items()}
        best = max(sorted(logs), key=logs.get)
        assert g["lang_pred"] == best and g["held_out"] == held(r["doc_id"])
        assert g["score"] == pytest.approx(1 / sum(math.exp(max(-700, v - logs[best])) for v in logs.values()), abs=1e-2)


def test_language_ties_repeats_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "abc", "b", 1), (1, "abc", "b", 1), (2, "abc", "a", 1), (2, "abc", "a", 1), (5, "abc", None, 2)], "doc_id long, text string, lang string, score int")
    got = langid.predict(docs, *langid.fit(docs))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and [r["lang_pred"] for r in got.collect()] == ["a"] * 5


def test_batch_scores_equal_single_scores():
    logp = np.random.default_rng(0).normal(size=(langid.BUCKETS + 1, 3)).astype(np.float32)
    texts = ["Hello wörld", None, "", "one", "x" * 5000, "日本語 text", "𝒜 b"]
    lang, p = langid.score(texts, ["a", "b", "c"], logp)
    for k, t in enumerate(texts):
        one_lang, one_p = langid.score([t], ["a", "b", "c"], logp)
        assert (one_lang[0], round(float(one_p[0]), 6)) == (lang[k], round(float(p[k]), 6))


def brute_marginals(e, trans):
    """Marginals by going through all labellings."""
    n, total, good = len(e), 0.0, np.zeros(len(e))
    for code in range(2**n):
        y = [(code >> k) & 1 for k in range(n)]
        w = np.exp(sum(e[k] * y[k] for k in range(n)) + sum(trans[y[k]][y[k + 1]] for k in range(n - 1)))
        total += w
        good += w * np.array(y)
    return good / total


def test_forward_backward_against_all_labellings():
    r = np.random.default_rng(1)
    n = np.array([3, 1, 5, 2])
    e, trans = r.normal(size=n.sum()) * 3, r.normal(size=(2, 2))
    p, pairs = quality.forward_backward(e, n, trans)
    at = 0
    for k in n:
        assert np.allclose(p[at : at + k], brute_marginals(e[at : at + k], trans))
        at += k
    assert pairs.sum() == pytest.approx((n - 1).sum())


def test_gradient_of_the_likelihood():
    r = np.random.default_rng(2)
    n, y = np.array([2, 3]), np.array([1, 1, 0, 1, 0])
    e, trans = r.normal(size=5), r.normal(size=(2, 2))

    def loglik(e, trans):
        out, at = 0.0, 0
        for k in n:
            own, z = e[at : at + k], 0.0
            for code in range(2**k):
                c = [(code >> j) & 1 for j in range(k)]
                z += np.exp(sum(own[j] * c[j] for j in range(k)) + sum(trans[c[j]][c[j + 1]] for j in range(k - 1)))
            c = y[at : at + k]
            out += sum(own[j] * c[j] for j in range(k)) + sum(trans[c[j]][c[j + 1]] for j in range(k - 1)) - np.log(z)
            at += k
        return out

    p, pairs = quality.forward_backward(e, n, trans)
    d = 1e-5
    for k in range(5):
        up = e.copy()
        up[k] += d
        assert (loglik(up, trans) - loglik(e, trans)) / d == pytest.approx(y[k] - p[k], abs=1e-3)
    gold = quality._pairs_of(y, n)
    for a in range(2):
        for b in range(2):
            up = trans.copy()
            up[a, b] += d
            assert (loglik(e, up) - loglik(e, trans)) / d == pytest.approx(gold[a, b] - pairs[a, b], abs=1e-3)


def test_quality_held_out_and_edges(spark, data):
    got = QUERIES["op5_quality_crf"](spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert ((got.score >= 0.3) == (got.predicted == 1)).all() and (got.predicted == got.quality).mean() > 0.9
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a\n\nb"), (3, "a\n\nb"), (None, "x")], "doc_id long, text string").withColumn("Score", F.lit("clash"))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.classify(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (3, None)], "doc_id long, quality int")
    assert quality.drop_rejected(docs, one).columns == docs.columns and quality.drop_rejected(docs, one).count() == 5


def test_quality_query_against_plain_chains(spark, data):
    """Every score again, with forward and backward sums in plain logarithms, a line at a time."""
    import math

    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    learned = spark.createDataFrame([r for r in labels.collect() if not held(r["doc_id"])], labels.schema)
    model = quality.fit(docs, learned)
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    got = {r["doc_id"]: r for r in QUERIES["op5_quality_crf"](spark, data).collect()}
    for r in docs.select("doc_id", "text").collect():
        lines = quality.line_features([r["text"]])
        e, t, n = model.emissions(lines).tolist(), model.trans.tolist(), len(lines.x)
        up, down = [[0.0, e[0]]], [[0.0, 0.0]]
        for k in range(1, n):
            up.append([add(up[-1][0] + t[0][y], up[-1][1] + t[1][y]) + y * e[k] for y in (0, 1)])
        for k in range(n - 1, 0, -1):
            down.insert(0, [add(t[y][0] + down[0][0], t[y][1] + e[k] + down[0][1]) for y in (0, 1)])
        p = [1 / (1 + math.exp(min(700, u[0] + d[0] - u[1] - d[1]))) for u, d in zip(up, down)]
        w = [max(1, len(x.encode())) for x in (r["text"] or "").split("\n")]
        g = got[r["doc_id"]]
        assert g["score"] == pytest.approx(sum(a * b for a, b in zip(p, w)) / sum(w), abs=1e-6)
        assert g["held_out"] == held(r["doc_id"]) and g["predicted"] == int(g["score"] >= 0.3)


def test_quality_of_long_texts(spark):
    long = "A good line of words.\n" * 40_000
    lines = quality.line_features(["One good line.\nAnother.", "BAD!! BAD!!\n" * 40])
    model = quality.train(lines, np.array([1, 0]), rounds=20)
    docs = spark.createDataFrame([(1, long), (2, "x" * 2_000_000), (2, "x" * 2_000_000)], "doc_id long, text string")
    got = [r["score"] for r in quality.add_score(docs, model).select("score").collect()]
    assert len(got) == 3 and all(0 <= s <= 1 for s in got) and got[1] == got[2]


def test_scores_do_not_depend_on_the_batch():
    texts = ["One good line.\nAnother.", "BAD!! BAD!!\n" * 40, "", None, "x"]
    lines = quality.line_features(texts)
    model = quality.train(lines, np.array([1, 0, 1, 1, 0]), rounds=20)
    together = quality.score(texts, model)
    assert np.allclose(together, [quality.score([t], model)[0] for t in texts])
    assert ((0 <= together) & (together <= 1)).all()


def test_shards_of_a_hot_text(spark):
    rows = [(i, "the same text again and again" if i % 3 == 0 else None if i % 50 == 1 else f"text {i} " * (i % 40)) for i in range(6000)] + [(None, "x"), (5, "y"), (5, "y")]
    got = shards.assign(spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash"))).toPandas()
    assert len(got) == len(rows) and set(got.law) == {"bytes"} and got.grown_shard.isna().all()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 0.01 * sizes.mean()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    assert sorted(zip(got["size"], got["text_crc32"])) == want
    small = got[got.text_crc32 != zlib.crc32(b"the same text again and again")]
    assert (small.groupby("text_crc32").shard.nunique() > 1).sum() <= 1 + 8  # at most the texts at the shards' borders


def test_shard_query_keeps_its_law(spark, data):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op9_shard_sampled_splitters"](spark, data).toPandas()
    assert sorted(got.doc_id) == sorted(docs)
    body = [(docs[i] or "").encode() for i in got.doc_id]
    assert got["size"].tolist() == [len(b) + 1 for b in body] and got.text_crc32.tolist() == [zlib.crc32(b) for b in body]
    sizes = got.groupby("shard")["size"].sum()
    assert list(sizes.index) == list(range(8)) and (sizes - sizes.mean()).abs().max() <= max(got["size"])
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    groups = got.assign(text=body).groupby("text")
    limit = shards.WHOLE_SHARE * sizes.mean()
    assert all(g.shard.nunique() == 1 for _, g in groups if g["size"].sum() <= limit)


def test_shards_of_long_texts(spark):
    rows = [(i, "y" * 3_000_000 if i in (3, 4) else "z" * (i % 7)) for i in range(300)]
    got = shards.assign(spark.createDataFrame(rows, "doc_id long, text string"), 2).toPandas()
    assert sorted(got.groupby("shard")["size"].sum() // 1_000_000) == [3, 3]


def test_shards_of_few_and_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert shards.assign(empty).count() == 0
    assert shards.assign(spark.createDataFrame([(1, "a")], "doc_id long, text string")).first()["slot"] == 0


def test_licences_by_header_file_and_ancestor(spark):
    files = [
        (1, "src/LICENSE", "Released under the MIT License."), (2, "src/a/b/c.txt", "code code code"), (3, "src/a/COPYING", "Licensed under CC BY-NC 4.0."),
        (4, "src/a/x.txt", " ".join(["word"] * 50) + "\nLicensed under the Apache License, Version 2.0."), (5, "other/y.txt", "no words on it"), (6, None, "z"), (7, "src/q.txt", None),
        (8, "src/a/b/d.txt", "the license of this is quite unlike anything known around here"), (9, "top.txt", "z"),
    ]
    got = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    want = {1: ("MIT", "file", None), 2: ("CC-BY-NC-4.0", "inherited", "src/a"), 3: ("CC-BY-NC-4.0", "file", None), 4: ("Apache-2.0", "header", None), 5: (None, "none", None), 6: (None, "none", None), 7: ("MIT", "inherited", "src"), 8: ("CC-BY-NC-4.0", "inherited", "src/a"), 9: (None, "none", None)}
    assert {i: (r["licence"], r["basis"], r["from_dir"]) for i, r in got.items()} == want
    assert got[2]["levels_up"] == 1 and got[1]["similarity"] == 1.0


def plain_cosine(text, template, templates):
    import math
    from collections import Counter

    sets = [set(re.findall("[a-z0-9]+", x.lower())) for _, x in templates]
    idf = lambda t: math.log((1 + len(sets)) / (1 + sum(t in s for s in sets))) + 1 if any(t in s for s in sets) else 1.0
    a, b = ({t: n * idf(t) for t, n in Counter(re.findall("[a-z0-9]+", x.lower())).items()} for x in (text, template))
    return sum(w * b.get(t, 0) for t, w in a.items()) / math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values()))


def plain_body_cosine(text, template, templates, sets={}):  # noqa: B006
    """The cosine of whole texts: counts damped by the logarithm, words of all licences next to nothing, unknown ones 0.3."""
    import math
    from collections import Counter

    words = lambda x: re.findall("[a-z0-9]+", x.lower())
    if id(templates) not in sets:
        sets[id(templates)] = Counter(t for _, x in templates for t in set(words(x)))
    df = sets[id(templates)]
    idf = lambda t: math.log((1 + len(templates)) / (0.5 + df[t])) if t in df else 0.3
    a, b = ({t: (1 + math.log(n)) * idf(t) for t, n in Counter(words(x)).items()} for x in (text, template))
    return sum(w * b.get(t, 0) for t, w in a.items()) / math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values()))


def test_cosine_against_plain_python(spark):
    lines = ["Licensed under the Apache License", "MIT license license", "licence of zebras zebras", "Copyright 2020 Foo. All rights reserved."]
    files = spark.createDataFrame([(i, "a/b", t) for i, t in enumerate(lines)], "doc_id long, path string, text string")
    best = licences.headers(files).select("doc_id", F.transform("lines", lambda x: licences.best_template(x, licences.TEMPLATES)).alias("b")).collect()
    for r in best:
        want = max(plain_cosine(lines[r["doc_id"]], text, licences.TEMPLATES) for _, text in licences.TEMPLATES)
        assert r["b"][0]["similarity"] == pytest.approx(want, abs=1e-8)
    found = licences.headers(files.withColumn("text", F.concat("text", F.lit(" without warranty software the the copyright")))).withColumn("file_no", F.col("doc_id"))
    for r in licences.best_bodies(found, licences.BODIES).collect():
        want = max(plain_body_cosine(lines[r["file_no"]] + " without warranty software the the copyright", text, licences.BODIES) for _, text in licences.BODIES)
        assert r["whole"]["similarity"] == pytest.approx(want, abs=1e-8)


def brute_licences(files):
    """Own licences by plain cosines, then each file's nearest directory that declares one."""
    own, declared = {}, {}
    for k, (i, path, text) in enumerate(files):
        lines = [x for x in (text or "").split("\n") if re.search(licences.MENTION, x) and re.search("[a-z0-9]", x.lower())]
        like = lambda x, ts, cosine: max((round(cosine(x, body, ts), 9), -n, name) for n, (name, body) in enumerate(ts))
        each = [like(x, licences.TEMPLATES, plain_cosine) for x in lines]
        best = max(each, default=(0,))
        body = bool(text and re.search(licences.BODY, text))
        whole = like(text, licences.BODIES, plain_body_cosine) if body else (0,)
        mentioning = sum(len(x.split()) for x in lines)
        if body and mentioning >= 0.1 * len(text.split()) and sum(x[0] >= 0.6 for x in each) < 0.125 * len(lines):
            best = (0,)
        mine = whole if whole[0] >= 0.65 else best if best[0] >= 0.6 else None
        terms = lambda x: len(re.findall("[a-z0-9]+", x.lower()))
        is_file = whole[0] >= 0.65 and terms(text) <= 2 * terms(licences.BODIES[-whole[1]][1]) or (best[0] >= 0.6 and mentioning >= 0.3 * len(text.split()))
        own[k] = (mine, is_file)
        if is_file and path is not None:
            at = path.rpartition("/")[0]
            declared[at] = min(declared.get(at, (9, 9, 9, None)), (-mine[0], -mine[1], i, mine[2]))
    out = []
    for k, (i, path, _) in enumerate(files):
        mine, is_file = own[k]
        row = (i, mine[2], "file" if is_file else "header", None, None) if mine else (i, None, "none", None, None)
        if not mine and path is not None:
            at, up = path.rpartition("/")[0], 0
            while True:
                if at in declared:
                    row = (i, declared[at][3], "inherited", at, up)
                    break
                if not at:
                    break
                at, up = at.rpartition("/")[0], up + 1
        out.append(row)
    return out


def test_licences_against_brute_force(spark, data):
    body, whole = dict(licences.BODIES), dict(licences.whole_texts())
    odd = [
        (10, "p/LICENSE", "Copyright (c) 2020 Foo\n" + body["MIT"]), (10, "p/LICENSE", "Copyright (c) 2020 Foo\n" + body["MIT"]), (11, "p/q/r.c", "int x;"), (12, "p/COPYING", body["BSD-3-Clause"]),
        (13, "p/q/BSD", body["BSD-2-Clause"]), (14, "z.txt", "SPDX-License-Identifier: Apache-2.0"), (15, "other/z.txt", "All rights reserved."), (16, None, "All rights reserved."), (17, "", ""), (18, "lic/x", "licence " + "word " * 30_000),
        (24, "l/m", whole["MPL-2.0"]), (25, "l/a", whole["Artistic-1.0"].replace("Artistic", "Foo")), (26, "s/a.c", body["Apache-2.0"] + "\n" + "\n".join(f"int x{i} = {i};" for i in range(150))), (27, "s/b.c", ""),
        (28, "t/LICENSE", "Redistribution and use is\nby license\nnot by license\nof any license\nthat copyright knows\nReleased under the MIT License.\nlicence" + "\nno license" * 3),
        (19, "gnu/COPYING", body["GPL-3.0"]), (20, "gnu/old/COPYING", body["GPL-2.0"]), (21, "gnu/old/a/b", None), (22, "lic/--", "©licen©\n copyright"), (23, "a/b", "Copyright 2020 Foo. All rights reserved."),
    ]
    docs = [tuple(r) for r in licences.with_path(spark.read.parquet(f"{data}/documents.parquet")).collect()]
    for files in (odd, docs):
        df = spark.createDataFrame(files, "doc_id long, path string, text string").withColumn("best", F.lit("clash"))
        got = [(r["doc_id"], r["licence"], r["basis"], r["from_dir"], r["levels_up"]) for r in licences.scan(df).collect()]
        assert sorted(map(str, got)) == sorted(map(str, brute_licences(files)))
    assert licences.scan(df.limit(0)).count() == 0


def test_whole_licences_are_named(spark):
    """Whole texts, verbatim and with another holder and other line breaks, are named; foreign texts of a licence's kind aren't."""
    import textwrap

    whole = licences.whole_texts()
    short = [b for b in licences.BODIES if b[0] in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Unlicense")]
    assert {"Apache-2.0", "MPL-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "CC0-1.0"} <= {n for n, _ in whole}
    files = [(f"{name} {k}", f"{name} {k}/LICENSE", text) for name, x in whole + short for k, text in enumerate((x, "\n".join(textwrap.wrap(f"Copyright 2021 Jane Doe and the Foobar Contributors\n{x}", 60))))]
    got = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(files, "doc_id string, path string, text string")).collect()}
    assert {i: (r["licence"], r["basis"]) for i, r in got.items()} == {i: (i.split(" ")[0], "file") for i, _, _ in files}
    kin = {"Apache-2.0": (), "CC0-1.0": (), "GPL-3.0": ("AGPL-3.0",), "Artistic-1.0": (), "GFDL-1.3": ("GFDL-1.2",)}
    for name, others in kin.items():
        bodies = [b for b in licences.BODIES if b[0] not in (name, *others)]
        r = licences.scan(spark.createDataFrame([(1, "LICENSE", dict(whole)[name])], "doc_id long, path string, text string"), bodies=bodies).first()
        assert (r["licence"], r["basis"]) == (None, "none"), name


def test_notices_above_code(spark):
    """A notice above code of any length names the file's licence; only where its lines hold 3 words in 10 or more, the directory's."""
    notice = "/* Copyright 2020 Foo\n" + "\n".join(f" * {x}" for x in dict(licences.BODIES)["Apache-2.0"].split("\n")) + "\n */\n"
    files = [(n, f"d{n}/x.c", notice + "\n".join(f"int f{i}(int a) {{ return a + {i}; }}" for i in range(n))) for n in (0, 5, 20, 50, 100, 300, 1000)]
    got = {r["doc_id"]: (r["licence"], r["basis"]) for r in licences.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert got == {n: ("Apache-2.0", "file" if n <= 20 else "header") for n, _, _ in files}


def test_licences_are_inherited_from_any_depth(spark):
    files = [(1, "LICENSE", "Released under the MIT License."), (2, "/".join(["d"] * 50) + "/x.txt", "nothing here")]
    got = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert (got[2]["licence"], got[2]["basis"], got[2]["levels_up"]) == ("MIT", "inherited", 50)
