"""The conversation trie and the filter audit against SQL and against plain programs, on given and on odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from wavemill.llm import audit, trie
from wavemill.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", ["op12_conversation_trie", "op13_filter_audit"])
def test_query_agrees_with_sql(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in cols)
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, duck.execute(f"SELECT {quoted} FROM ({ORACLE_SQL[name]}) AS z").fetchall()))


# ---- trie --------------------------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, n_convs string"


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], digest(p)) for p, m in members.items())


def found_trie(spark, rows):
    df = trie.prefix_trie(spark.createDataFrame([(*r, "extra") for r in rows], TURNS))
    return sorted((c, d, -1 if p is None else p, *rest) for c, d, p, *rest in map(tuple, df.collect()))


def made_turns(seed, convs, most, kinds):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"][:1 + kinds // 3]), f"text {rng.randrange(kinds)}") for c in convs for t in range(rng.randint(1, most))]


def test_trie_against_a_plain_program(spark):
    rows = made_turns(1, range(0, 260), 7, 2) + made_turns(2, range(301, 340), 12, 3)
    random.Random(3).shuffle(rows)
    assert found_trie(spark, rows) == plain_trie(rows)


def test_trie_over_many_ranges(spark, monkeypatch):
    """One conversation holds half of all turns, and many conversations are equal: all spread over ranges."""
    monkeypatch.setattr(trie, "RANGE_ROWS", 16)
    rows = [(7, t, "user", f"t{t % 3}") for t in range(150)] + [(c, t, "user", "same") for c in range(400, 500) for t in range(2)]
    rows += made_turns(4, range(100, 130), 6, 2)
    assert found_trie(spark, rows) == plain_trie(rows)


def test_trie_of_nested_conversations(spark):
    """Each conversation leaves the one before a turn later, so paths hang below each other."""
    ids = [c for c in range(1, 2000) if zlib.crc32(str(c).encode()) % 6 == 0][:8]
    rows = [(c, t, "user", "trunk" if t <= k else f"own {k}") for k, c in enumerate(ids) for t in range(k + 4)]
    rows += [(c, t, "user", f"own {k}" if t > j else "trunk") for k, c in enumerate(ids) for j in (k,) for t in range(k + 4, k + 6)]
    assert found_trie(spark, rows) == plain_trie(rows)


def test_trie_of_odd_tables(spark):
    assert found_trie(spark, []) == []
    rows = [
        (None, 1, "user", "lost"), (5, None, None, None), (5, None, "", ""), (5, 2, "user", None), (5, 2, "user", "b"), (5, 2, "user", "a"), (5, 2, "user", "a"),
        (3, 1, "u", "ab"), (4, 1, "ua", "b"), (250, 1, "user", "é😀" * 3), (251, 1, "user", "é😀" * 3), (999, 1, "x", "x"), (200, 1, "user", "long " * 20_000),
    ]
    assert found_trie(spark, rows) == plain_trie(rows)


# ---- audit -------------------------------------------------------------------------------------------------------------


def plain_audit(docs, labels):
    marks = defaultdict(lambda: (0, 0))
    for i, quality, toxic, *_ in labels:
        if i is not None:
            marks[i] = (max(marks[i][0], int(quality == 1)), max(marks[i][1], int(toxic == 1)))
    least = {}
    for i, text, *_ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    by_part = defaultdict(list)
    for i, text, source, *_ in docs:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and least[text] < i,
        }
        by_part[source or ""].append(("".join(k for k in fails if fails[k]), *(marks[i] if i is not None else (0, 0))))
    out = []
    for part, rows in by_part.items():
        total, here = Counter(), []
        for order in permutations("ABCDE"):
            left = rows
            for step, letter in enumerate(order, 1):
                gone = [r for r in left if letter in r[0]]
                left = [r for r in left if letter not in r[0]]
                total[letter] += len(gone)
                failing = sum(letter in r[0] for r in rows)
                here.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(r[0] == letter for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)))
        out += [(*r, total[r[1][r[2] - 1]]) for r in here]
    return sorted(out)


DOCS, LABELS = "doc_id long, text string, source string, mask int, n long", "doc_id long, quality int, toxic int, part string"


def found_audit(spark, docs, labels, parts=3):
    df = audit.interactions(spark.createDataFrame([(*d, 9, 9) for d in docs], DOCS).repartition(parts), spark.createDataFrame([(*r, "p") for r in labels], LABELS))
    return sorted(map(tuple, df.collect()))


def test_audit_against_a_plain_program(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "GAMMA", "delta#", "eps", "zeta", "é x", " "]
    texts = [rng.choice([" ", "\n", "\x0b"]).join(rng.choices(words + [str(k) for k in range(60)], k=rng.choice([5, 49, 50, 80]))) for _ in range(40)]
    docs = [(rng.randrange(300), rng.choice(texts), rng.choice(["a", "b", None, ""])) for _ in range(400)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 300, 2) for _ in range(rng.choice([1, 1, 2]))]
    assert found_audit(spark, docs, labels) == plain_audit(docs, labels)


def test_audit_of_odd_tables(spark):
    assert found_audit(spark, [], [(1, 1, 1)]) == []
    docs = [(None, "same", "s"), (None, "same", "s"), (3, "same", "s"), (1, "same", "t"), (1, "same", "s"), (1, "same", "s"), (2, None, None), (4, "", ""), (5, "word " * 50_000, "s")]
    assert found_audit(spark, docs, []) == plain_audit(docs, [])
    assert found_audit(spark, docs, [(None, 1, 1), (3, 1, None), (3, 0, 1)]) == plain_audit(docs, [(None, 1, 1), (3, 1, None), (3, 0, 1)])


def test_audit_of_a_hot_text(spark):
    docs = [(k, "one text", f"s{k % 2}") for k in range(500)] + [(k, f"text {k}", "s0") for k in range(500, 800)]
    random.Random(2).shuffle(docs)
    assert found_audit(spark, docs, [(0, 1, 0), (7, 1, 1)], 8) == plain_audit(docs, [(0, 1, 0), (7, 1, 1)])


def test_a_fingerprint_shared_by_different_texts():
    store = audit.Store()
    settled = [c for i, t in ((5, "a"), (2, "b"), (3, "a"), (9, "b"), (3, "a")) for c in store.meet(77, t, i, {("p", 0): 1})]
    assert settled == [(5, "p", 16, 1), (9, "p", 16, 1)]
    assert sorted(store.rest()) == [(77, "a", 3, {("p", 0): 2}), (77, "b", 2, {("p", 0): 1})]
