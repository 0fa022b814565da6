"""Substring deduplication by collinear chaining.

Keys of two kinds lead texts to each other. Strobes join two runs of ``B`` words: the first is one in ``RARE`` of all runs,
chosen by its hash alone, the second that of the runs ``NEXT`` words on which has the least hash together with the first. So
passages meet of which no long run of words is left as it was, and yet a strobe is wider than the short pieces of a passage
that stand in earlier, unrelated documents. And seeds, the minimizers of a text's runs of
``K`` words (of every ``W`` neighbouring ones that of the least hash), make runs of neighbouring seeds that reach
``LEAST_WORDS`` words: keys whose first holder is a document that has the whole run and not only a piece of it.

For each key the first document that holds it (the least doc_id) is its source; every other occurrence is matched with
the source's first one, which keeps the matches of a passage shared by n documents at n - 1. The keys are shuffled once,
sorted, and each task reads its sorted keys as a stream. A hot key is spread over ``SALTS`` streams and its streams'
firsts are compared afterwards; which keys are treated so is learned from a sample of the documents and changes no result.

The matches of a document with one source are chained in order: a chain's score is B words for each match less a cost for
the gaps, and the best chain that ends in a match is found with a Fenwick tree over source positions. Chains are cut at
wide gaps (``MAX_GAP`` words, or a shift of ``MAX_SHIFT``: passages further apart are passages of their own), aligned word
by word between and beyond their matches, and kept as passages if ``SIMILARITY`` of their words agree; a chain that fails is
cut at its worst gap and its parts are judged again. Only the words that chains ask for are shuffled, once for each pair of
texts however many chains it has. Passages of one
document that touch make a region; regions of at least ``MIN_WORDS`` words are repeated text, all the words of which stand
in earlier documents.

Words are runs without ASCII white space, compared in lower case (ASCII). Repeats within one document don't count.

Cases: a null or empty text, one of fewer than LEAST_WORDS words, and rows with a null doc_id have no passages. Rows of one doc_id
with different texts are texts of one document: each has its own passages, but none in another of them; equal rows have
equal passages. Ties go to the least doc_id and the first position. Extra columns aren't carried by ``find``; ``cut``
keeps all columns of its input. An empty table gives an empty result. Ids are integers.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm.common import HOT, join_hot, likely, parted, small_batches, stage
from wavemill.llm.words import word_hashes

#: A window of 14 leaves an exact passage of MIN_WORDS words a whole run of seeds; with 16, 3 of 1,500 had none.
K, W = 8, 14
#: Words that surely agree at each point of a chain; a key gives a point at its first and one at its last B words.
B = 2
#: One in so many runs of B words begins a strobe; its second run begins so many words on.
RARE = 4
NEXT = range(4, 11)
#: A chain of strobes alone is looked at if they hold so many words of one diagonal.
AGREE = 6
MIN_WORDS = 50
#: A chain or passage of fewer words is no part of a region.
LEAST_WORDS = 24
#: Bytes of texts of which the keys are made at once, about; a long text may come on top of that.
TEXT_BYTES = 1 << 20
SIMILARITY = 0.8
GAP_COST = 0.15
MAX_GAP, MAX_SHIFT = 40, 12
#: Words beyond a chain's ends that its alignment may reach at once.
REACH = 64
#: Passages so near to each other make one region.
TOUCH = 2

_G, _A = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_WORD = re.compile("[^\x20\x09-\x0d]+")


def seeds(h: np.ndarray, n: np.ndarray, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the minimizers of texts: h holds their word hashes in a row, n the number of each one's words."""
    if len(h) < k + w - 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    m = len(h) - k + 1
    r = h[:m].copy()
    for j in range(1, k):
        r = (r ^ (r >> np.uint64(29))) * _A + h[j : j + m]
    r = (r ^ (r >> np.uint64(32))) * _G
    r ^= r >> np.uint64(29)
    owner = np.repeat(np.arange(len(n)), n)
    least = _over(np.minimum, r, w)  # the least hash of the window from each place on
    left = np.cumsum(n)[owner[: len(least)]] - np.arange(len(least))
    least[left < k + w - 1] = 0  # a window that reaches into the next text
    # a place is a minimizer if its hash is the least of some window around it
    at = np.flatnonzero(r == _over(np.maximum, np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)]), w))
    if (r[at[1:]] == r[at[:-1]]).any():
        at = _thinned(r, at, w, owner[at])
    return r[at].view(np.int64), at


def _over(least_or_most: np.ufunc, r: np.ndarray, w: int) -> np.ndarray:
    """The least (or most) of each w neighbouring values, by doubling steps."""
    out, width = r.copy(), 1
    while width < w:
        step = min(width, w - width)
        out = least_or_most(out[: len(out) - step], out[step:])
        width += step
    return out


def _thinned(r: np.ndarray, at: np.ndarray, w: int, owner: np.ndarray) -> np.ndarray:
    """Of minimizers of one hash in a row of one text, as few as leave none of the windows without one: a run of one word
    would else have a seed at each place."""
    out = [0]
    same = (r[at[1:]] == r[at[:-1]]) & (owner[1:] == owner[:-1])
    for k in range(1, len(at)):
        if same[k - 1] and k + 1 < len(at) and same[k] and at[k + 1] - at[out[-1]] <= w:
            continue
        out.append(k)
    return at[out]


def strobes(h: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The strobes of some word hashes, where they begin, and the distance of their second runs; ``left`` is the number of
    words from each place to its text's end. A text's last words begin none."""
    short = (h[: len(h) - B + 1] if len(h) >= B else h[:0]) * _A
    for j in range(1, B):
        short = ((short ^ (short >> np.uint64(29))) * _G + h[j : j + len(short)]) * _A
    short ^= short >> np.uint64(32)
    few = np.flatnonzero((short % np.uint64(RARE) == 0) & (left[: len(short)] >= NEXT[0] + B))
    first = short[few] * _G
    least, step = np.full(len(few), np.iinfo(np.uint64).max), np.full(len(few), NEXT[0])
    for d in NEXT:
        inside = left[few] >= d + B
        both = (first ^ short[np.minimum(few + d, len(short) - 1)]) * _A
        both ^= both >> np.uint64(31)
        nearer = inside & (both < least)
        least[nearer], step[nearer] = both[nearer], d
    return (least * _G).view(np.int64), few, step


def run_keys(seed: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the runs of seeds, the numbers of the seeds they begin with, and the distance of their last B words from
    there (below 256).

    A run is a seed and the next ones up to the first that makes it LEAST_WORDS long; its key is of the seeds and their
    distances.
    """
    last = np.searchsorted(at, at + (LEAST_WORDS - K))
    own = np.flatnonzero(last < len(at))
    own = own[at[last[own]] - at[own] < 256 - K]
    if not len(own):
        return seed[:0], own, own
    step = np.concatenate([[0], np.diff(at)]).astype(np.uint64)
    seed = seed.view(np.uint64)
    run, end = seed[own] * _G, last[own]
    for j in range(1, int((end - own).max()) + 1):
        more = own + j <= end
        nxt = own[more] + j
        run[more] = ((run[more] ^ (run[more] >> np.uint64(29))) * _A + seed[nxt]) * _G + step[nxt]
    run ^= run >> np.uint64(32)
    return run.view(np.int64), own, at[end] - at[own] + (K - B)


def keys_of(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of some texts (word hashes in a row, and their numbers), the number of the text each is of, and its place: the
    position << 8, and in the low byte the distance of the key's last B words."""
    starts = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(n)), n)
    seed, at = seeds(h, n)
    run, first, reach = run_keys(seed, at + owner[at] * 1024)  # no run of seeds reaches from one text into the next
    first = at[first]
    strobe, place, step = strobes(h, np.cumsum(n)[owner] - np.arange(len(h)))
    every = np.concatenate([place, first])
    where = (every - starts[owner[every]]) << 8 | np.concatenate([step, reach])
    return np.concatenate([strobe, run]), owner[every], where


def chain(xs: list[int], ys: list[int], k: int = K) -> list[tuple[list[int], list[int]]]:
    """Chains of the matches (x, y), which are sorted by x and then y: both coordinates rise along a chain. Best first;
    a chain within the x range of a better one is left out if the better one's matches alone make it similar enough.

    score(i) = k + max(0, max over earlier j with y_j < y_i of score(j) - cost * (x_i - x_j + y_i - y_j)); the inner
    maximum is a prefix maximum over y of score(j) + cost * (x_j + y_j), kept in a Fenwick tree. Matches of one x are
    entered after all of them have been looked up.
    """
    n = len(xs)
    order = sorted(set(ys))
    size = len(order)
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (size + 1)
    score, before = [0.0] * n, [-1] * n
    i = 0
    while i < n:
        end = i
        while end < n and xs[end] == xs[i]:
            r, best = bisect_left(order, ys[end]), (-1e18, -1)
            while r > 0:
                if tree[r] > best:
                    best = tree[r]
                r -= r & -r
            gain = best[0] - GAP_COST * (xs[end] + ys[end])
            score[end], before[end] = (k + gain, best[1]) if gain > 0 else (float(k), -1)
            end += 1
        for j in range(i, end):
            value, r = (score[j] + GAP_COST * (xs[j] + ys[j]), j), bisect_left(order, ys[j]) + 1
            while r <= size:
                if value > tree[r]:
                    tree[r] = value
                r += r & -r
        i = end
    used, out, taken = [False] * n, [], []
    for top in sorted(range(n), key=lambda j: (-score[j], j)):
        own, j = [], top
        while j >= 0 and not used[j]:
            used[j] = True
            own.append(j)
            j = before[j]
        own.reverse()
        start = 0
        for p in range(1, len(own) + 1):
            if p == len(own) or not _near(xs[own[p]] - xs[own[p - 1]], ys[own[p]] - ys[own[p - 1]]):
                x0, x1 = xs[own[start]], xs[own[p - 1]]
                if not any(a <= x0 and x1 <= b for a, b in taken):  # a better chain holds these words
                    held = B + sum(min(B, xs[own[q]] - xs[own[q - 1]], ys[own[q]] - ys[own[q - 1]]) for q in range(start + 1, p))
                    if held >= SIMILARITY * (B + max(x1 - x0, ys[own[p - 1]] - ys[own[start]])):
                        taken.append((x0, x1))
                    out.append(([xs[j] for j in own[start:p]], [ys[j] for j in own[start:p]]))
                start = p
    return out


def _near(dx: int, dy: int) -> bool:
    return dx <= MAX_GAP and dy <= MAX_GAP and abs(dx - dy) <= MAX_SHIFT


def _common(a: list[int], b: list[int]) -> int:
    """Words that two short runs have in common and in order: in equal places if that are most of them, else the longest
    common subsequence."""
    if len(a) == len(b):
        same = sum(map(eq, a, b))
        if 2 * same >= len(a):  # words changed in place
            return same
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            up = row[j]
            row[j] = left + 1 if x == y else max(up, row[j - 1])
            left = up
    return row[-1]


#: Words passed over in either run at a difference: one changed, or up to two put in or left out.
STEPS = ((1, 1), (0, 1), (1, 0), (1, 2), (2, 1), (0, 2), (2, 0))


def _extend(a: list[int], b: list[int]) -> tuple[int, int, int]:
    """How far two runs agree from their start on, as (words of either, agreeing words): 1 for a match, -3 for a
    difference, after which two words must agree if it shifts the runs."""
    i = j = best = score = same = 0
    out = (0, 0, 0)
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j, score, same = i + 1, j + 1, score + 1, same + 1
            if score > best:
                best, out = score, (i, j, same)
            continue
        score -= 3
        if score < best - 18:
            break
        dx, dy = next(((dx, dy) for dx, dy in STEPS if len(ahead := a[i + dx : i + dx + 2]) == 2 and ahead == b[j + dy : j + dy + 2]), STEPS[0])
        i, j = i + dx, j + dy
    return out


def align(a: list[int], b: list[int], xs: list[int], ys: list[int], k: int = K) -> list[tuple[int, int, int, int, float]]:
    """The parts of a chain of which ``SIMILARITY`` of the words agree: first and last word + 1 in either text, and the
    share of agreeing words. A part that fails is cut at the gap that loses most words, and both sides are judged again.

    xs and ys are the matches' places in the word runs a and b, which reach beyond the chain where the texts do.
    """
    same, lost = [0], [0]
    for p in range(1, len(xs)):
        dx, dy = xs[p] - xs[p - 1], ys[p] - ys[p - 1]
        if dx == dy and dx <= k:
            agree = dx
        else:
            agree = k + _common(a[xs[p - 1] + k : xs[p]], b[ys[p - 1] + k : ys[p]]) if dx >= k and dy >= k else min(dx, dy)
        same.append(same[-1] + agree)
        lost.append(max(dx, dy) - agree)
    out, parts = [], [(0, len(xs) - 1)]
    while parts:
        i, j = parts.pop()
        right, up, more = _extend(a[xs[j] + k :], b[ys[j] + k :])
        left, down, less = _extend(a[: xs[i]][::-1], b[: ys[i]][::-1])
        x0, x1, y0, y1 = xs[i] - left, xs[j] + k + right, ys[i] - down, ys[j] + k + up
        like = (k + same[j] - same[i] + more + less) / max(x1 - x0, y1 - y0)
        if like >= SIMILARITY:
            out.append((x0, x1, y0, y1, like))
        elif i < j:
            cut_at = max(range(i + 1, j + 1), key=lambda p: lost[p])
            parts += [(cut_at, j), (i, cut_at - 1)]
    return out


#: Bits of a place above which stand ``VARIANT`` bits of the text's hash, which tell texts of one doc_id apart.
PLACE, VARIANT = 40, 23
#: A hot key is spread over so many streams.
SALTS = 32
#: One in so many documents is looked at for hot keys.
SAMPLE = 64
#: So many pairs ask for words of one text at once.
REQUESTS = 2000


def variant_of(text: str | None) -> int:
    return xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass")) >> (64 - VARIANT)


def parts_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of texts in parts of about ``TEXT_BYTES``: a query has one size of batches, and that of ``_matches`` is set for
    narrow rows, while a text's words take many times its bytes."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    edges = [0, *(np.flatnonzero(np.diff(upto // TEXT_BYTES)) + 1).tolist(), len(upto)]
    for a, b in zip(edges, edges[1:]):
        if a < b:
            yield batch.slice(a, b - a)


def _key_rows(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """A row for each key of each text. Keys among the sorted ``hot`` ones get a salt from 1 to SALTS, others 0."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts_of(whole)):
            texts = batch.column("text").to_pylist()
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            key, owner, at = keys_of(*word_hashes(texts))
            own_bits = np.array([variant_of(t) for t in texts], np.int64) << PLACE
            salt = np.zeros(len(key), np.int32)
            if len(hot):
                near = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
                is_hot = hot[near] == key
                salt[is_hot] = 1 + ids[owner[is_hot]] % SALTS
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(salt), pa.array(ids[owner]), pa.array(own_bits[owner] | at)], names=["key", "salt", "doc_id", "at"])

    return docs.mapInArrow(run, "key bigint, salt int, doc_id bigint, at bigint")


def hot_keys(docs: DataFrame) -> np.ndarray:
    """Keys that hold more than one in HOT of the keys of a sample of the documents: at most HOT many, sorted."""
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(SAMPLE)) == 0)
    counted = stage(_key_rows(sample, np.zeros(0, np.int64)).groupBy("key").agg(F.count("*").alias("n")), "key-sample")
    total = counted.agg(F.sum("n").alias("n")).first()["n"] or 0
    return np.array(sorted(r["key"] for r in counted.where(F.col("n") > max(8, total / HOT)).collect()), np.int64)


def _matches(rows: DataFrame) -> DataFrame:
    """Every occurrence of a key in another document than the first one of its stream, with that one; of hot keys (their salt
    isn't 0) all occurrences, the first ones with themselves. rows: key, salt, doc_id, at."""
    names = ["key", "salt", "doc_id", "at", "source_id", "source_at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            key, salt, doc, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "salt", "doc_id", "at"))
            n = len(key)
            if not n:
                continue
            begins = np.ones(n, bool)
            begins[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
            begins[0] = last is None or last[:2] != (key[0], salt[0])
            first = np.maximum.accumulate(np.where(begins, np.arange(n), -1))
            source, source_at = doc[first], at[first]
            if not begins[0]:
                source[first < 0], source_at[first < 0] = last[2:]
            last = (key[-1], salt[-1], source[-1], source_at[-1])
            keep = (doc != source) | (salt > 0)
            yield pa.RecordBatch.from_arrays([pa.array(c[keep].astype(np.int64, copy=False)) for c in (key, salt, doc, at, source, source_at)], names=names)

    small_batches(rows.sparkSession, 20_000)
    return rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "doc_id", "at").mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def matches(docs: DataFrame) -> DataFrame:
    """doc_id, variant, source_id, source_variant, and the places x and y of every key that they share."""
    hot = hot_keys(docs)
    found = stage(_matches(_key_rows(docs, hot)), "matches")
    if len(hot):
        firsts = found.where("salt > 0").groupBy("key").agg(F.min(F.struct("source_id", "source_at")).alias("first"))  # at most HOT rows
        found = found.join(F.broadcast(firsts), "key", "left").select(
            "doc_id", "at", F.coalesce("first.source_id", "source_id").alias("source_id"), F.coalesce("first.source_at", "source_at").alias("source_at")
        ).where("doc_id <> source_id")
    high = lambda c: F.shiftright(c, PLACE).cast("int")
    low = lambda c: F.col(c).bitwiseAND(F.lit((1 << PLACE) - 1))
    return found.select("doc_id", high("at").alias("variant"), "source_id", high("source_at").alias("source_variant"), low("at").alias("x"), low("source_at").alias("y"))


def points(xs: list[int], ys: list[int]) -> tuple[list[int], list[int]]:
    """The places of matches, sorted: each match gives its first and its last B words."""
    at = set()
    for x, y in zip(xs, ys):
        at.add((x >> 8, y >> 8))
        at.add(((x >> 8) + (x & 255), (y >> 8) + (y & 255)))
    pairs = sorted(at)
    return [x for x, _ in pairs], [y for _, y in pairs]


def _on_one_diagonal(xs: list[int], ys: list[int]) -> bool:
    """Whether the points of a chain, which are sorted, hold AGREE words of one diagonal."""
    end: dict[int, int] = {}
    held: dict[int, int] = {}
    for x, y in zip(xs, ys):
        held[x - y] = held.get(x - y, 0) + min(B, x + B - end.get(x - y, x))
        end[x - y] = x + B
    return max(held.values()) >= AGREE


PAIR = ["doc_id", "variant", "source_id", "source_variant"]


def _reached(places: list[int]) -> tuple[int, int]:
    """The words of one text, first and last + 1, that the alignment of a chain with these places may look at."""
    return max(0, places[0] - REACH), places[-1] + B + REACH


def reached(chains: list[list[int]]) -> tuple[list[int], list[int]]:
    """The words that any of some chains may look at: the first and last words + 1 of ranges that don't touch. A text that
    says one line again and again has a chain at each, and the chains look at the same words."""
    first, end = [], []
    for lo, hi in sorted(map(_reached, chains)):
        if end and lo <= end[-1]:
            end[-1] = max(end[-1], hi)
        else:
            first.append(lo)
            end.append(hi)
    return first, end


def _chains(grouped: DataFrame) -> DataFrame:
    """The matches xs, ys of each pair of texts -> a row for each pair with chains that may be passages, and the ranges of
    words they look at."""
    ints = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = [], []
            for k, (xs, ys) in enumerate(zip(batch.column("xs").to_pylist(), batch.column("ys").to_pylist())):
                sure = {p for x, y in zip(xs, ys) if x & 255 > NEXT[-1] for p in ((x >> 8, y >> 8), ((x >> 8) + (x & 255), (y >> 8) + (x & 255)))}
                found = [(cx, cy) for cx, cy in chain(*points(xs, ys)) if not sure.isdisjoint(zip(cx, cy)) or _on_one_diagonal(cx, cy)]
                if found:
                    every_x, every_y = map(list, zip(*found))
                    row.append(k)
                    out.append((every_x, every_y, *reached(every_x), *reached(every_y)))
            cols = list(zip(*out)) if out else [[]] * 6
            at, kinds = pa.array(row, pa.int64()), [*[pa.list_(ints)] * 2, *[ints] * 4]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in PAIR), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=[*PAIR, "xs", "ys", "x_from", "x_to", "y_from", "y_to"])

    ranges = ", ".join(f"{c} array<int>" for c in ("x_from", "x_to", "y_from", "y_to"))
    return grouped.mapInArrow(run, f"doc_id bigint, variant int, source_id bigint, source_variant int, xs array<array<int>>, ys array<array<int>>, {ranges}")


def _requested_words(docs: DataFrame, chains: DataFrame) -> DataFrame:
    """no, a and b: for each pair of texts (numbered ``no``) the words of either text in its ranges, one range after the other.

    Each text that is asked for is shuffled once to the requests for its words, in bundles of about REQUESTS.
    """
    ask = lambda side, i, v, lo, hi: F.struct(F.lit(side).alias("side"), F.col(i).alias("id"), F.col(v).alias("variant"), F.col(lo).alias("lo"), F.col(hi).alias("hi"))
    asked = chains.select("no", F.explode(F.array(ask(0, "doc_id", "variant", "x_from", "x_to"), ask(1, "source_id", "source_variant", "y_from", "y_to"))).alias("r")).select("no", "r.*")
    sizes = stage(asked.groupBy("id").agg(F.count("*").alias("n")), "requests")
    bundle = F.pmod(F.xxhash64("no"), F.ceil(F.col("n") / REQUESTS))
    docs = likely(docs, "doc_id", sizes, "id")
    bundles = join_hot(asked, sizes, ["id"], "n").groupBy("id", bundle.alias("bundle")).agg(F.collect_list(F.struct("no", "side", "variant", "lo", "hi")).alias("asked"))
    with_text = docs.join(bundles, docs["doc_id"] == bundles["id"]).select("text", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            no, side, words = [], [], []
            for text, asked_ in zip(batch.column("text").to_pylist(), batch.column("asked").to_pylist()):
                own = variant_of(text)
                h = (word_hashes([text])[0] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                for r in asked_:
                    if r["variant"] == own:
                        no.append(r["no"])
                        side.append(r["side"])
                        words.append(np.concatenate([h[lo:hi] for lo, hi in zip(r["lo"], r["hi"])]))
            offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int32)
            flat = np.concatenate(words) if words else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(no, pa.int64()), pa.array(side, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["no", "side", "words"])

    slices = with_text.mapInArrow(run, "no bigint, side int, words array<int>")
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("words")))
    return slices.groupBy("no").agg(of(0).alias("a"), of(1).alias("b"))


def own_words(words: list[int], first: list[int], end: list[int], places: list[int]) -> tuple[int, list[int]]:
    """The first word that the alignment of a chain may look at, and the words from there on, out of those of all ranges."""
    lo, hi = _reached(places)
    own = bisect_right(first, lo) - 1
    at = sum(end[:own]) - sum(first[:own]) + lo - first[own]
    return lo, words[at : at + hi - lo]


def _aligned(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {c: batch.column(c).to_pylist() for c in ("xs", "ys", "x_from", "x_to", "y_from", "y_to", "a", "b")}
            row, out = [], []
            for k, (every_x, every_y, x_from, x_to, y_from, y_to, words_a, words_b) in enumerate(zip(*col.values())):
                for xs, ys in zip(every_x, every_y):
                    x, a = own_words(words_a, x_from, x_to, xs)
                    y, b = own_words(words_b, y_from, y_to, ys)
                    for x0, x1, y0, y1, like in align(a, b, [p - x for p in xs], [p - y for p in ys], B):
                        if x1 - x0 >= LEAST_WORDS:
                            row.append(k)
                            out.append((x0 + x, x1 + x, y0 + y, y1 + y, like))
            cols = list(zip(*out)) if out else [[]] * 5
            at, kinds = pa.array(row, pa.int64()), [*[pa.int32()] * 4, pa.float64()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in PAIR), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=[*PAIR, "start_word", "end_word", "source_start", "source_end", "similarity"])

    return rows.mapInArrow(run, "doc_id bigint, variant int, source_id bigint, source_variant int, start_word int, end_word int, source_start int, source_end int, similarity double")


def passages(docs: DataFrame) -> DataFrame:
    """Passages of each document that stand in an earlier one: word ranges in either text and their similarity. ``variant``
    and ``source_variant`` tell texts of one doc_id apart."""
    docs = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    at = F.array_sort(F.collect_set(F.struct("x", "y")))
    grouped = matches(docs).groupBy(*PAIR).agg(at.alias("at")).where((F.size("at") > 1) | (F.get("at.x", F.lit(0)).bitwiseAND(255) > NEXT[-1])).select(*PAIR, F.col("at.x").alias("xs"), F.col("at.y").alias("ys"))
    chains = stage(_chains(grouped).withColumn("no", F.monotonically_increasing_id()), "chains")
    small_batches(docs.sparkSession)
    return stage(_outermost(_aligned(chains.join(_requested_words(docs, chains), "no"))), "passages")


def _outermost(found: DataFrame) -> DataFrame:
    """Of the passages of a document and a source, those that lie in no longer one (of equals, the most similar, then the
    first in the source)."""
    every = F.array_sort(F.collect_set(F.struct("start_word", (-F.col("end_word")).alias("back"), (-F.col("similarity")).alias("unlike"), "source_start", "end_word", "source_end", "similarity")))
    rows = found.groupBy(*PAIR).agg(every.alias("every"))
    reach = lambda acc, r: F.when((F.size(acc) > 0) & (r["end_word"] <= F.get(acc, F.size(acc) - 1)["end_word"]), acc).otherwise(F.concat(acc, F.array(r)))
    kept = rows.withColumn("kept", F.aggregate("every", F.slice("every", 1, 0), reach)).select(*PAIR, F.explode("kept").alias("r"))
    return kept.select(*PAIR, *(F.col(f"r.{c}") for c in ("start_word", "end_word", "source_start", "source_end", "similarity")))


def regions(found: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, variant and the ranges of words (start, end) of the text's repeated regions."""
    ranges = F.array_sort(F.collect_set(F.struct(F.col("start_word").alias("s"), F.col("end_word").alias("e"))))
    merged = found.groupBy("doc_id", "variant").agg(ranges.alias("ranges")).select("doc_id", "variant", F.expr(_MERGE).alias("ranges"))
    return merged.select("doc_id", "variant", F.filter("ranges", lambda r: r["e"] - r["s"] >= min_words).alias("ranges")).where(F.size("ranges") > 0)


#: Folds sorted ranges into regions: a range that begins at most TOUCH words after the last region's end widens it.
_MERGE = f"""
aggregate(ranges, cast(array() as array<struct<s:int,e:int>>), (acc, r) ->
  if(size(acc) > 0 and r.s <= get(acc, size(acc) - 1).e + {TOUCH},
     concat(slice(acc, 1, greatest(size(acc) - 1, 0)), array(named_struct('s', get(acc, size(acc) - 1).s, 'e', greatest(get(acc, size(acc) - 1).e, r.e)))),
     concat(acc, array(named_struct('s', r.s, 'e', r.e)))))
"""


def find(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The passages that lie in repeated regions, with the words of their region: one row for each pair of texts and place."""
    found = passages(docs)
    where = regions(found, min_words)
    inside = F.filter("ranges", lambda r: (r["s"] <= F.col("start_word")) & (F.col("end_word") <= r["e"]))
    rows = found.join(where, ["doc_id", "variant"]).withColumn("region", F.get(inside, F.lit(0))).where(F.col("region").isNotNull())
    return rows.select(
        "doc_id", "source_id", "start_word", "end_word", "source_start", "source_end", (F.col("end_word") - F.col("start_word")).cast("long").alias("n_words"),
        F.round("similarity", 6).alias("similarity"), F.col("region.s").alias("region_start"), F.col("region.e").alias("region_end"),
    )


def without(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without the given ranges of words and the white space after them."""
    places = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for s, e in ranges:
        out.append(text[at : places[min(s, len(places) - 1)]])
        at = places[min(e, len(places) - 1)]
    return "".join([*out, text[at:]])


def cut(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without their repeated regions; an integer column n_chars follows the text."""
    small_batches(docs.sparkSession)
    every = F.collect_list(F.struct("variant", "ranges")).alias("texts")
    where = stage(regions(passages(docs), min_words).groupBy(F.col("doc_id").alias("cut_id")).agg(every), "regions")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"))
    near, whole = parted(rows, "id", where, "cut_id")  # only texts that have regions, and few others, are shuffled to them
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = dict(zip(columns, batch.column("row").flatten()))
            texts = batch.column("texts")
            if texts.null_count < len(texts):
                text, counted = own["text"].to_pylist(), "n_chars" in own and pa.types.is_integer(own["n_chars"].type)
                n = own["n_chars"].to_pylist() if counted else []
                for k, known in enumerate(texts.to_pylist()):
                    variant = variant_of(text[k]) if known else None
                    for r in known or ():
                        if r["variant"] == variant:
                            text[k] = without(text[k], [(x["s"], x["e"]) for x in r["ranges"]])
                            if counted:
                                n[k] = len(text[k])
                own["text"] = pa.array(text, pa.string())
                if counted:
                    own["n_chars"] = pa.array(n, own["n_chars"].type)
            yield pa.RecordBatch.from_arrays([own[c] for c in columns], names=columns)

    return near.join(where, F.col("id") == F.col("cut_id"), "left").select("row", "texts").mapInArrow(run, docs.schema).unionByName(whole.select("row.*"))
