"""BPE encoding and decoding by forced boundaries.

A byte pair that occurs inside no vocabulary token can be joined by no merge, so a word is certainly cut between the
two bytes. Fragments between such cuts are encoded on their own and the ids concatenated, which gives the same ids as
merging the whole word. Frequent words and fragments are kept in bounded caches of each task; every text is
encoded whole, one row at a time, without a shuffle.

Cases: a null text is the empty text, which has no ids and decodes to the empty text. Repeated rows give repeated
rows. Extra columns pass through; columns named ``ids`` or ``decoded`` are replaced. An empty table gives an empty one.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator
from operator import add

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavemill.llm.common import small_batches

#: Entries of a task's word cache and of its fragment cache.
CACHE_ENTRIES = 500_000
#: Fragments of so many bytes are merged by a plain search for the least rank.
SHORT = 64

#: Unicode white space, which the tokenizer's normalizer turns into a space.
WHITE_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
#: Characters that str.split() takes as white space though Unicode's property doesn't.
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")


def byte_alphabet() -> list[str]:
    """The printable character of each byte in byte-level vocabularies: itself where printable, else from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


class ForcedBoundaryBpe:
    """A byte-level BPE with word ends, read from a tokenizer file."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.alphabet = byte_alphabet()
        self.words = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.spaces = regex.compile(WHITE_SPACE)
        self.specials = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.special_heads = tuple({t[:2] for t in self.special})
        self.joinable = self._pairs_inside_tokens()
        self.cache_entries = cache_entries
        self.chunks: dict[str, bytes] = {}
        self.fragments: dict[tuple[str, bool], tuple[int, ...]] = {}

    def forget(self) -> None:
        """Empty the caches: a worker lives on after its task, and what they hold would be lost to the stages that follow."""
        self.chunks.clear()
        self.fragments.clear()

    def _pairs_inside_tokens(self) -> set[str]:
        inside = set()
        for token in self.vocab:
            body = token.removesuffix(self.end) if len(token) > len(self.end) else token
            inside.update(body[k : k + 2] for k in range(len(body) - 1))
        return inside

    def cut(self, word: str) -> list[str]:
        """The fragments of a word (in the byte alphabet) between its forced boundaries."""
        pairs = list(map(add, word, word[1:]))
        if self.joinable.issuperset(pairs):
            return [word]
        out, start = [], 0
        for k, pair in enumerate(pairs, 1):
            if pair not in self.joinable:
                out.append(word[start:k])
                start = k
        out.append(word[start:])
        return out

    def merge(self, fragment: str, last: bool) -> tuple[int, ...]:
        """Ids of one fragment; ``last``: it ends its word. Short fragments look for the least rank in a list, long ones
        keep a heap of ranked pairs over a linked list: n log n."""
        parts: list[str | None] = list(fragment)
        if last:
            parts[-1] += self.end
        if len(parts) <= SHORT:
            rank_of, none = self.rank.get, len(self.rank)
            ranks = [rank_of(pair, none) for pair in zip(parts, parts[1:])]
            while ranks and (least := min(ranks)) < none:
                k = ranks.index(least)
                parts[k] += parts.pop(k + 1)
                ranks.pop(k)
                if k:
                    ranks[k - 1] = rank_of((parts[k - 1], parts[k]), none)
                if k < len(ranks):
                    ranks[k] = rank_of((parts[k], parts[k + 1]), none)
            return tuple([self.vocab[p] for p in parts])
        n, rank = len(parts), self.rank
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, k) for k in range(n - 1) if (r := rank.get((parts[k], parts[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            j = right[k]
            if parts[k] is None or j >= n or rank.get((parts[k], parts[j])) != r:
                continue
            parts[k] += parts[j]
            parts[j] = None
            right[k] = right[j]
            if right[k] < n:
                left[right[k]] = k
                if (q := rank.get((parts[k], parts[right[k]]))) is not None:
                    heapq.heappush(heap, (q, k))
            if left[k] >= 0 and (q := rank.get((parts[left[k]], parts[k]))) is not None:
                heapq.heappush(heap, (q, left[k]))
        return tuple(self.vocab[p] for p in parts if p is not None)

    def encode_chunk(self, chunk: str) -> bytes:
        """Ids of a run of text without white space, as 32-bit integers."""
        ids: list[int] = []
        norm = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        for word in [norm] if norm.isascii() and norm.isalpha() else self.words.findall(norm):
            pieces = self.cut(word if word.isascii() and word.isprintable() else "".join([self.alphabet[b] for b in word.encode("utf-8", "surrogatepass")]))
            for k, piece in enumerate(pieces):
                key = (piece, k == len(pieces) - 1)
                got = self.fragments.get(key)
                if got is None:
                    got = self.merge(*key)
                    if len(piece) <= 64:
                        if len(self.fragments) >= self.cache_entries:
                            self.fragments.clear()
                        self.fragments[key] = got
                ids.extend(got)
        return array("i", ids).tobytes()

    def encode_plain(self, text: str) -> bytes:
        split = self.spaces.split(text) if any(c in text for c in SEPARATORS) else text.split()
        try:  # most batches of a warm cache take this way
            return b"".join([self.chunks[c] for c in split])
        except KeyError:
            pass
        out = []
        for c in split:
            got = self.chunks.get(c)
            if got is None:
                got = self.encode_chunk(c)
                if len(c) <= 64:
                    if len(self.chunks) >= self.cache_entries:
                        self.chunks.clear()
                    self.chunks[c] = got
            out.append(got)
        return b"".join(out)

    def encode(self, text: str | None) -> array:
        """Ids of a whole text; the texts of special tokens stand for their ids, as in the tokenizer itself."""
        ids = array("i")
        if not text:
            return ids
        if self.specials is None or not any(h in text for h in self.special_heads):
            ids.frombytes(self.encode_plain(text))
            return ids
        for k, part in enumerate(self.specials.split(text)):
            if k % 2:
                ids.append(self.special[part])
            else:
                ids.frombytes(self.encode_plain(part))
        return ids

    def decode(self, ids) -> str:
        """The tokens joined by spaces: what a tokenizer without a decoder gives; ids outside the vocabulary are left out."""
        try:
            return " ".join(map(self.text_of.__getitem__, ids))
        except KeyError:
            return " ".join(self.text_of[i] for i in ids if i in self.text_of)


_loaded: dict[str, ForcedBoundaryBpe] = {}


def load(path: str) -> ForcedBoundaryBpe:
    """One tokenizer of a file in each Python worker."""
    if path not in _loaded:
        _loaded[path] = ForcedBoundaryBpe(path)
    return _loaded[path]


def encode_decode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add ``ids`` array<int>, the whole text's token ids, and ``decoded`` string, the ids decoded again.

    ``path`` is a tokenizer file that each worker can read (it comes with an installed package).
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("ids", "decoded")])
    schema = T.StructType([*base.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        try:
            for batch in batches:
                flat, offsets, decoded = array("i"), array("i", [0]), []
                for t in batch.column(text).to_pylist():
                    ids = bpe.encode(t)
                    flat.extend(ids)
                    offsets.append(len(flat))
                    decoded.append(bpe.decode(ids))
                lists = pa.ListArray.from_arrays(pa.array(memoryview(offsets), pa.int32()) if len(offsets) else [], _ints(flat))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(decoded, pa.string())], names=[*batch.schema.names, "ids", "decoded"])
        finally:
            bpe.forget()

    return base.mapInArrow(run, schema)


def _ints(values: array) -> pa.Array:
    return pa.Array.from_buffers(pa.int32(), len(values), [None, pa.py_buffer(values.tobytes())])


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and digests of the decimal ids and of the decoded text of an encoded table."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
