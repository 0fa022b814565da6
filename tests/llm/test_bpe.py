import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from wavemill.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def pair():
    return bpe.ForcedBoundaryBpe(PATH), Tokenizer.from_file(PATH)


def test_random_text_of_all_kinds(pair):
    own, other = pair
    rnd = random.Random(3)
    pool = [chr(c) for c in range(0x180)] + list("Σİſ 　́가一😀‍﻿Ⅷ²ẞﬁÅ") + ["'s", "'RE", "<|startoftext|>", "<|endoftext|>", "<|", "the", "ing"]
    for _ in range(4000):
        s = "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 14)))
        ids = other.encode(s, add_special_tokens=False).ids
        assert list(own.encode(s)) == ids, ascii(s)
        assert own.decode(ids) == other.decode(ids, skip_special_tokens=False)


def test_cuts_are_where_no_token_can_span(pair):
    own, _ = pair
    word = "thequickßzz"
    shown = "".join(own.alphabet[b] for b in word.encode())
    assert "".join(own.cut(shown)) == shown
    assert all(a[-1] + b[0] not in own.joinable for a, b in zip(own.cut(shown), own.cut(shown)[1:]))


def test_a_word_of_a_million_letters(pair):
    own, other = pair
    s = "ab" * 200_000
    assert list(own.encode(s)) == other.encode(s, add_special_tokens=False).ids


def test_bounded_caches_change_nothing(pair):
    tiny = bpe.ForcedBoundaryBpe(PATH, cache_entries=2)
    s = "one two three two one, Four! " * 5
    assert tiny.encode(s) == pair[0].encode(s) and len(tiny.chunks) <= 3


def test_query_rows(spark, pair):
    rows = [(1, "Hello  World", "x"), (2, None, "y"), (3, "", "z"), (1, "Hello  World", "x"), (None, "a<|endoftext|>b", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.digests(bpe.encode_decode(df, PATH)).collect()
    assert len(got) == 5
    for r, (i, t, _) in zip(got, rows):
        ids = pair[1].encode(t or "", add_special_tokens=False).ids
        assert (r["doc_id"], r["n_tokens"]) == (i, len(ids))
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(pair[1].decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(bpe.encode_decode(df.limit(0), PATH)).count() == 0


def test_a_worker_keeps_no_words_after_its_task(spark):
    df = spark.createDataFrame([(k, f"word{k} other{k}") for k in range(40)], "doc_id long, text string")

    def held(batches):
        for batch in batches:
            words = [len(b.chunks) + len(b.fragments) for b in bpe._loaded.values()]
            yield pa.RecordBatch.from_pydict({"n": pa.array([sum(words) if words else None] * batch.num_rows, pa.int64())})

    bpe.encode_decode(df.repartition(4), PATH).write.format("noop").mode("overwrite").save()
    found = [r["n"] for r in spark.range(8, numPartitions=8).mapInArrow(held, "n long").collect()]
    assert any(n is not None for n in found) and not any(found)
