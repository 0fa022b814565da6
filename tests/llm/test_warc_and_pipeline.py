import pytest
from pyspark.sql import functions as F

from wavemill.llm import bpe, decontaminate, minhash, passages, quality, warc
from wavemill.llm.queries import ORACLE_SQL, QUERIES, word_bpe_path


def test_derivatives_agree_with_sql(spark, duck, data):
    df = QUERIES["op2_warc_derivatives"](spark, data)
    cols = sorted(df.columns)
    ours = sorted(repr(tuple(r)) for r in df.select(*cols).collect())
    theirs = sorted(repr(r) for r in duck.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE_SQL['op2_warc_derivatives']}) AS z").fetchall())
    assert ours == theirs


def test_text_and_links_of_records(spark):
    html = "<html lang='de'><head><title>A &amp; B</title></head><body><script>var x = '</p>';</script><p>One<br>two&nbsp;&lt;3</p><!-- no --><ul><li>a</li></ul><a href='x'>link</a>"
    pages = spark.createDataFrame([(1, "http://x/", html), (2, None, None), (2, None, None), (None, "http://y/", "plain < text")], "page_id long, url string, html string").withColumn("block", F.lit("clash"))
    rows = warc.derive(warc.responses(pages)).collect()
    assert len(rows) == 8
    one = {r["record_type"]: r for r in rows if r["source_id"] == 1}
    assert one["conversion"]["block"] == "One\ntwo <3\na\nlink"
    meta, text = one["metadata"], one["conversion"]
    assert meta["refers_to"] == text["refers_to"] and meta["concurrent_to"] == text["record_id"] and text["concurrent_to"] == meta["record_id"]
    assert "source-Content-Type: text/html; charset=utf-8\r\n" in meta["block"] and "language: de" in meta["block"] and "links: 1" in meta["block"]
    assert all(r["content_length"] == len(r["block"].encode()) for r in rows)
    assert {r["block"] for r in rows if r["record_type"] == "conversion" and r["source_id"] == 2} == {""}
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


def test_files_are_written_and_read(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://x/", "<p>Grüße</p>"), (2, "http://y/", "<p>b</p>")], "page_id long, url string, html string")
    derived = warc.derive(warc.responses(pages))
    warc.write_warc(derived, str(tmp_path / "out"))
    back = warc.read_warc(spark, str(tmp_path / "out"))
    want = {(r["record_id"], r["refers_to"], r["block"].rstrip()) for r in derived.collect()}
    assert {(r["record_id"], r["refers_to"], r["payload"].rstrip()) for r in back.collect()} == want
    raw = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:1>\r\nWARC-Target-URI: http://z/\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: 57\r\n\r\nHTTP/1.1 404 Not Found\r\nServer: s\r\nX-Y: z\r\n\r\n<p>gone</p>\r\n\r\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc").write_bytes(raw)
    meta = warc.derive(warc.sources_of(warc.read_warc(spark, str(tmp_path / "in")))).where("record_type = 'metadata'").first()
    assert meta["refers_to"] == "<urn:1>" and meta["block"].startswith("source-status: 404\r\nsource-Server: s\r\nsource-X-Y: z\r\nsource-payload-digest: sha256:")


def warc_record(http: bytes, body: bytes, extra: bytes = b"", length: bytes | None = None) -> bytes:
    block = http + b"\r\n\r\n" + body
    return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:r>\r\n" + extra + b"Content-Length: " + (length or str(len(block)).encode()) + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_bodies_are_decoded_and_digests_kept(spark, tmp_path):
    import gzip
    import hashlib

    body = "<p>Grüße</p>"
    packed = gzip.compress(body.encode("latin-1"))
    chunked = b"%x\r\n" % 5 + packed[:5] + b"\r\n%x;x=y\r\n" % len(packed[5:]) + packed[5:] + b"\r\n0\r\n\r\n"
    kept = b"WARC-Payload-Digest: sha1:ABC\r\nWARC-Block-Digest: sha1:DEF\r\n"
    records = [
        warc_record(b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked", chunked, kept),
        warc_record(b"HTTP/1.1 200 OK", b"<meta charset='latin-1'>" + body.encode("latin-1"), length=b"unknown"),
        warc_record(b"HTTP/1.1 200 OK", body.encode(), b"WARC-Target-URI: http://a/\r\n"),
        b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 1\r\n\r\nx\r\n\r\n",
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "b.warc").write_bytes(b"".join(records))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(records[2])[:-9])
    (tmp_path / "d.warc").write_bytes(b"no such thing")
    (tmp_path / "e.warc").write_bytes(b"")
    got = warc.read_warc(spark, str(tmp_path)).collect()
    rows = [r for r in got if r["record_type"] == "response"]
    assert len(got) - len(rows) == 2 and len(rows) >= 6
    assert all("Grüße" in r["payload"] for r in rows)
    assert sorted({(r["payload_digest"], r["block_digest"]) for r in rows}, key=str)[0] == ("sha1:ABC", "sha1:DEF")
    assert {r["payload_digest"] for r in rows if r["target_uri"]} == {"sha256:" + hashlib.sha256(body.encode()).hexdigest()}
    meta = warc.derive(warc.sources_of(warc.read_warc(spark, str(tmp_path / "b.warc")))).where("record_type = 'metadata'").collect()
    assert len(meta) == 3 and "source-payload-digest: sha1:ABC" in meta[0]["block"] and {m["source_digest"] for m in meta} >= {"sha1:ABC"}


def test_long_and_unclosed_markup(spark):
    pages = spark.createDataFrame([(1, "u", "<p>" + "word " * 200_000 + "<!-- never closed <b>x"), (2, "u", "<script>never closed <p>y")], "page_id long, url string, html string")
    got = {r["source_id"]: r["block"] for r in warc.derive(warc.responses(pages)).where("record_type = 'conversion'").collect()}
    assert got[1].count("word") == 200_000 and got[1].endswith("x") and got[2].endswith("y")


def test_pipeline_equals_its_operators_stage_by_stage(spark, data):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    model = quality.fit(docs, labels)
    rows = docs.collect()
    score = dict(zip((r["doc_id"] for r in rows), quality.score([r["text"] for r in rows], model)))
    one = corpus_pipeline.quality_classifier(spark, docs, data)
    assert ids(one) == sorted(i for i, s in score.items() if s >= quality.THRESHOLD) and one.columns == docs.columns
    two = corpus_pipeline.near_duplicates(spark, one, data)
    assert ids(two) == sorted(r["doc_id"] for r in minhash.near_duplicates(one).where("kept").collect())
    three = corpus_pipeline.repeated_passages(spark, two, data)
    assert ids(three) == ids(two) and three.columns == docs.columns
    assert passages.find(three.where("text is not null")).where("n_words >= 50").count() == 0
    four = corpus_pipeline.benchmark_decontamination(spark, three, data)
    bad = decontaminate.report(decontaminate.find_hits(three, spark.read.parquet(f"{data}/benchmark.parquet"))).where("contaminated")
    assert ids(four) == sorted(set(ids(three)) - set(ids(bad)))
    last = corpus_pipeline.run(spark, data).collect()
    own = bpe.ForcedBoundaryBpe(word_bpe_path())
    assert {r["doc_id"]: r["n_tokens"] for r in last} == {r["doc_id"]: len(own.encode(r["text"])) for r in four.collect()}


def test_stages_take_odd_documents(spark, data, tmp_path):
    """Nulls, empty and very long texts, repeated rows, names that clash and an empty table pass through every stage."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    bench = [r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    good = [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").limit(8).collect()]
    rows = [(1, None), (2, ""), (None, good[0]), (3, good[1]), (3, good[1]), (4, "word " * 20_000), (5, bench[0]), (6, good[2]), (7, good[2]), (8, "a"), (9, "\u2028 \x1c ©")]
    docs = spark.createDataFrame([(i, t, "en", None, 0, 1.0, "r") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, row string")
    for table_of in (docs, docs.limit(0)):
        now = table_of
        for name, step in corpus_pipeline.STAGES[:-1]:
            now = step(spark, now, data)
            assert now.columns == docs.columns, name
            now = spark.createDataFrame(now.collect(), docs.schema)
        ids = [r["doc_id"] for r in now.collect()]
        last = corpus_pipeline.STAGES[-1][1](spark, now, data).collect()
        assert sorted(map(str, ids)) == sorted(str(r["doc_id"]) for r in last)
        if table_of is docs:
            assert 5 not in ids and 7 not in ids and ids.count(3) <= 1
            assert {r["n_tokens"] for r in last if r["doc_id"] in (1, 2)} <= {0}
