"""WARC derivatives: metadata and plain-text conversion records made from response records.

``responses`` wraps pages as response records; ``read_warc`` reads them from WARC files. ``derive`` makes two records of
each response: a ``metadata`` record (application/warc-fields: the source's HTTP status and headers, payload digest,
title, language, number of links) and a ``conversion`` record (text/plain: the payload's text). Both keep the target URI
and date, name the source in WARC-Refers-To and carry digests of their own blocks; they name each other in
WARC-Concurrent-To. Identifiers are made of the source's identifier, so a repeated run gives the same ones. All of
deriving is DataFrame functions in one pass without a shuffle; only reading WARC files runs Python. ``write_warc`` stores
records as gzip files of one member each, through Spark's own writer and so on any of its file systems.

Cases: a null payload is empty and gives empty text; a null URI stays null and is left out of the headers; repeated
rows give repeated records; markup that never closes is text from there on. Extra columns aren't carried. An empty
table gives no records. Of files: a source's own payload digest is kept, and computed from the payload's bytes where it
has none; chunked and gzip or deflate bodies are undone and characters decoded by the charset named in the headers or
the markup, UTF-8 otherwise, bytes that can't be decoded becoming U+FFFD; a record whose length is missing or no number
ends where the next one begins; a file that is no WARC file, or cut off, gives the records before that.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.llm.common import small_batches

VERSION = "WARC/1.1"
#: The date of response records made of pages, which have none of their own.
PAGE_DATE = "2024-01-01T00:00:00Z"

#: Blanks and line ends at both ends of a text.
ENDS = "^[ \\n]+|[ \\n]+$"
#: Fixed values: (pattern, replacement) steps from markup to text, in order; patterns that Java and RE2 read alike.
TEXT_STEPS = [
    ("(?s)<!--.*?-->", ""),
    (r"(?is)<script\b.*?</script[^>]*>", ""),
    (r"(?is)<style\b.*?</style[^>]*>", ""),
    (r"(?is)<head\b.*?</head[^>]*>", ""),
    (r"(?i)</?(p|div|br|h[1-6]|li|ul|ol|tr|td|th|table|article|section|nav|header|footer|main|aside|blockquote|pre|form|hr)\b[^>]*>", "\n"),
    ("<[/!?a-zA-Z][^>]*>", ""),
    ("&nbsp;|&#160;", " "),
    ("&quot;|&#34;", '"'),
    ("&apos;|&#39;", "'"),
    ("&lt;|&#60;", "<"),
    ("&gt;|&#62;", ">"),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&ndash;", "–"),
    ("&mdash;", "—"),
    ("&hellip;", "…"),
    ("&amp;|&#38;", "&"),
    ("[ \\t\\r\\f]+", " "),
    (" ?\\n[ \\n]*", "\n"),
    (ENDS, ""),
]


def _literals(pattern: str, new: str) -> list[str]:
    """The alternatives of a pattern of plain characters, which may be replaced one after another since no replacement can
    be part of another one; none of any other pattern."""
    parts = pattern.split("|")
    plain = all(re.fullmatch("[&#;0-9a-z]+", p) for p in parts) and not any(c in p for c in new for p in parts)
    return parts if plain else []


def text_of(markup: Column) -> Column:
    """The steps on a column. Plain alternatives and the trimming at both ends need no regular expression."""
    out = F.coalesce(markup, F.lit(""))
    for pattern, new in TEXT_STEPS:
        parts = _literals(pattern, new)
        for part in parts:
            out = F.replace(out, F.lit(part), F.lit(new))
        if pattern == ENDS:
            out = F.btrim(out, F.lit(" \n"))
        elif not parts:
            out = F.regexp_replace(out, F.lit(pattern), F.lit(new))
    return out


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def urn(*parts: Column) -> Column:
    """A record identifier that depends on nothing but its parts."""
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def responses(pages: DataFrame, date: str = PAGE_DATE) -> DataFrame:
    """source_id, record_id, target_uri, date, http_headers, payload and payload_digest of pages (page_id, url, html)."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"))
    return pages.select(
        F.col("page_id").alias("source_id"),
        urn(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), F.sha2(payload, 256)).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        head.alias("http_headers"),
        payload.alias("payload"),
        digest(payload).alias("payload_digest"),
    )


def derive(sources: DataFrame) -> DataFrame:
    """Two records for each response: metadata and conversion."""
    title = F.regexp_extract("payload", r"(?is)<title[^>]*>([^<]*)</title", 1)
    lang = F.regexp_extract("payload", r"(?is)<html[^>]*\blang=.([a-zA-Z-]*)", 1)
    links = F.size(F.split("payload", r"(?i)<a\s[^>]*href=")) - 1
    status = F.regexp_extract("http_headers", r"^HTTP/[0-9.]+ ([0-9]+)", 1)
    own = F.regexp_replace(F.regexp_replace("http_headers", "^HTTP/[^\\r\\n]*[\\r\\n]*", ""), "\\r\\n", "\r\nsource-")
    fields = F.concat(
        F.lit("source-status: "), status,
        F.when(own != "", F.concat(F.lit("\r\nsource-"), own)).otherwise(F.lit("")),
        F.lit("\r\nsource-payload-digest: "), F.col("payload_digest"),
        F.lit("\r\ntitle: "), F.regexp_replace(title, "[\\r\\n]+", " "),
        F.lit("\r\nlanguage: "), lang,
        F.lit("\r\nlinks: "), links.cast("string"), F.lit("\r\n"),
    )
    meta_id, text_id = urn(F.lit("metadata"), F.col("record_id")), urn(F.lit("conversion"), F.col("record_id"))

    def record(kind: str, mine: Column, other: Column, content_type: str, block: Column) -> Column:
        return F.struct(F.lit(kind).alias("record_type"), mine.alias("id"), other.alias("concurrent_to"), F.lit(content_type).alias("content_type"), block.alias("block"))

    both = F.array(record("metadata", meta_id, text_id, "application/warc-fields", fields), record("conversion", text_id, meta_id, "text/plain; charset=utf-8", text_of(F.col("payload"))))
    rows = sources.select("source_id", "record_id", "target_uri", "date", "payload_digest", F.explode(both).alias("r"))
    return rows.select(
        "source_id",
        "r.record_type",
        F.col("r.id").alias("record_id"),
        F.col("record_id").alias("refers_to"),
        "r.concurrent_to",
        "target_uri",
        "date",
        "r.content_type",
        F.octet_length("r.block").cast("long").alias("content_length"),
        digest(F.col("r.block")).alias("block_digest"),
        F.col("payload_digest").alias("source_digest"),
        "r.block",
    )


#: What ends a record in a file.
RECORD_END = "\r\n\r\n"


def serialized(records: DataFrame) -> DataFrame:
    """Each derived record as the text of a WARC record, without its end, in a column ``value``."""
    def line(name: str, value: Column) -> Column:
        return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), "[\\r\\n]+", " "), F.lit("\r\n")))

    head = F.concat(
        F.lit(f"{VERSION}\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("target_uri")), line("WARC-Refers-To", F.col("refers_to")), line("WARC-Concurrent-To", F.col("concurrent_to")),
        line("WARC-Block-Digest", F.col("block_digest")), line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length")),
    )
    return records.select(F.concat(head, F.lit("\r\n"), F.col("block")).alias("value"))


def write_warc(records: DataFrame, path: str) -> None:
    """Write derived records as gzip WARC files into a folder, a file for each partition; each file is one gzip member."""
    serialized(records).write.option("lineSep", RECORD_END).option("compression", "gzip").text(path)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of a WARC file, decompressed as it is read."""
    raw = io.BytesIO(data)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if data[:2] == b"\x1f\x8b" else raw
    try:
        line = stream.readline()
        while line:
            if not line.startswith(b"WARC/"):
                line = stream.readline()
                continue
            head: dict[str, str] = {}
            while (line := stream.readline()).strip():
                name, _, value = line.decode("utf-8", "replace").partition(":")
                head[name.strip().lower()] = value.strip()
            size = head.get("content-length", "")
            if size.isascii() and size.isdigit():
                block, line = stream.read(int(size)), stream.readline()
            else:
                lines = []
                while (line := stream.readline()) and not line.startswith(b"WARC/"):
                    lines.append(line)
                block = b"".join(lines).removesuffix(RECORD_END.encode())
            yield head, block
    except (EOFError, gzip.BadGzipFile, zlib.error):  # a file that is cut off or damaged: what came before it counts
        return


def http_parts(block: bytes) -> tuple[str, bytes]:
    """The header lines and the raw payload of an HTTP response."""
    head, _, payload = block.partition(b"\r\n\r\n")
    return head.decode("utf-8", "replace"), payload


def body_of(http: str, payload: bytes) -> bytes:
    """A payload without its chunks and compression; one that doesn't decode stays as it is."""
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(":") for x in http.split("\r\n")[1:])}
    if "chunked" in fields.get("transfer-encoding", ""):
        parts, at = [], 0
        while m := re.compile(rb"([0-9a-fA-F]{1,8})[^\r\n]*\r\n").match(payload, at):
            n, at = int(m[1], 16), m.end()
            parts.append(payload[at : at + n])
            at += n + 2
        payload = b"".join(parts) if parts else payload
    wanted = {"gzip": 47, "x-gzip": 47, "deflate": 47}.get(fields.get("content-encoding", ""))
    for bits in (wanted, -15) if wanted else ():
        try:
            return zlib.decompressobj(bits).decompress(payload)
        except zlib.error:
            continue
    return payload


def text_from(http: str, body: bytes) -> str:
    """A body's characters by the charset of its headers, or else of its markup's first 1,024 bytes."""
    named = re.search(r"(?im)^content-type:.*charset=[\"']?([\w.:-]+)", http) or re.search(r"(?i)<meta[^>]*charset=[\"']?([\w.:-]+)", body[:1024].decode("latin-1"))
    try:
        return body.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


RECORD = ("record_type", "record_id", "target_uri", "date", "refers_to", "block_digest", "payload_digest", "http_headers", "payload")
#: A batch of records read from a file holds about so many characters.
BATCH_CHARS = 8_000_000


def _record(head: dict[str, str], block: bytes) -> tuple:
    http, payload, digest_ = None, block, head.get("warc-payload-digest")
    text = None
    if head.get("warc-type") == "response":
        http, payload = http_parts(block)
        body = body_of(http, payload)
        digest_ = digest_ or "sha256:" + hashlib.sha256(body).hexdigest()
        text = text_from(http, body)
    return (*(head.get(k) for k in ("warc-type", "warc-record-id", "warc-target-uri", "warc-date", "warc-refers-to", "warc-block-digest")), digest_, http, block.decode("utf-8", "replace") if text is None else text)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, plain or gzip; responses are parted into HTTP headers and the payload's text. A task holds one
    file as it is stored and a bounded batch of its records."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [[]] * len(RECORD))], names=list(RECORD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for head, block in parse_records(content.as_py()):
                    rows.append(_record(head, block))
                    size += len(block)
                    if size > BATCH_CHARS:
                        yield batch_of(rows)
                        rows, size = [], 0
                yield batch_of(rows)

    small_batches(spark, 1)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ", ".join(f"{n} string" for n in RECORD))


def sources_of(records: DataFrame) -> DataFrame:
    """The response records of ``read_warc`` as sources for ``derive``."""
    return records.where(F.col("record_type") == "response").select(
        F.lit(None).cast("long").alias("source_id"), "record_id", "target_uri", "date", F.coalesce("http_headers", F.lit("")).alias("http_headers"), F.coalesce("payload", F.lit("")).alias("payload"), "payload_digest"
    )


def oracle_sql() -> str:
    """The derivatives of ``pages`` in SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    text = "p"
    for pattern, new in TEXT_STEPS:
        new_sql = "chr(10)" if new == "\n" else quote(new)
        text = f"regexp_replace({text}, {quote(pattern)}, {new_sql}, 'g')"
    uuid = lambda h: f"'<urn:uuid:' || substr({h},1,8) || '-' || substr({h},9,4) || '-' || substr({h},13,4) || '-' || substr({h},17,4) || '-' || substr({h},21,12) || '>'"
    nl = "chr(13) || chr(10)"
    return f"""
WITH a AS (SELECT page_id, url, coalesce(html, '') AS p FROM pages),
b AS (SELECT *, sha256(p) AS sha, strlen(p) AS n FROM a),
c AS (SELECT *, md5('response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '') || '|' || sha) AS h FROM b),
d AS (SELECT *, {uuid('h')} AS rid FROM c),
e AS (SELECT *, md5('metadata|' || rid) AS hm, md5('conversion|' || rid) AS hc FROM d),
f AS (SELECT page_id, url, sha, rid, 'metadata' AS record_type, {uuid('hm')} AS record_id, {uuid('hc')} AS concurrent_to, 'application/warc-fields' AS content_type,
  'source-status: 200' || {nl} || 'source-Content-Type: text/html; charset=utf-8' || {nl} || 'source-Content-Length: ' || n || {nl} || 'source-payload-digest: sha256:' || sha || {nl}
  || 'title: ' || regexp_replace(regexp_extract(p, '(?is)<title[^>]*>([^<]*)</title', 1), '[\\r\\n]+', ' ', 'g') || {nl} || 'language: ' || regexp_extract(p, '(?is)<html[^>]*\\blang=.([a-zA-Z-]*)', 1)
  || {nl} || 'links: ' || len(regexp_extract_all(p, '(?i)<a\\s[^>]*href=')) || {nl} AS block FROM e
  UNION ALL
  SELECT page_id, url, sha, rid, 'conversion', {uuid('hc')}, {uuid('hm')}, 'text/plain; charset=utf-8', {text} FROM e)
SELECT page_id AS source_id, record_type, record_id, rid AS refers_to, concurrent_to, url AS target_uri, '{PAGE_DATE}' AS date, content_type,
  CAST(strlen(block) AS BIGINT) AS content_length, 'sha256:' || sha256(block) AS block_digest, 'sha256:' || sha AS source_digest, block FROM f
"""
