"""WARC archives: writing page captures, and assembling transactions from records.

Writing: each capture is a request, a response (or a revisit of an equal payload) and a metadata
record; request and metadata name the response in WARC-Concurrent-To.  A record is a line of text
that ends in CRLF CRLF, so Spark's text writer with that separator and gzip writes the archives,
with its commit protocol and on whatever store the path names.

Reading: archives are read as whole files (the writer bounds their records) and parsed by
Content-Length, so payloads may hold anything.  Transactions are assembled by joining the three
kinds through the concurrent-to identifiers; each kind is first aggregated by identifier, so the
three sides meet in one partitioning and copies of a record are counted, not multiplied.  One
nested row is given per capture.  A revisit's payload is the one of the response that its refers-to
identifier names.  One payload may be a third of all pages, so joins on payloads are salted.

Defined results: null html is an empty payload; rows repeated in full are captures of their own;
of rows with the largest page_id of a payload all are responses; a null page_id is written as an
empty identifier and never referred to unless all of the payload's are null; a revisit whose response is
not in the archives has no size and no page to refer to; an empty table gives no archive rows.
"""

from __future__ import annotations

import hashlib
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MIN_REVISIT_BYTES = 1000
RECORDS_PER_FILE = 6000
SALTS = 32
_DATE = "2024-01-01T00:00:00Z"
_CRLF = "\r\n"


def _urn(*parts):
    h = F.md5(F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) if isinstance(p, str) else p for p in parts]))
    cut = [F.substring(h, a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _salt(*columns: str):
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS))


def _salted(small: DataFrame) -> DataFrame:
    """Each row once for every salt."""
    return small.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))


def _record(kind: str, headers: list, body):
    """A whole record but for its last CRLF CRLF, which is the writer's separator."""
    lines = [F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), F.lit(f"WARC-Date: {_DATE}")]
    lines += [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v)) for k, v in headers]
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"))]
    return F.concat(F.concat_ws(_CRLF, *lines), F.lit(_CRLF * 2), body)


def write(pages: DataFrame, path: str, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> str:
    """Writes the pages (page_id, url, html) as gzip WARC files under path."""
    html = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ").alias("url"), html.alias("html"), F.octet_length(html).alias("size"), F.sha1(html.cast("binary")).alias("digest"))
    # only payloads that occur more than once have a row here
    first = p.where(F.col("size") >= min_revisit_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("keeper"), F.max_by("url", F.struct("page_id", "url")).alias("keeper_url"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    q = p.withColumn("salt", _salt("page_id", "url")).join(_salted(first), ["digest", "size", "salt"], "left")
    revisit = F.coalesce(F.col("keeper") != F.col("page_id"), F.col("keeper").isNotNull() & F.col("page_id").isNull(), F.lit(False))
    q = q.withColumns({"revisit": revisit, "response": _urn(F.lit("response"), "page_id", "digest"), "row": F.monotonically_increasing_id()})
    status = F.lit("HTTP/1.1 200 OK" + _CRLF + "Content-Type: text/html; charset=utf-8" + _CRLF * 2)
    uri = ("WARC-Target-URI", F.col("url"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    http = ("Content-Type", F.lit("application/http; msgtype=response"))
    response = _record("response", [("WARC-Record-ID", F.col("response")), uri, digest, http], F.concat(status, F.col("html")))
    again = _record("revisit", [("WARC-Record-ID", F.col("response")), uri, digest, http, ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To", _urn(F.lit("response"), "keeper", "digest")), ("WARC-Refers-To-Target-URI", F.col("keeper_url")), ("WARC-Refers-To-Date", F.lit(_DATE))], status)
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)
    ask = F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1" + _CRLF + "Host: "), host, F.lit(_CRLF * 2))
    together = ("WARC-Concurrent-To", F.col("response"))
    request = _record("request", [("WARC-Record-ID", _urn(F.lit("request"), "page_id", "digest", "row")), uri, together, ("Content-Type", F.lit("application/http; msgtype=request"))], ask)
    fields = F.concat_ws(_CRLF, F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit(""))), F.concat(F.lit("uri: "), F.col("url")))
    metadata = _record("metadata", [("WARC-Record-ID", _urn(F.lit("metadata"), "page_id", "digest", "row")), uri, together, ("Content-Type", F.lit("application/warc-fields"))], fields)
    records = q.select(F.explode(F.array(request, F.when(F.col("revisit"), again).otherwise(response), metadata)).alias("value"))
    records.write.mode("overwrite").option("compression", "gzip").option("lineSep", _CRLF * 2).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)
    return path


class _Stream:
    """Reads lines and lengths from gzip bytes, however many members they have, in small pieces."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.inflate, self.buffer = memoryview(raw), 0, zlib.decompressobj(31), bytearray()

    def _more(self) -> bool:
        while True:
            if self.inflate.eof:
                rest = self.inflate.unused_data
                self.at -= len(rest)
                if self.at >= len(self.raw):
                    return False
                self.inflate = zlib.decompressobj(31)
            if self.at >= len(self.raw):
                return False
            piece = self.inflate.decompress(self.raw[self.at : self.at + 65536])
            self.at += 65536 if self.at + 65536 <= len(self.raw) else len(self.raw) - self.at
            if piece:
                self.buffer += piece
                return True

    def head(self) -> str | None:
        while (end := self.buffer.find(b"\r\n\r\n")) < 0:
            if not self._more():
                return None
        out = self.buffer[:end].decode("utf-8", "replace")
        del self.buffer[: end + 4]
        return out

    def block(self, n: int) -> bytes:
        while len(self.buffer) < n + 4:
            if not self._more():
                break
        out = bytes(self.buffer[:n])
        del self.buffer[: n + 4]
        return out


def records(raw: bytes):
    """(headers with lower-case names, block) of each record of a gzip WARC file."""
    stream = _Stream(raw)
    while (head := stream.head()) is not None:
        if not head.strip():
            continue
        headers = {}
        for line in head.split("\r\n")[1:]:
            k, _, v = line.partition(":")
            headers[k.strip().lower()] = v.strip()
        yield headers, stream.block(int(headers.get("content-length", 0)))


def read_records(spark, path: str, payload: bool = True) -> DataFrame:
    """One row per record: type, record_id, concurrent_to, refers_to, uri, date, digest (declared), http (head), size, sha1, payload, fields."""
    columns = "type string, record_id string, concurrent_to string, refers_to string, uri string, date string, digest string, http string, size long, sha1 string, payload binary, fields string"

    def parse(batches):
        for pdf in batches:
            for raw in pdf["content"]:
                rows = []
                for h, block in records(raw):
                    kind = h.get("warc-type", "")
                    head, body, fields = "", b"", None
                    if kind == "metadata":
                        fields = block.decode("utf-8", "replace")
                    else:
                        top, _, body = block.partition(b"\r\n\r\n")
                        head = top.decode("utf-8", "replace")
                    rows.append((kind, h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-payload-digest"), head, len(body), hashlib.sha1(body).hexdigest(), body if payload else None, fields))
                    if len(rows) >= 500:
                        yield pd.DataFrame(rows, columns=[c.split()[0] for c in columns.split(", ")])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in columns.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInPandas(parse, columns)


def transactions(found: DataFrame) -> DataFrame:
    """capture_id, uri, date, response, request, metadata (structs): one row per capture."""
    main = found.where(F.col("type").isin("response", "revisit")).groupBy(F.col("record_id").alias("capture_id")).agg(
        F.first(F.struct("type", "refers_to", "digest", "http", "size", "sha1", "payload")).alias("response"), F.first("uri").alias("uri"), F.first("date").alias("date"), F.count(F.lit(1)).alias("copies"))
    by = lambda kind, *cols: found.where(F.col("type") == kind).groupBy(F.col("concurrent_to").alias("capture_id")).agg(F.first(F.struct("record_id", *cols)).alias(kind))
    out = main.join(by("request", "http"), "capture_id", "left").join(by("metadata", "fields"), "capture_id", "left")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copy", "copies")


def resolve(t: DataFrame) -> DataFrame:
    """The captures (capture_id, page_id, type, refers_to, size, sha1) with size, sha1 and page of the response that a revisit names."""
    revisits = t.where(F.col("type") == "revisit")
    named = revisits.select(F.col("refers_to").alias("capture_id")).distinct()
    answers = t.where(F.col("type") == "response").join(named, "capture_id", "left_semi").groupBy(F.col("capture_id").alias("refers_to")).agg(F.first(F.struct("page_id", "size", "sha1")).alias("named"))
    found = revisits.withColumn("salt", _salt("capture_id")).join(_salted(answers), ["refers_to", "salt"], "left")
    own = t.where(F.col("type") == "response").select("page_id", "type", "size", "sha1", F.lit(None).cast(t.schema["page_id"].dataType).alias("refers_to_page"))
    return own.unionByName(found.select("page_id", "type", F.col("named.size").alias("size"), F.col("named.sha1").alias("sha1"), F.col("named.page_id").alias("refers_to_page")))


def query(spark, sf_dir: str) -> DataFrame:
    pages = common.read(spark, sf_dir, "pages")
    path = write(pages, common.shared_path(spark, "warc"))
    t = transactions(read_records(spark, path, payload=False))
    page = F.regexp_extract("metadata.fields", r"(?:^|\n)page-id: ([^\r\n]*)", 1)
    t = t.select("capture_id", F.when(page != "", page.cast("long")).alias("page_id"), *[F.col(f"response.{c}").alias(c) for c in ("type", "refers_to", "size", "sha1")])
    t = resolve(common.materialize(t, "captures"))
    return t.select("page_id", F.col("size").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers_to_page").alias("refers_to"))


SQL = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND keeper <> page_id THEN keeper END AS refers_to FROM m
"""
