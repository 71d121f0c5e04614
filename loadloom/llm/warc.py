"""A content-addressed WARC archive.

``payloads`` holds each payload's bytes once, under a digest of SHA-256, SHA-1 and length that is
checked again when it is read; ``headers`` holds the exact header block of every record and, of a response,
the digest of its payload. :func:`records` puts every record together again by a join of the two, as the bytes
of WARC files; what :func:`archive` says of a record is read out of these bytes.

Of the records with equal payloads of at least ``LEAST_REVISIT`` bytes, the one with the largest
id is a response and the others revisit it; smaller payloads are responses all.

Defined results. A null payload counts as empty. A null url gives a header without target
URI; line breaks in a url are percent-encoded. Rows that share an id are records of their
own; where the largest id of a payload occurs more than once, each of its rows is a response.
A null id never wins over another id. An empty table gives an empty archive. Payloads are kept whole, whatever their
length. Columns other than the id, the url and the payload are dropped, so none can clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, materialize, shared_path

#: Payloads of fewer bytes are stored as responses always.
LEAST_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_uri(key: Column) -> Column:
    """A record id that depends on the key alone."""
    h = F.md5(F.concat(F.lit("record:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def header_block(kind: Column, key: Column, url: Column, digest: Column, length: Column, refers: Column) -> Column:
    """The record's WARC and HTTP headers, as they stand before its payload."""
    clean = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n"))
    body = F.octet_length(http) + F.when(kind == "response", length).otherwise(F.lit(0))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), record_uri(key)),
        F.concat(F.lit("WARC-Date: "), F.lit(DATE)),
        F.concat(F.lit("WARC-Target-URI: "), clean),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.when(kind == "revisit", F.concat(F.lit("WARC-Refers-To: "), record_uri(refers), F.lit(f"\r\nWARC-Profile: {PROFILE}"))),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), body.cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), http)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, payload) -> (digest, compressed payload)."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([squeeze(p.as_py()) for p in batch.column(1)], pa.binary())], ["digest", "stored"])


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write the archive of ``pages`` to ``path``: ``headers`` and ``payloads``, both parquet."""
    raw = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), raw.alias("payload"))
    rows = rows.withColumns({"length": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload")})
    # Two payloads share a key only if SHA-256, SHA-1 and length all agree.
    rows = rows.withColumn("digest", F.concat(F.unhex(F.sha2("payload", 256)), F.unhex("sha1"), F.unhex(F.lpad(F.hex("length"), 16, "0"))))
    narrow = rows.drop("payload")
    # Partial maxima on the map side: a payload with very many copies is one row a task here.
    last = narrow.where(F.col("length") >= LEAST_REVISIT).groupBy("digest").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("copies"))
    last = last.where("copies > 1").drop("copies")
    # Only digests that occur more than once travel; AQE splits the partition of a hot one.
    known = narrow.join(last, "digest", "left")
    response = F.col("last").isNull() | F.col("last").eqNullSafe(F.col("id"))
    kind = F.when(response, F.lit("response")).otherwise(F.lit("revisit"))
    refers = F.when(~response, F.col("last"))
    block = header_block(kind, F.col("id"), F.col("url"), F.col("sha1"), F.col("length"), refers)
    known.select("id", F.when(response, F.col("digest")).alias("digest"), block.alias("header")).write.parquet(f"{path}/headers")
    once = rows.select("digest", "payload").mapInArrow(_packed, "digest binary, stored binary").groupBy("digest").agg(F.first("stored").alias("stored"))
    once.write.parquet(f"{path}/payloads")


def _checked(key: bytes, stored: bytes) -> bytes:
    """The payload, checked against its digest."""
    payload = zstandard.ZstdDecompressor().decompress(stored)
    if hashlib.sha256(payload).digest() + hashlib.sha1(payload).digest() + len(payload).to_bytes(8, "big") != key:
        raise ValueError(f"payload {key.hex()} does not have the bytes of its digest")
    return payload


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [_checked(k.as_py(), s.as_py()) for k, s in zip(*batch.columns, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["digest", "payload"])


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """``digest`` and ``payload`` of everything stored, each checked against its digest."""
    return spark.read.parquet(f"{path}/payloads").mapInArrow(_unpacked, "digest binary, payload binary")


def _rebuilt(columns: dict[str, pa.DataType], describe):
    """(id, header, digest, stored) -> the id and what ``describe`` gives of each record's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for header, key, stored in zip(*(batch.column(k) for k in (1, 2, 3)), strict=True):
                body = _checked(key.as_py(), stored.as_py()) if key.is_valid else b""
                out.append(describe(header.as_py().encode() + body + b"\r\n\r\n"))
            cols = list(zip(*out, strict=True)) or [[] for _ in columns]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, columns.values(), strict=True))], ["id", *columns])

    return run


def _joined(spark: SparkSession, path: str) -> DataFrame:
    """Headers with the stored payloads of responses. Revisits have no digest and meet none, so a payload of very many copies is joined once."""
    headers = spark.read.parquet(f"{path}/headers")
    return headers.join(spark.read.parquet(f"{path}/payloads"), "digest", "left").select("id", "header", "digest", "stored")


def records(spark: SparkSession, path: str) -> DataFrame:
    """``id`` and ``record``: each record's bytes in a WARC file, header, payload (not of a revisit) and two line ends."""
    joined = _joined(spark, path)
    kind = joined.schema["id"].dataType.simpleString()
    return joined.mapInArrow(_rebuilt({"record": pa.binary()}, lambda r: (r,)), f"id {kind}, record binary")


def parse(record: bytes) -> dict:
    """Header fields and payload of one record's bytes."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"fields": fields, "http": http.decode(), "payload": payload, "tail": rest[len(block) :]}


FACTS = {"record_type": pa.string(), "record_uri": pa.string(), "refers_uri": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string()}


def facts(record: bytes) -> tuple:
    """What FACTS names, of the payload in the record, or of the one that a revisit declares."""
    got = parse(record)
    fields, payload = got["fields"], got["payload"]
    length, digest = int(re.search(r"(?m)^Content-Length: (\d+)", got["http"])[1]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (length, digest) != (len(payload), hashlib.sha1(payload).hexdigest()):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not have the payload that its header declares")
    return fields["WARC-Type"], fields["WARC-Record-ID"], fields.get("WARC-Refers-To"), length, digest


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write ``pages`` to the shared folder, read the archive back and describe each record, from its own bytes."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write(pages, path, id_col, url_col, payload_col)
    joined = _joined(spark, path)
    kind = joined.schema["id"].dataType.simpleString()
    schema = f"id {kind}, record_type string, record_uri string, refers_uri string, payload_bytes long, payload_digest string"
    got = materialize(joined.mapInArrow(_rebuilt(FACTS, facts), schema), "records")
    delete(spark, path)
    # A revisit names the record that it refers to.
    named = got.where("record_type = 'response'").select(F.col("record_uri").alias("refers_uri"), F.col("id").alias("refers_to")).distinct()
    alone = got.where("refers_uri is null").withColumn("refers_to", F.lit(None).cast(kind))
    every = alone.unionByName(got.where("refers_uri is not null").join(named, "refers_uri", "left"))
    return every.select(F.col("id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to", "record_uri")


#: DuckDB SQL of op1's result.
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS last, md5('record:' || page_id) AS m FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < {LEAST_REVISIT} OR last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes < {LEAST_REVISIT} OR last = page_id THEN NULL ELSE last END AS refers_to,
       '<urn:uuid:' || m[1:8] || '-' || m[9:12] || '-' || m[13:16] || '-' || m[17:20] || '-' || m[21:32] || '>' AS record_uri
FROM g
"""
