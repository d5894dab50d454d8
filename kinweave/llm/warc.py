"""A content-addressed archive of WARC records.

Payload bytes are stored once, under their SHA-256, which is verified when
payloads meet and again when they are read. Exact record headers are a table of
their own; original records come back by a join of the two. Plain WARC files
can be written from the archive and read into it.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import bounded_batches, columns_only, join_per_key, scratch

#: Smaller payloads are repeated as responses rather than revisited; fixed by the query's contract.
REVISIT_FROM = 1000
#: So many records at most read one stored copy of a payload in one task.
ROWS_PER_COPY = 5000
LEVEL = 3
CRLF = "\r\n"


@dataclass
class Archive:
    """``headers``: page_id, header, digest, copy. ``payloads``: digest, copy, packed."""

    headers: DataFrame
    payloads: DataFrame


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=LEVEL)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            bodies = part.column("body").to_pylist()
            digests = [hashlib.sha256(b).digest() for b in bodies]
            if digests != part.column("digest").to_pylist():
                raise ValueError("a payload doesn't match its digest")
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("digest"), part.column("n_bytes"), pa.array([packer.compress(b) for b in bodies], pa.binary())],
                ["page_id", "digest", "n_bytes", "packed"],
            )


def header_text(record_type, page_id, refers_to, url, sha1, n_bytes):
    """A record's header up to and with its empty line, as a column. A revisit has no body."""
    uri = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    clean = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", "")
    revisit = record_type == "revisit"
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), record_type,
        F.lit(f"{CRLF}WARC-Record-ID: "), F.coalesce(uri(page_id), F.lit("<urn:page:>")),
        F.lit(f"{CRLF}WARC-Date: 1970-01-01T00:00:00Z{CRLF}WARC-Target-URI: "), clean,
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), sha1,
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Refers-To: "), uri(refers_to))).otherwise(F.lit("")),
        F.lit(f"{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.when(revisit, F.lit(0)).otherwise(n_bytes).cast("string"), F.lit(CRLF + CRLF),
    )


def write_archive(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", revisit_from: int = REVISIT_FROM
) -> Archive:
    """One record per row. Of equal payloads of at least ``revisit_from`` bytes
    the record with the largest id is the response and the others revisit it.

    The body is text, stored in UTF-8, or binary, stored as it is. A null body
    is an empty payload, of any length one is stored whole; a null id never wins
    over another; rows that share both the largest id and the payload are all
    responses, repeated rows are a record each. Extra columns aren't read; an
    empty table gives an empty archive.

    Payloads are packed once. The headers need only their digests and sizes,
    which are taken without unpacking anything.
    """
    spark = pages.sparkSession
    named = bounded_batches(columns_only(pages, id_col, url_col, body_col)).toDF("page_id", "url", "body")
    body = F.coalesce(F.col("body").cast("binary"), F.lit(b""))
    named = named.select("page_id", "url", body.alias("body")).withColumns(
        {"digest": F.unhex(F.sha2("body", 256)), "n_bytes": F.octet_length("body").cast("bigint")}
    )
    packed = named.select("page_id", "digest", "n_bytes", "body").mapInArrow(
        _pack, f"page_id {dict(named.dtypes)['page_id']}, digest binary, n_bytes bigint, packed binary"
    )
    place = scratch(spark, "warc")
    # Combined in each task first, so a task sends a payload once however often it has it.
    per_payload = packed.groupBy("digest").agg(
        F.any_value("packed").alias("packed"),
        F.max("page_id").alias("holder"),
        F.count(F.lit(1)).alias("records"),
        F.max("n_bytes").alias("size"),
        F.assert_true(F.min("n_bytes") == F.max("n_bytes"), "two payloads share a digest").alias("_same"),
    )
    per_payload.write.parquet(f"{place}/payloads")
    kept = spark.read.parquet(f"{place}/payloads")
    slim = kept.select("digest", "holder", "records")
    total = slim.agg(F.sum("records")).first()[0] or 0
    records = named.select("page_id", "url", "digest", F.sha1("body").alias("sha1"), "n_bytes")
    typed = join_per_key(records, slim, "digest", "records", total)
    revisits = (F.col("n_bytes") >= revisit_from) & ~F.col("page_id").eqNullSafe(F.col("holder"))
    record_type = F.when(revisits, F.lit("revisit")).otherwise(F.lit("response"))
    copies = F.ceil(F.col("records") / F.lit(ROWS_PER_COPY))
    headers = typed.select(
        "page_id",
        header_text(record_type, F.col("page_id"), F.col("holder"), F.col("url"), F.col("sha1"), F.col("n_bytes")).alias("header"),
        F.when(revisits, F.col("holder")).alias("refers_to"),
        "digest",
        F.pmod(F.xxhash64("page_id"), copies).cast("int").alias("copy"),
    )
    headers.write.parquet(f"{place}/headers")
    payloads = kept.select(
        "digest", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("records") / F.lit(ROWS_PER_COPY)) - 1).cast("int"))).alias("copy"), "packed"
    )
    return Archive(spark.read.parquet(f"{place}/headers"), payloads)


def reconstruct(archive: Archive) -> DataFrame:
    """``page_id, header, refers_to, digest, packed``: every record with its payload.

    A payload that many records share is joined in as many copies as its
    records need, so none of them meet in one task. Null ids and empty payloads
    come back as they were; an empty archive has no records.
    """
    return archive.headers.join(archive.payloads, ["digest", "copy"])


def _field(header: str, name: str) -> str | None:
    mark = f"{CRLF}{name}: "
    at = header.find(mark)
    return None if at < 0 else header[at + len(mark) : header.index(CRLF, at + len(mark))]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpacker = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for header, digest, packed in zip(*(batch.column(n).to_pylist() for n in ("header", "digest", "packed")), strict=True):
            body = unpacker.decompress(packed)
            sha1 = hashlib.sha1(body).hexdigest()
            if hashlib.sha256(body).digest() != digest or _field(header, "WARC-Payload-Digest") != f"sha1:{sha1}":
                raise ValueError("a stored payload doesn't match its digest")
            out.append((len(body), sha1, _field(header, "WARC-Type")))
        sizes, digests, kinds = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(kinds, pa.string()), batch.column("refers_to")],
            ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
        )


def read_records(archive: Archive) -> DataFrame:
    """Each record's figures, from its reconstructed and verified payload."""
    records = reconstruct(archive).select("page_id", "refers_to", "header", "digest", "packed")
    kind = dict(records.dtypes)["page_id"]
    schema = f"page_id {kind}, payload_bytes bigint, payload_digest string, record_type string, refers_to {kind}"
    return records.mapInArrow(_read, schema)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpacker = zstandard.ZstdDecompressor()
    for batch in batches:
        for header, packed in zip(batch.column("header").to_pylist(), batch.column("packed").to_pylist(), strict=True):
            body = b"" if "WARC-Type: revisit" in header else unpacker.decompress(packed)
            yield pa.RecordBatch.from_arrays([pa.array([header.encode() + body], pa.binary())], ["value"])


def write_warc(archive: Archive, path: str, records_per_file: int = 10_000) -> None:
    """Standard WARC files, gzipped, by Spark's own text sink: its line end is
    the two line breaks that end a record.

    The sink writes a string's bytes as they are, so payloads that aren't UTF-8
    go through unchanged. Revisits have no body; an empty archive writes no record.
    """
    records = reconstruct(archive).select("header", "packed").mapInArrow(_records, "value binary")
    options = {"lineSep": CRLF + CRLF, "compression": "gzip", "maxRecordsPerFile": records_per_file}
    records.select(F.col("value").cast("string").alias("value")).write.options(**options).text(path)


def header_fields(header: str) -> dict[str, str]:
    """A header's values by their names in lower case, with or without blanks around
    them; a line that begins with a blank goes on with the one before, and of a
    name that is there twice the first counts."""
    out, last = {}, None
    for line in header.split(CRLF)[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] = f"{out[last]} {line.strip()}"
        elif ":" in line:
            name, value = line.split(":", 1)
            last = name.strip().lower()
            out.setdefault(last, value.strip())
    return out


def parse_warc(data: bytes) -> Iterator[tuple[str, bytes]]:
    """``header, body`` of each record of a file's bytes, gzipped or not, one record at a time; gzip members are joined.

    What isn't a record is an error, never skipped: another first line, no length
    or one that isn't a number, a body that is cut off, another ending than two line breaks."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := stream.readline():
        lines = [line]
        while line not in (b"\r\n", b""):
            line = stream.readline()
            lines.append(line)
        if line == b"":
            raise ValueError("a record's header has no end")
        header = b"".join(lines).decode()
        length = header_fields(header).get("content-length", "")
        if not header.startswith("WARC/") or not (length.isascii() and length.isdigit()):
            raise ValueError(f"not a record with a Content-Length: {header[:80]!r}")
        body = stream.read(int(length))
        if len(body) != int(length):
            raise ValueError("a record is cut off")
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record's ending is missing, so its length is wrong")
        yield header, body


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content").to_pylist():
            for header, body in parse_warc(content):
                fields = header_fields(header)
                about = [pa.array([x], pa.string()) for x in (header, fields.get("warc-type"), fields.get("warc-target-uri"))]
                yield pa.RecordBatch.from_arrays([*about, pa.array([body], pa.binary())], ["header", "record_type", "url", "body"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``header, record_type, url, body`` of WARC files.

    A task holds a file as it is stored and one record of it at a time. A file
    that is cut off is an error; an empty file has no records.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_parse, "header string, record_type string, url string, body binary")
