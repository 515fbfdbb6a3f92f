"""WARC archives as a chunked record table.

A payload over ``CHUNK_BYTES`` is written as a row per chunk: a first segment and continuation records
that carry the record's identifier and the chunk number. A row per chunk number comes first and cuts its
own bytes out of the payload, so the pieces never stand side by side. Archives are gzip files of records in
WARC 1.1 form, written by Spark's own writer, so that lost tasks leave nothing behind and any store that
Spark writes to will do. A file holds ``FILE_BYTES`` before compression at most (but for long URLs), because
a record holds one chunk; that bounds what a reading task has of it. Reading decompresses an archive piece
by piece; payloads that came in chunks are put through a running digest one chunk at a time, never joined.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklens.llm.common import stage
from ranklens.session import scratch_path

CHUNK_BYTES, FILE_BYTES = 1 << 16, 1 << 26
#: Bytes that a record's header takes, without its URL.
HEADER_BYTES = 1 << 10
#: Equal payloads shorter than this are each stored.
REVISIT_BYTES = 100
READ_BYTES = 1 << 16
CRLF = "\r\n"


def _line(name: str, value):
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\r\n]+", "%0A"), F.lit(CRLF))).otherwise("")


def chunked(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows (page_id, url, row, digest, total, chunks, chunk, data): the record table of whole payloads.

    ``data`` is binary; chunks are cut by bytes, also inside a character.
    """
    html = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    own = pages.select("page_id", "url", html.alias("payload"), F.monotonically_increasing_id().alias("row"))
    own = own.select("page_id", "url", "row", "payload", F.unhex(F.sha2("payload", 256)).alias("digest"), F.octet_length("payload").cast("long").alias("total"))
    chunks = F.greatest(F.lit(1), F.ceil(F.col("total") / chunk_bytes).cast("int"))
    rows = own.withColumn("chunks", chunks).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    data = F.when(F.col("chunks") == 1, F.col("payload")).otherwise(F.substring("payload", F.col("chunk") * chunk_bytes + 1, F.lit(chunk_bytes)))
    return rows.select("page_id", "url", "row", "digest", "total", "chunks", "chunk", data.alias("data"))


def file_records(chunk_bytes: int, file_bytes: int) -> int:
    """Records in an archive file, so that none is over ``file_bytes`` before compression."""
    return max(1, file_bytes // (chunk_bytes + HEADER_BYTES))


def write_archives(pages: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Writes a record per page below ``path``.

    Of equal payloads of at least 100 bytes the page with the smallest page_id is stored as response
    (so are rows that repeat its id) and the others as revisit records without payload. Which digests
    repeat is written to a table first; while that is small it reaches the pages without moving them,
    and otherwise by a join that can split a digest with many pages.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    long_ = pages.filter(F.octet_length(html) >= REVISIT_BYTES).select("page_id", F.unhex(F.sha2(html, 256)).alias("digest"))
    first = long_.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = stage(first.filter((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "first"), "repeated")
    rows = chunked(pages, chunk_bytes).join(first, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("first"), F.lit(False))
    kind = F.when(revisit, "revisit").when(F.col("chunk") > 0, "continuation").otherwise("response")
    rows = rows.withColumn("kind", kind).filter(~(revisit & (F.col("chunk") > 0)))
    in_parts = (F.col("chunks") > 1) & ~revisit
    data = F.when(revisit, F.lit("")).otherwise(F.col("data").cast("string"))  # bytes as they are
    record_id = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), _line("WARC-Type", F.col("kind")), _line("WARC-Record-ID", record_id),
        _line("WARC-Date", F.lit("1970-01-01T00:00:00Z")), _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.lower(F.hex("digest")))),
        _line("WARC-Page-Row", F.col("row")), _line("WARC-Payload-Length", F.col("total")),
        _line("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">")))),
        _line("WARC-Segment-Number", F.when(in_parts, F.col("chunk") + 1)),
        _line("WARC-Segment-Origin-ID", F.when(in_parts & (F.col("chunk") > 0), record_id)),
        _line("WARC-Segment-Total-Length", F.when(in_parts & (F.col("chunk") + 1 == F.col("chunks")), F.col("total"))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")), _line("Content-Length", F.octet_length(data)),
        F.lit(CRLF), data, F.lit(CRLF),
    )
    out = rows.select(record.alias("value"))
    out.write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("lineSep", CRLF).option("maxRecordsPerFile", file_records(chunk_bytes, file_bytes)).text(path)


class _Stream:
    """Bytes of a gzip file, decompressed as they are asked for."""

    def __init__(self, data: bytes):
        self.data, self.at, self.inflate, self.ready = memoryview(data), 0, zlib.decompressobj(31), bytearray()

    def more(self) -> bool:
        """Adds at most READ_BYTES to what is ready; False at the end."""
        if self.inflate.eof:
            self.at -= len(self.inflate.unused_data)
            self.inflate = zlib.decompressobj(31)
        piece = self.inflate.unconsumed_tail
        if not piece:
            piece = self.data[self.at : self.at + READ_BYTES]
            self.at += len(piece)
        out = self.inflate.decompress(piece, READ_BYTES)
        self.ready += out
        return bool(len(piece) or out)

    def head(self) -> bytes | None:
        """The next header block, or nothing at the end."""
        end = -1
        while (end := self.ready.find(b"\r\n\r\n")) < 0:
            if not self.more():
                return None
        out = bytes(self.ready[:end])
        del self.ready[: end + 4]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces."""
        while n:
            if not self.ready and not self.more():
                raise EOFError("a record is cut off")
            take = min(n, len(self.ready))
            if take:
                yield bytes(self.ready[:take])
                del self.ready[:take]
                n -= take


def records(data: bytes) -> Iterator[dict]:
    """Records of one archive; payloads in one piece are digested as they pass, segments are handed on."""
    stream = _Stream(data)
    while (head := stream.head()) is not None:
        fields = dict(line.split(": ", 1) for line in head.decode().lstrip().split(CRLF)[1:])
        page = re.fullmatch(r"<urn:page:(-?\d+)>", fields["WARC-Record-ID"])
        refers = re.fullmatch(r"<urn:page:(-?\d+)>", fields.get("WARC-Refers-To", ""))
        segment = int(fields.get("WARC-Segment-Number", 0))
        digest, kept = hashlib.sha256(), []
        for piece in stream.pieces(int(fields["Content-Length"])):
            digest.update(piece)
            if segment:
                kept.append(piece)
        for _ in stream.pieces(4):
            pass
        kind, whole = fields["WARC-Type"], fields["WARC-Type"] == "revisit"
        yield {
            "page_id": int(page[1]) if page else None, "row": int(fields["WARC-Page-Row"]), "segment": segment,
            "payload_bytes": int(fields["WARC-Payload-Length"] if whole else fields["Content-Length"]),
            "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:") if whole else digest.hexdigest(),
            "record_type": "response" if kind == "continuation" else kind, "refers_to": int(refers[1]) if refers else None,
            "data": b"".join(kept) if segment else None,
        }


_ROW = pa.schema([("page_id", pa.int64()), ("row", pa.int64()), ("segment", pa.int32()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("data", pa.binary())])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            held, size = [], 0
            for r in records(content.as_py()):
                held.append(r)
                size += len(r["data"] or b"")
                if len(held) >= 4096 or size > 1 << 24:
                    yield pa.RecordBatch.from_pylist(held, schema=_ROW)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=_ROW)


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order of record and number, each with the length and digest of its payload so far."""
    row, digest, length = None, None, 0
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["row"] != row:
                row, digest, length = r["row"], hashlib.sha256(), 0
            digest.update(r.pop("data"))
            length += r["payload_bytes"]
            out.append(r | {"payload_bytes": length, "payload_digest": digest.copy().hexdigest(), "data": None})
        yield pa.RecordBatch.from_pylist(out, schema=_ROW)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Rows read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Lengths and digests of stored payloads are taken from the bytes read, those of revisits from
    their headers.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    parsed = stage(files.mapInArrow(_parse, "page_id long, row long, segment int, payload_bytes long, payload_digest string, record_type string, refers_to long, data binary"), "records")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    parts = parsed.filter(F.col("segment") > 0).repartition("row").sortWithinPartitions("row", "segment")
    parts = parts.mapInArrow(_running, parsed.schema)
    ended = parts.groupBy("row").agg(F.max_by(F.struct(*columns), "segment").alias("x")).select("x.*")
    return parsed.filter(F.col("segment") == 0).select(*columns).unionByName(ended.select(*columns))


def round_trip(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """One row per page, from archives written and read again.

    Null html is an empty payload, and a null url has no URI line. A null page_id is kept; it revisits
    but is not revisited. Repeated rows give repeated records. No rows: no rows. Other columns are ignored.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages.select("page_id", "url", "html"), path, chunk_bytes, file_bytes)
    return read_archives(spark, path)


ORACLE = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), q AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM q
"""
