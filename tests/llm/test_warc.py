import gzip
import hashlib

import pytest

from ranklens.llm import warc
from ranklens.session import scratch_path

SCHEMA = "page_id long, url string, html string"
LONG = "é<p>" * 1000
ROWS = [
    (1, "http://a/x", LONG), (2, "http://b/", LONG), (3, None, "short"), (4, "http://c/", "short"), (5, "u\r\nWARC-Type: x", None), (6, "v", ""),
    (7, "w", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 9), (7, "w", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 9), (9, "again", "x" * 100), (8, "first", "x" * 100), (10, "y", "z" * 99), (11, "y", "z" * 99),
    (None, "n", LONG), (None, "m", "only here " * 30), (12, "big", "0123456789\n" * 5000),
]


def _want(rows):
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    out = []
    for p, _, h in rows:
        data, low = (h or "").encode(), first.get(h or "")
        revisit = len(data) >= 100 and low is not None and p != low
        out.append((p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", low if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk,files", [(1 << 17, 4096), (64, 5), (1000, 3), (900, 40)])
def test_round_trip(spark, chunk, files):
    """Chunk size in bytes and records in a file."""
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3).selectExpr("*", "1 AS row", "'d' AS digest", "5 AS chunk", "6 AS first")
    got = warc.round_trip(df, chunk_bytes=chunk, file_bytes=files * (chunk + warc.HEADER_BYTES))
    assert sorted((tuple(r) for r in got.collect()), key=str) == _want(ROWS)


def test_chunk_rows(spark):
    rows = warc.chunked(spark.createDataFrame(ROWS, SCHEMA), 1000).collect()
    for _, url, h in ROWS:
        own = sorted((r for r in rows if r.url == url and hashlib.sha256((h or "").encode()).digest() == bytes(r.digest)), key=lambda r: (r.row, r.chunk))
        assert b"".join(bytes(r.data) for r in own if r.row == own[0].row).decode() == (h or "")
        assert all(len(r.data) <= 1000 for r in own)


def test_files_are_warc(spark, tmp_path):
    path = scratch_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(ROWS, SCHEMA).coalesce(1), path, chunk_bytes=64)
    local = path.removeprefix("file:")
    import glob

    files = glob.glob(f"{local}/*.gz")
    assert files
    data = gzip.open(files[0]).read()
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: ") and data.endswith(b"\r\n\r\n") and b"WARC-Segment-Number: 2" in data


def test_several_gzip_members_and_cut_file():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:4>\r\nWARC-Page-Row: 0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    data = gzip.compress(record) + gzip.compress(record)
    assert [r["page_id"] for r in warc.records(data)] == [4, 4]
    with pytest.raises(EOFError):
        list(warc.records(gzip.compress(record[:-6])))


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_payload_and_file_stay_within_the_stated_peak(spark):
    """A payload of many chunks, in characters of three bytes, and files far larger than a read buffer."""
    import glob
    import gzip

    import numpy as np

    big = "".join(map(chr, np.random.default_rng(1).integers(0x4E00, 0x9FA0, 700_000)))
    rows = [(k, "u", big if k == 3 else f"page {k} " * 40) for k in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    path = scratch_path(spark, "warc-large")
    warc.write_archives(df, path, chunk_bytes=1 << 14, file_bytes=1 << 20)
    sizes = [len(gzip.open(f).read()) for f in glob.glob(f"{path.removeprefix('file:')}/*.gz")]
    assert len(sizes) > 4 and max(sizes) <= 1 << 20 and max(sizes) > 8 * warc.READ_BYTES
    got = warc.read_archives(spark, path)
    assert sorted((tuple(r) for r in got.collect()), key=str) == _want(rows)
    # what a reading task holds of a file: its bytes, one buffer of decompressed ones, one segment
    stream = warc._Stream(gzip.compress(b"x" * (1 << 22)))
    most = 0
    for piece in stream.pieces(1 << 22):
        most = max(most, len(stream.ready) + len(piece))
    assert most <= 2 * warc.READ_BYTES
