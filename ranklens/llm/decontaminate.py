"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of 13 consecutive words of the benchmark items; an item with fewer
words is one shorter pattern. Patterns of one length share a shift table over blocks of two words:
a block that ends no pattern tells how many positions can be skipped. Where the shift is zero, the
block's bucket holds the windows that end in it; their first word and then all words are compared.

The windows are cut and freed of repeats by Spark and kept as a table, and the documents are searched for a
bounded number of them at a time, dealt by hash. An item of any length is many windows like any other, and
the driver holds the windows of one search only.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklens.llm.common import free_name, stage

WINDOW, BLOCK = 13, 2
#: Windows searched for in one pass; a larger benchmark takes several passes over the documents.
PASS_WINDOWS = 500_000
STATE = "struct<n_words:bigint,spans:array<bigint>,items:array<string>>"
#: A-Z become a-z; every other ASCII byte that is no digit or letter parts words.
_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c > 0x7F or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_BYTES).split()


def windows_of(words: list[bytes]) -> Iterator[tuple[bytes, ...]]:
    """Windows of an item: each 13 consecutive words, or all of fewer."""
    if len(words) < WINDOW:
        if words:
            yield tuple(words)
        return
    for i in range(len(words) - WINDOW + 1):
        yield tuple(words[i : i + WINDOW])


class WuManber:
    """Shift table and suffix buckets for patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], set[str]]):
        self.length = length
        self.block = min(BLOCK, length)
        self.default = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], list] = defaultdict(list)
        for words, items in patterns.items():
            for end in range(self.block, length + 1):
                block = words[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.default), length - end)
            self.buckets[words[-self.block :]].append((words[0], list(words), sorted(items)))

    def scan(self, words: list[bytes], spans: list[tuple[int, int]], found: set[str]) -> None:
        """Adds the (start, end) of each occurrence and the items it belongs to."""
        last, n, shift, default = self.length - 1, len(words), self.shift, self.default
        i = last
        while i < n:
            block = (words[i - 1], words[i]) if self.block == 2 else (words[i],)
            step = shift.get(block, default)
            if step:
                i += step
                continue
            start = i - last
            for first, pattern, items in self.buckets[block]:
                if words[start] == first and words[start : i + 1] == pattern:
                    spans.append((start, i + 1))
                    found.update(items)
            i += 1


def tables_of(windows: list[tuple[bytes, list[str]]]) -> list[WuManber]:
    """Tables for windows (words joined by spaces, items that have them), one for each length."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(dict)
    for joined, items in windows:
        words = tuple(joined.split())
        by_length[len(words)][words] = set(items)
    return [WuManber(n, p) for n, p in sorted(by_length.items())]


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """Flat list start, end, start, end, ... of the union of spans."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _search(tables: list[WuManber]):
    def run(texts: pa.Array, states: pa.Array) -> pa.Array:
        out = []
        for text, before in zip(texts, states):
            words, old = words_of(text.as_py()), before.as_py()
            spans = list(zip(old["spans"][::2], old["spans"][1::2])) if old else []
            found = set(old["items"]) if old else set()
            for t in tables:
                t.scan(words, spans, found)
            out.append({"n_words": len(words), "spans": merged(spans), "items": sorted(found)})
        kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
        return pa.array(out, type=kind)

    return F.arrow_udf(run, STATE)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(*(c.to_pylist() for c in batch.columns)):
            held: list[bytes] = []
            for w in windows_of(words_of(text)):
                held.append(b" ".join(w))
                if len(held) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), pa.array([item] * len(held), pa.string())], names=["words", "item"])
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), pa.array([item] * len(held), pa.string())], names=["words", "item"])


def windows(benchmark: DataFrame) -> DataFrame:
    """(words, items): every distinct window of a benchmark with the items that have it, null ids left out."""
    cut = benchmark.select(F.col("item_id").cast("string"), "text").mapInArrow(_cut, "words binary, item string")
    return cut.groupBy("words").agg(F.collect_set("item").alias("items"))


def _passes(benchmark: DataFrame, most: int) -> Iterator[list[tuple[bytes, list[str]]]]:
    """The windows in parts of about ``most``, one part in the driver at a time."""
    table = stage(windows(benchmark), "windows")
    parts = max(1, -(-table.count() // most))
    for k in range(parts):
        part = table.filter(F.pmod(F.xxhash64("words"), F.lit(parts)) == k)
        yield [(bytes(r["words"]), r["items"]) for r in part.collect()]


def find_passages(docs: DataFrame, benchmark: DataFrame, pass_windows: int = PASS_WINDOWS) -> tuple[DataFrame, str]:
    """Documents with one more column (its name is returned): n_words, word spans hit, items found.

    Null texts have no words. Repeated rows are each searched; a null item_id marks words but is not
    listed. With an empty benchmark nothing is found.
    """
    name = free_name(docs, "passages")
    out = docs.withColumn(name, F.lit(None).cast(STATE))
    for k, part in enumerate(_passes(benchmark, pass_windows)):
        if k:
            out = stage(out, "searched")
        out = out.withColumn(name, _search(tables_of(part))(F.col("text"), F.col(name)))
    return out, name


def _hit(name: str):
    at = F.sequence(F.lit(0), F.size(F.col(f"{name}.spans")) - 2, F.lit(2))
    spans = F.when(F.size(F.col(f"{name}.spans")) > 0, F.transform(at, lambda i: F.col(f"{name}.spans")[i + 1] - F.col(f"{name}.spans")[i]))
    return F.coalesce(F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))


def _contaminated(name: str):
    return (_hit(name) > 0) & (20 * _hit(name) >= F.col(f"{name}.n_words"))


def overlap(docs: DataFrame, benchmark: DataFrame, pass_windows: int = PASS_WINDOWS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and are not contaminated. Repeated rows each give a row; a null
    doc_id is kept. An item without words has no window; repeated items are one; a null item_id marks words
    but is not listed. Empty tables: no rows, or nothing hit. Other columns are ignored.
    """
    found, name = find_passages(docs.select("doc_id", "text"), benchmark, pass_windows)
    items = F.col(f"{name}.items")
    return found.select(
        "doc_id", F.col(f"{name}.n_words").alias("n_words"), _hit(name).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        _contaminated(name).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, pass_windows: int = PASS_WINDOWS) -> DataFrame:
    """Documents that are not contaminated, with their columns as they came."""
    found, name = find_passages(docs, benchmark, pass_windows)
    return found.filter(~_contaminated(name)).select(*docs.columns)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH items AS (
  SELECT item_id, {_WORDS} AS words FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(13, len(words)) AS n, array_to_string(words[i : i + least(13, len(words)) - 1], ' ') AS w
  FROM items, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS x(i) WHERE len(words) > 0
), docs AS (
  SELECT doc_id, {_WORDS} AS words FROM documents
), places AS (
  SELECT doc_id, n, i, array_to_string(words[i : i + n - 1], ' ') AS w
  FROM docs, (SELECT DISTINCT n FROM windows), unnest(range(1, len(words) - n + 2)) AS x(i) WHERE len(words) >= n
), found AS (
  SELECT doc_id, item_id, i, n FROM places JOIN windows USING (n, w)
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN listed USING (doc_id)
"""
