"""Labelled texts to fit a classifier on: a first block, and all others in parts that are trained side by side.

A network is trained on the first block by one task, in several passes. It then starts the parts, which read
all other labelled texts once, a task each and a few texts at a time. What the parts changed is averaged, each
row of a table by how many texts of a part use it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranklens.llm.common import drop, fold, stage

#: Labelled rows of the first block, and the longest text in it (characters): one task holds it in memory.
TRAIN_ROWS, TRAIN_CHARS = 6_000, 50_000
#: Texts of a part, unless there were more than MAX_PARTS parts.
PART_ROWS, MAX_PARTS = 12_000, 256
#: Texts and characters that a part encodes at a time (at least one text).
CHUNK_ROWS, CHUNK_CHARS = 256, 2_000_000
#: Runs of a table that are averaged on their own.
SLICES = 64
#: Share of the learning rate that the last texts of a part still have.
LAST_RATE = 0.1


def known_labels(labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """(doc_id, y) outside the held-out fold; ids without label or with two different ones are left out."""
    own = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull())
    own = own.filter(fold(F.col("doc_id"), folds) != held_out)
    return own.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).filter(F.col("y") == F.col("other")).select("doc_id", "y")


def training_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> DataFrame:
    """(doc_id, text, y): the first block, at most ``rows`` labelled texts, chosen by a hash of doc_id.

    Rows without id, label or text are left out; an id with two different labels is left out; of
    repeated documents one is used. Texts over ``chars`` characters are not in the block. Only
    labels of texts that can be used count towards ``rows``. The chosen ids are at most ``rows``, so
    they are broadcast to the scan of the texts.
    """
    usable = F.col("text").isNotNull() & (F.length("text") <= chars)
    own = known_labels(labels, label, folds, held_out).join(docs.filter(usable).select("doc_id"), "doc_id", "left_semi")
    return _block(docs.filter(usable), own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))


def _block(docs: DataFrame, ids: DataFrame) -> DataFrame:
    found = docs.select("doc_id", "text").join(F.broadcast(ids.select("doc_id", "y")), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))


@dataclass
class Training:
    """All labelled texts of a fit: ``first`` and ``rest``, each (doc_id, text, y), None if it has no texts."""

    first: DataFrame | None
    rest: DataFrame | None
    #: Parts of ``rest``, its texts, and how many of all texts have label 1.
    parts: int
    rest_rows: int
    share: float
    ids: DataFrame

    def done(self) -> None:
        drop(self.ids)


def training_texts(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int = TRAIN_ROWS, least: int = 1) -> Training | None:
    """Every labelled text outside the held-out fold; None with fewer than ``least`` of a class.

    The first block is ``training_sample``; a block with too few texts of a class to train on joins the rest.
    The rest is dealt by doc_id to ``parts`` partitions, in the order of a hash within each.
    """
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    short = F.length("text") <= TRAIN_CHARS
    there = texts.groupBy("doc_id").agg(F.max(short).alias("short"))
    ids = stage(known_labels(labels, label, folds, held_out).join(there, "doc_id"), f"labelled-{label}")
    count = lambda df: df.agg(F.count("*"), F.coalesce(F.sum((F.col("y") == 1).cast("long")), F.lit(0))).first()
    n, ones = count(ids)
    if min(ones, n - ones) < least:
        drop(ids)
        return None
    chosen = ids.filter("short").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    n_first, ones_first = count(chosen)
    whole = min(ones_first, n_first - ones_first) >= least
    rest_rows = n - n_first if whole else n
    parts = min(MAX_PARTS, -(-rest_rows // PART_ROWS))
    rest = None
    if rest_rows:
        left = ids.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti") if whole else ids
        # texts and labels meet in one grouping: a join would deal both to as many partitions as any shuffle has
        mine = texts.filter(fold(F.col("doc_id"), folds) != held_out).withColumn("y", F.lit(None).cast("int"))
        both = mine.unionByName(left.select("doc_id", F.lit(None).cast("string").alias("text"), "y")).repartition(parts, "doc_id")
        found = both.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
        rest = found.filter(F.col("text").isNotNull() & F.col("y").isNotNull()).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    first = _block(docs.filter(F.col("text").isNotNull() & short), chosen) if whole else None
    return Training(first, rest, parts, rest_rows, ones / n, ids)


def in_order() -> tuple[Column, Column]:
    """The order in which a first block is trained on."""
    name = F.col("doc_id").cast("string")
    return F.crc32(name.cast("binary")), name


def texts_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int]]:
    """Text and label of each row, one at a time."""
    for b in batches:
        for text, label in zip(b.column("text"), b.column("y")):
            yield text.as_py(), label.as_py()


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[int]]]:
    """Texts and labels, a bounded number and size at a time."""
    texts, y, size = [], [], 0
    for text, label in texts_of(batches):
        texts.append(text)
        y.append(label)
        size += len(text)
        if len(texts) >= CHUNK_ROWS or size >= CHUNK_CHARS:
            yield texts, y
            texts, y, size = [], [], 0
    if texts:
        yield texts, y


def rate_of(done: int, expected: float) -> float:
    """Share of the learning rate after ``done`` texts of a part that has about ``expected``."""
    return max(LAST_RATE, 1 - done / max(1.0, expected))


_ROWS = "slice int, part int, weight binary, change binary"

#: What a part returns: uses and change of each row of the table, texts, change of the dense values, counts.
Changed = tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]


def train_parts(data: Training, step: Callable[[Iterator[tuple[list[str], list[int]]]], Changed]) -> Changed:
    """Runs ``step`` on every part and averages on Spark; counts are added up.

    The driver receives one table, however many parts there are. Parts are added in their order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uses, change, n, dense, counts = step(chunks(batches))
        if not n:
            return
        part = TaskContext.get().partitionId()
        out = [(k, u, c) for k, (u, c) in enumerate(zip(np.array_split(uses, SLICES), np.array_split(change, SLICES)))]
        out += [(SLICES, np.array([n]), dense[None]), (SLICES + 1, np.zeros(0), counts)]
        for k, u, c in out:
            cols = [pa.array([k], pa.int32()), pa.array([part], pa.int32()), pa.array([u.astype("i4").tobytes()]), pa.array([c.astype("f4" if k <= SLICES else "f8").tobytes()])]
            yield pa.RecordBatch.from_arrays(cols, names=["slice", "part", "weight", "change"])

    def merge(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["part"])
        k, weight, total = rows[0]["slice"], 0, 0
        for r in rows:
            own = np.frombuffer(r["weight"], "i4").astype("f8")
            weight = weight + own
            values = np.frombuffer(r["change"], "f4" if k <= SLICES else "f8").astype("f8")
            total = total + (own[:, None] * values.reshape(len(own), -1) if k <= SLICES else values)
        if k <= SLICES:
            total = total / np.maximum(weight, 1)[:, None]
        return pa.table({"slice": pa.array([k], pa.int32()), "part": pa.array([0], pa.int32()), "weight": [weight.astype("i8").tobytes()], "change": [total.astype("f4" if k <= SLICES else "f8").tobytes()]})

    found = data.rest.mapInArrow(run, _ROWS).groupBy("slice").applyInArrow(merge, _ROWS).collect()
    rows = {r["slice"]: (np.frombuffer(bytes(r["weight"]), "i8"), np.frombuffer(bytes(r["change"]), "f4" if r["slice"] <= SLICES else "f8")) for r in found}
    uses = np.concatenate([rows[k][0] for k in range(SLICES)])
    change = np.concatenate([rows[k][1] for k in range(SLICES)]).reshape(len(uses), -1)
    return uses, change, int(rows[SLICES][0][0]), rows[SLICES][1], rows[SLICES + 1][1]
