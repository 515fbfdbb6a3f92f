"""Token counts: each distinct pre-token is encoded once and joined to the documents' pre-token frequencies.

Pre-tokens that are frequent in a sample of the documents are encoded first; that table has a fixed
bound, so it is joined where the documents are read. For all other pre-tokens a task turns its documents
into an inverted list: per distinct pre-token the documents that hold it and how often, one row per block of
documents. The rows are brought together and sorted by pre-token; each distinct one is encoded once, its
count meets the frequencies of its rows as they stream by, and frequency times count is summed by document.
No token ids are kept. The sample only decides which way a pre-token goes: a pre-token that a large part of
the documents holds is in it, so none is one task's, and what is shuffled is the rare rest.
"""

from __future__ import annotations

import os
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY, OVER = "byte_bpe_50k.json", 1024
#: (document, pre-token) entries and documents in a block: what a task holds before it hands its lists on.
BLOCK_ENTRIES, BLOCK_DOCS = 4_000_000, 1 << 15
#: Blocks whose sums a task holds at a time.
BLOCKS_HELD = 64
#: Documents (expected) whose pre-tokens are counted to find the frequent ones, how many of those are taken, and their longest.
SAMPLE_DOCS, FREQUENT, FREQUENT_CHARS = 20_000, 100_000, 32

# The vocabulary's special token and its pre-token pattern.
SPECIAL = "<|endoftext|>"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Letters, numbers and white space among the first 256 characters.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\\t-\\r \x85\xa0"
_ANY = regex.compile(PATTERN)
_LATIN = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pre_tokens(text: str | None) -> Counter:
    """Pre-tokens of a whole text with their counts; the special token's string is one of its own."""
    parts = (text or "").split(SPECIAL)
    out: Counter = Counter()
    for part in parts:
        try:
            part.encode("latin-1")
            out.update(_LATIN.findall(part))
        except UnicodeEncodeError:
            out.update(_ANY.findall(part))
    if len(parts) > 1:
        out[SPECIAL] = len(parts) - 1
    return out


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Short pre-tokens with the number of sampled documents that hold them."""
    held: Counter = Counter()
    for batch in batches:
        for text in batch.column(0):
            held.update(w for w in pre_tokens(text.as_py()) if len(w) <= FREQUENT_CHARS)
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["piece", "docs"])


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(e) for e in _tokenizer(path).encode_batch_fast(batch.column(0).to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["piece", "n"])

    return run


def frequent_pieces(docs: DataFrame, path: str, sample_docs: int = SAMPLE_DOCS, most: int = FREQUENT) -> dict[str, int]:
    """Token counts of at most ``most`` pre-tokens of at most 32 characters, those most documents of a sample hold.

    The table is at most a few MiB, whatever the documents are.
    """
    n = docs.count()
    if not n:
        return {}
    sample = docs.select("text").sample(min(1.0, sample_docs / n), seed=1)
    seen = sample.mapInArrow(_seen, "piece string, docs long").groupBy("piece").agg(F.sum("docs").alias("docs")).filter("docs > 1")
    top = seen.orderBy(F.desc("docs"), "piece").limit(most).select("piece")
    return {r["piece"]: r["n"] for r in top.mapInArrow(_encoded(path), "piece string, n long").collect()}


def _lists(known: dict[str, int]):
    """Rows of two kinds: per document its id, size and known tokens, and per other pre-token its list in the block.

    A list is packed: two bytes for the document's place in the block and one for the frequency; a
    larger frequency is several entries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _blocks(batches, known)

    return run


def _blocks(batches: Iterator[pa.RecordBatch], known: dict[str, int]) -> Iterator[pa.RecordBatch]:
    base, block = TaskContext.get().partitionId() << 32, 0
    lists: dict[str, tuple[array, bytearray]] = {}
    ids, sizes, tokens, n, entries = [], [], [], 0, 0

    def flush():
        nonlocal lists, ids, sizes, tokens, n, entries, block
        block += 1
        id_column = pa.concat_arrays(ids)
        yield _rows(base + block, n, id_column.type, doc=pa.array(range(n), pa.int32()), doc_id=id_column, n_bytes=pa.concat_arrays(sizes), known=pa.array(tokens, pa.int64()))
        names = list(lists)
        for at in range(0, len(names), 20_000):
            own = names[at : at + 20_000]
            docs, counts = pa.array([lists[w][0].tobytes() for w in own], pa.binary()), pa.array([bytes(lists[w][1]) for w in own], pa.binary())
            yield _rows(base + block, len(own), id_column.type, piece=pa.array(own, pa.string()), docs=docs, counts=counts)
        lists, ids, sizes, tokens, n, entries = {}, [], [], [], 0, 0

    for batch in batches:
        texts, start = batch.column("text"), 0
        for k in range(len(texts)):
            total = 0
            for piece, count in pre_tokens(texts[k].as_py()).items():
                size = known.get(piece)
                if size is not None:
                    total += size * count
                    continue
                at = lists.get(piece)
                if at is None:
                    at = lists[piece] = (array("H"), bytearray())
                while count > 0:
                    at[0].append(n)
                    at[1].append(min(count, 255))
                    count -= 255
                    entries += 1
            tokens.append(total)
            n += 1
            full = entries >= BLOCK_ENTRIES or n == BLOCK_DOCS
            if full or k == len(texts) - 1:
                ids.append(batch.column("doc_id").slice(start, k + 1 - start))
                sizes.append(batch.column("n_bytes").slice(start, k + 1 - start))
                start = k + 1
            if full:
                yield from flush()
    if n:
        yield from flush()


_COLUMNS = {"doc": pa.int32(), "doc_id": None, "n_bytes": pa.int64(), "known": pa.int64(), "piece": pa.string(), "docs": pa.binary(), "counts": pa.binary()}


def _rows(block: int, n: int, id_type: pa.DataType, **columns) -> pa.RecordBatch:
    """Rows of one block; columns that are not given are null."""
    out = [pa.array(np.full(n, block, dtype=np.int64))]
    out += [columns[c] if c in columns else pa.nulls(n, kind or id_type) for c, kind in _COLUMNS.items()]
    return pa.RecordBatch.from_arrays(out, names=["block", *_COLUMNS])


def _packed(sums: np.ndarray) -> bytes:
    """Positive numbers in the fewest bytes each that hold the largest."""
    return sums.astype(np.min_scalar_type(int(sums.max()))).tobytes()


def _unpacked(column: pa.Array, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def _joined(path: str):
    """Frequency times count summed by document, from list rows sorted by pre-token; rows of documents pass.

    Sums are kept for a bounded number of blocks and handed on packed, one row per block. With more blocks
    than that they are handed on earlier, less added up, and take no more bytes than the lists did.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n_last, id_type = None, 0, None
        slots: dict[int, int] = {}
        sums = np.zeros((BLOCKS_HELD, BLOCK_DOCS), dtype=np.int64)

        def flush():
            for block, slot in slots.items():
                found = np.flatnonzero(sums[slot])
                if not len(found):
                    continue
                yield _rows(block, 1, id_type, docs=pa.array([found.astype(np.uint16).tobytes()], pa.binary()), counts=pa.array([_packed(sums[slot, found])], pa.binary()))
                sums[slot] = 0
            slots.clear()

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            of_document = pc.is_null(batch.column("piece"))
            if len(documents := batch.filter(of_document)):
                yield documents
            own = batch.filter(pc.invert(of_document))
            pieces = own.column("piece").to_pylist()
            fresh = [w for w, before in zip(pieces, [last, *pieces]) if w != before]
            sizes = iter([len(e) for e in _tokenizer(path).encode_batch_fast(fresh, add_special_tokens=False)] if fresh else ())
            n = np.empty(len(pieces), dtype=np.int64)
            for k, w in enumerate(pieces):
                if w != last:
                    last, n_last = w, next(sizes)
                n[k] = n_last
            blocks, place = np.unique(own.column("block").to_numpy(), return_inverse=True)
            each = pc.binary_length(own.column("counts")).to_numpy(zero_copy_only=False)
            doc = _unpacked(own.column("docs"), np.uint16).astype(np.int64)
            tokens = _unpacked(own.column("counts"), np.uint8) * np.repeat(n, each)
            of_block = np.repeat(place, each)
            for at in range(0, len(blocks), BLOCKS_HELD):
                some = blocks[at : at + BLOCKS_HELD].tolist()
                if len(slots) + sum(b not in slots for b in some) > BLOCKS_HELD:
                    yield from flush()
                slot = np.array([slots.setdefault(b, len(slots)) for b in some], dtype=np.int64)
                here = (of_block >= at) & (of_block < at + len(some))
                np.add.at(sums.reshape(-1), slot[of_block[here] - at] * BLOCK_DOCS + doc[here], tokens[here])
        if slots:
            yield from flush()

    return run


def _collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their token counts, from rows sorted by block; one block's documents and sums are held."""
    now, documents, sums = None, [], np.zeros(BLOCK_DOCS, dtype=np.int64)

    def ended() -> pa.RecordBatch:
        table = pa.Table.from_batches(documents).combine_chunks()
        total = sums[table.column("doc").to_numpy()] + table.column("known").to_numpy()
        return pa.RecordBatch.from_arrays(
            [*(pa.concat_arrays(table.column(c).chunks) for c in ("doc_id", "n_bytes")), pa.array(total)], names=["doc_id", "n_bytes", "n_tokens"])

    for batch in batches:
        block = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1), len(block)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if documents and block[a] != now:
                yield ended()
                documents = []
                sums[:] = 0
            now, part = block[a], batch.slice(a, b - a)
            of_document = pc.is_valid(part.column("doc"))
            # a copy, so that the batch of sums it came with can go
            documents.append(part.filter(of_document))
            for docs, counts in zip(*(part.filter(pc.invert(of_document)).column(c).to_pylist() for c in ("docs", "counts"))):
                place = np.frombuffer(docs, np.uint16)
                sums[place] += np.frombuffer(counts, f"u{len(counts) // len(place)}")
    if documents:
        yield ended()


def token_counts(docs: DataFrame, path: str | None = None, over: int = OVER) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    Null and empty texts have no bytes and no tokens. Repeated rows are each counted; a null doc_id
    is kept. No rows: no rows. Other columns are ignored.
    """
    own = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"block long, doc int, doc_id {kind}, n_bytes long, known long, piece string, docs binary, counts binary"
    path = path or vocabulary_path()
    lists = own.mapInArrow(_lists(frequent_pieces(docs, path)), schema)
    # lists are dealt by pre-token, rows of documents by their place
    key = F.when(F.col("piece").isNotNull(), F.xxhash64("piece")).otherwise(F.xxhash64("block", "doc"))
    sums = lists.repartition(key).sortWithinPartitions("piece").mapInArrow(_joined(path), schema)
    by_block = sums.drop("piece").repartition("block").sortWithinPartitions("block")
    out = by_block.mapInArrow(_collected, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > over).alias("over_limit"))
