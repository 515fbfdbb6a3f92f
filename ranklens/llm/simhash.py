"""SimHash near-dedup with a Gray-order hierarchical index over the fingerprints.

Fingerprints are cut into four bands of 16 bits. Two that differ in at most two bits agree on two
whole bands, so each fingerprint is entered under its six pairs of bands: six tables whose top nodes
are the shared bits of two bands. Inside a node the fingerprints are sorted by Gray rank; runs of
neighbours become leaves, runs of leaves become upper nodes, and each holds the bit pattern its
members share. A search carries the differences found so far downwards, adds those on the bits that
are newly shared at each node, and drops the whole group once they pass the limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklens.llm.common import free_name, stage
from ranklens.llm.components import connected_components, forest

SEED, SHINGLE, LIMIT = 42, 3, 2
BANDS = [0xFFFF << 16 * i for i in range(4)]
MASKS = [a | b for a, b in combinations(BANDS, 2)]
#: Members of a node that are compared in one task; a node with more is opened eight bits further.
NODE_ROWS = 4096
FAN = 16
STEP_BITS = 8


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of a whole text: a bit is set if over half of the shingle hashes have it."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_column(text):
    """Fingerprint of a text column as a signed long."""
    return F.arrow_udf(_udf, "long")(text)


def _udf(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(t.as_py()) for t in texts], dtype=np.uint64).view(np.int64))


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Position of a code in the Gray order."""
    rank = code.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def build_levels(node: np.ndarray, code: np.ndarray) -> list[dict]:
    """Levels of the index from the codes up; nodes are contiguous, codes in Gray order inside them.

    Each level holds, per entry, the shared pattern and its mask, and the range of its children one
    level below. The last level has one entry for each node.
    """
    levels = [{"all": code, "any": code, "node": node}]
    while True:
        below = levels[-1]
        first = np.flatnonzero(np.r_[True, below["node"][1:] != below["node"][:-1]])
        if len(first) == len(below["node"]) and len(levels) > 1:
            break
        rank = np.arange(len(below["node"])) - np.repeat(first, np.diff(np.r_[first, len(below["node"])]))
        start = np.flatnonzero(rank % FAN == 0)
        levels.append({
            "all": np.bitwise_and.reduceat(below["all"], start), "any": np.bitwise_or.reduceat(below["any"], start),
            "node": below["node"][start], "start": start, "end": np.r_[start[1:], len(rank)],
        })
    for x in levels:
        x["mask"] = ~(x["all"] ^ x["any"])
    return levels


def search(levels: list[dict], root: np.ndarray, code: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, indexed code) positions within ``limit`` bits; ``root`` is the query's top entry."""
    q, at = np.arange(len(code)), root
    top = levels[-1]
    diff = np.bitwise_count((code ^ top["all"][at]) & top["mask"][at]).astype(np.int64)
    for depth in range(len(levels) - 1, 0, -1):
        near = diff <= limit
        q, at, diff = q[near], at[near], diff[near]
        above, below = levels[depth], levels[depth - 1]
        n = above["end"][at] - above["start"][at]
        child = np.repeat(above["start"][at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        fresh = below["mask"][child] & ~np.repeat(above["mask"][at], n)
        q, diff, at = np.repeat(q, n), np.repeat(diff, n), child
        diff = diff + np.bitwise_count((code[q] ^ below["all"][at]) & fresh)
    near = diff <= limit
    return q[near], at[near]


def _links(node: np.ndarray, code: np.ndarray, home: np.ndarray, limit: int, most: int = 1 << 21):
    """Links found in whole nodes, thinned to a forest: (code, code of its group's first member)."""
    order = np.lexsort((gray_rank(code), node))
    node, code, home = node[order], code[order], home[order]
    own = np.flatnonzero(home)
    if not len(own):
        return code[:0], code[:0]
    levels = build_levels(node[own], code[own])
    roots = levels[-1]["node"]
    root = np.minimum(np.searchsorted(roots, node), len(roots) - 1)
    known = np.flatnonzero(roots[root] == node)
    size = np.bincount(np.searchsorted(roots, node[own]), minlength=len(roots))
    part = np.cumsum(size[root[known]]) // most
    a, b = [], []
    for at in np.split(known, np.flatnonzero(np.diff(part)) + 1):
        q, hit = search(levels, root[at], code[at], limit)
        q, hit = at[q], own[hit]
        new = (q < hit) | ~home[q]
        a.append(q[new])
        b.append(hit[new])
    label = forest(len(code), np.concatenate(a), np.concatenate(b))
    moved = np.flatnonzero(label != np.arange(len(label)))
    return code[moved], code[label[moved]]


def _link_task(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("node", "code", "home")}
            if rest is not None:
                now = {k: np.concatenate([rest[k], now[k]]) for k in now}
            cut = int(np.searchsorted(now["node"], now["node"][-1])) if len(now["node"]) else 0
            rest = {k: v[cut:] for k, v in now.items()}
            if cut:
                yield _found({k: v[:cut] for k, v in now.items()}, limit)
        if rest is not None and len(rest["node"]):
            yield _found(rest, limit)

    return run


def _found(x: dict, limit: int) -> pa.RecordBatch:
    a, b = _links(x["node"], x["code"].astype(np.int64).view(np.uint64), x["home"].astype(bool), limit)
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _opened(rows: DataFrame, hot: DataFrame, depth: int, limit: int) -> DataFrame:
    """Rows of crowded nodes, entered one step of bits deeper.

    A member goes to the child node of its own bits, and as a guest to those within the limit, so
    that every close pair still meets.
    """
    flips = [0] + [sum(1 << i for i in c) for n in range(1, limit + 1) for c in combinations(range(STEP_BITS), n)]
    # the bits outside the two bands of a table, eight at a time, gathered from the code
    rows = rows.join(hot.select("node"), "node")
    bits = F.element_at(F.array(*[_gather("code", _rest(m)[depth * STEP_BITS : (depth + 1) * STEP_BITS]) for m in MASKS]), F.col("t") + 1)
    rows = rows.withColumn("bits", bits).withColumn("flip", F.explode(F.array(*[F.lit(f) for f in flips])))
    return rows.select(
        "t", "code", (F.col("home") & (F.col("flip") == 0)).alias("home"),
        F.xxhash64("node", F.col("bits").bitwiseXOR(F.col("flip")), F.lit(depth)).alias("node"),
    )


def _rest(mask: int) -> list[int]:
    return [i for i in range(63, -1, -1) if not mask >> i & 1]


def _gather(col: str, places: list[int]):
    out = F.lit(0)
    for k, place in enumerate(places):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.col(col), place).bitwiseAND(F.lit(1)), k).cast("int"))
    return out


def fingerprint_links(codes: DataFrame, limit: int = LIMIT, node_rows: int = NODE_ROWS) -> DataFrame:
    """Forest of links (a, b) between distinct ``code`` values that differ in at most ``limit`` (0 to 2) bits."""
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(MASKS)])).alias("x")
    rows = codes.select("code", table).select(
        F.col("x.t").alias("t"), "code", F.lit(True).alias("home"),
        F.xxhash64("x.t", F.col("code").bitwiseAND(F.col("x.mask"))).alias("node"),
    )
    ready, depth = None, 0
    while True:
        counts = rows.groupBy("node").agg(F.count_if("home").alias("n"))
        hot = counts.filter(F.col("n") > node_rows)
        if depth * STEP_BITS >= 32 or hot.isEmpty():
            ready = rows if ready is None else ready.unionByName(rows)
            break
        hot = stage(hot, "hot-nodes")
        calm = rows.join(hot.select("node"), "node", "left_anti")
        ready = calm.select(*rows.columns) if ready is None else ready.unionByName(calm.select(*rows.columns))
        rows = stage(_opened(rows, hot, depth, limit), "opened")
        depth += 1
    ready = ready.repartition("node").sortWithinPartitions("node")
    return ready.select("node", "code", "home").mapInArrow(_link_task(limit), "a long, b long")


def components_of(marked: DataFrame, limit: int = LIMIT, node_rows: int = NODE_ROWS) -> DataFrame:
    """(code, root, component_id): for each distinct fingerprint its group's smallest fingerprint and
    the smallest doc_id reachable over links.

    Equal fingerprints are one node, so copies never become pairs. A group without any doc_id has
    a null component_id.
    """
    classes = stage(marked.groupBy("code").agg(F.min("doc_id").alias("first")), "fingerprints")
    found = connected_components(fingerprint_links(classes.select("code"), limit, node_rows))
    grouped = classes.join(found, classes["code"] == found["node"], "left").select("code", "first", F.coalesce("component", "code").alias("root"))
    lowest = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    return grouped.join(lowest, "root").select("code", "root", "component_id")


def near_duplicates(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows give
    repeated rows; a null doc_id is kept and never names a component. No rows: no rows. Other
    columns are ignored.
    """
    marked = stage(docs.select("doc_id", fingerprint_column(F.col("text")).alias("code")), "marked")
    groups = components_of(marked, limit)
    return marked.join(groups, "code").select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Documents with one of each group left: the one with the smallest doc_id.

    All columns are returned as they came. Of repeated rows with that id one stays, and of a group
    without any doc_id one row stays.
    """
    code, key = free_name(docs, "code"), free_name(docs, "key")
    id_key = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    marked = stage(docs.withColumn(code, fingerprint_column(F.col("text"))), "marked")
    slim = marked.select("doc_id", F.col(code).alias("code"))
    groups = components_of(slim, limit)
    here = slim.join(groups, "code").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    chosen = here.groupBy("root").agg(F.min("component_id").alias("doc_id"), F.min("code").alias(code)).select(id_key.alias(key), code)
    # the key is never null and names the document twice: the rows stay where the join has dealt them
    kept = marked.withColumn(key, id_key).join(chosen, [key, code], "left_semi")
    return kept.dropDuplicates([key, code]).select(*docs.columns)
