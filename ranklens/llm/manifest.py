"""Merkle manifest of a dataset, with a proof for every row by pointer jumping.

Rows are the leaves of one tree per language; the trees' roots, ordered by language, are the leaves of a
last tree. A node's pointer goes to an ancestor, and its segment lists the siblings on the way there. At
first every pointer goes one level up. A self-join of nodes with the nodes they point to doubles the
distance and appends the ancestor's segment; after a number of joins that grows with the logarithm of the
tree's height every leaf has reached the root and holds its whole proof. Only nodes at multiples of the
distance take part in a round, so all rounds together handle about one row per leaf each.

Leaves are numbered by a range partition and the counts of its parts, and digests are made in blocks of
1024 neighbouring nodes, so no language, however large, is one task's.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranklens.llm.common import stage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED_ONE_IN = 7
#: Levels built by one task from its block of nodes.
BITS = 10
#: A step of a proof: the sibling stands right or left (32 bytes follow), or there is none.
RIGHT, LEFT, ALONE = b"R", b"L", b"A"
TOP = -1


def _h(text: str) -> bytes:
    return hashlib.sha256(text.encode()).digest()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: dict[str, Column]) -> Column:
    """Digest of a row: each field as its length in bytes, a colon and its value, or ``-`` for null."""
    return F.unhex(F.sha2(F.concat(*[_field(values[c]) for c in FIELDS]), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, lang_key, leaf, tampered): ``tampered`` is the digest after an edit of n_chars, null without one."""
    own = {c: F.col(c) for c in FIELDS}
    edited = own | {"n_chars": F.col("n_chars").cast("decimal(38,0)") + 1}
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED_ONE_IN == 0) & F.col("n_chars").isNotNull()
    return docs.select(
        "doc_id", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("lang_key"), leaf_digest(own).alias("leaf"),
        F.when(hit, leaf_digest(edited)).alias("tampered"),
    )


def _dealt(rows: DataFrame, key: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows in parts that follow (key, order), and per (key, part) how many of the key come before, and in all.

    Equal rows are parted by their place in the table they are read from, which must be a written one.
    """
    spread = rows.withColumn("place", F.monotonically_increasing_id())
    spread = spread.repartitionByRange(key, *order, "place").withColumn("part", F.spark_partition_id())
    spread = stage(spread, "parts")
    own = Window.partitionBy(key)
    cells = spread.groupBy(key, "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return spread, cells.select(key, "part", before.alias("before"), F.sum("n").over(own).alias("count"))


def _numbered(spread: DataFrame, cells: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows with the columns of their cell and their number ``idx`` within the key, from 0."""
    within = F.row_number().over(Window.partitionBy(key, "part").orderBy(*order, "place"))
    rows = spread.withColumn("at", within).join(cells, [key, "part"])
    return rows.withColumn("idx", F.col("before") + F.col("at") - 1).drop("before", "at", "part", "place")


def _levels(nodes: DataFrame, level: int, carried: list[str]) -> DataFrame:
    """Nodes at ``level`` (tree, idx, count, hash) grown by BITS levels, a block of neighbours per group.

    A row with a segment is a node below the block's end and its step to its parent; a row with a hash is
    where the block ended, at its tree's root (count 1) or at BITS levels up. ``carried`` columns stay with
    the rows of level 0, which have a segment in a tree of one leaf too (an empty one).
    """
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
    schema = "tree long, level int, idx long, count long, segment binary, hash binary" + "".join(f", {c} {kinds[c]}" for c in carried)

    def grow(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx").combine_chunks()
        tree, first, count = table["tree"][0].as_py(), table["idx"][0].as_py(), table["count"][0].as_py()
        hashes = table["hash"].to_pylist()
        out: list[tuple] = []
        if level == 0 and count == 1:
            out.append((0, first, 1, b"", None))
        k = 0
        while k < BITS and count > 1:
            for i, h in enumerate(hashes):
                step = ALONE if i ^ 1 >= len(hashes) else (LEFT if i & 1 else RIGHT) + hashes[i ^ 1]
                out.append((level + k, first + i, count, step, None))
            hashes = [_h("".join(x.hex() for x in hashes[i : i + 2])) for i in range(0, len(hashes), 2)]
            first, count, k = first >> 1, -(-count // 2), k + 1
        out.append((level + k, first, count, None, hashes[0]))
        columns = [pa.array([tree] * len(out), pa.int64())]
        kinds_ = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        columns += [pa.array(values, kind) for values, kind in zip(zip(*out), kinds_)]
        for c in carried:
            own = table[c].combine_chunks()
            own = own.chunk(0) if isinstance(own, pa.ChunkedArray) else own
            columns.append(pa.concat_arrays([own, pa.nulls(len(out) - len(own), own.type)]))
        return pa.table(columns, names=["tree", "level", "idx", "count", "segment", "hash", *carried])

    block = nodes.withColumn("block", F.shiftright("idx", BITS))
    return block.groupBy("tree", "block").applyInArrow(lambda t: grow(t.drop_columns(["block"])), schema)


def _trees(nodes: DataFrame, carried: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(steps of the leaves, steps of the other nodes, roots) of all trees, BITS levels a round."""
    grown = stage(_levels(nodes, 0, carried), "levels")
    first = grown.filter("level = 0 and segment is not null").select("tree", "idx", "segment", *carried)
    steps = [grown.filter("level > 0 and segment is not null").select("tree", "level", "idx", "segment")]
    roots = [grown.filter("hash is not null and count = 1").select("tree", "level", "hash")]
    level = BITS
    while True:
        open_ = grown.filter(f"hash is not null and count > 1 and level = {level}").select("tree", "idx", "count", "hash")
        if open_.isEmpty():
            break
        grown = stage(_levels(open_, level, []), "levels")
        steps.append(grown.filter("segment is not null").select("tree", "level", "idx", "segment"))
        roots.append(grown.filter("hash is not null and count = 1").select("tree", "level", "hash"))
        level += BITS
    return first, reduce(DataFrame.unionByName, steps), reduce(DataFrame.unionByName, roots)


def _pointed(distance: int, bottom: int, level: Column) -> list[Column]:
    """Key (tree, level, idx) of the ancestor ``distance`` up; trees of languages end at level ``bottom``."""
    far = level + distance
    inside = (F.col("tree") == TOP) | (far <= bottom)
    up = F.call_function("shiftright", F.col("idx"), F.lit(distance))
    across = F.call_function("shiftright", F.col("tree"), F.greatest(far - bottom, F.lit(0)))
    return [F.when(inside, F.col("tree")).otherwise(F.lit(TOP)).alias("to_tree"), far.cast("int").alias("to_level"), F.when(inside, up).otherwise(across).alias("to_idx")]


def _jump(nodes: DataFrame, over: DataFrame, distance: int, bottom: int, level: Column) -> DataFrame:
    """``nodes`` with the segment of the ancestor they point to appended; those past the root stay as they are."""
    names = nodes.columns
    there = over.select(F.col("tree").alias("to_tree"), F.col("level").alias("to_level"), F.col("idx").alias("to_idx"), F.col("segment").alias("more"))
    joined = nodes.select("*", *_pointed(distance, bottom, level)).join(there, ["to_tree", "to_level", "to_idx"], "left")
    return joined.withColumn("segment", F.concat("segment", F.coalesce("more", F.lit(b"")))).select(*names)


def proofs(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, tampered, segment, subroot, root (digests as 32 bytes).

    ``segment`` is the proof: the steps from the leaf to the root, each a side and the sibling's digest.
    Leaves stand by (lang, doc_id), null first; equal ids stand by digest, so the tree does not depend on
    the order of rows. Null is a language of its own. Repeated rows are leaves each. Empty and very long
    texts are digested whole. No rows: no rows. Other columns are ignored.
    """
    made = stage(leaves(docs), "leaves")
    spread, cells = _dealt(made, "lang_key", ["doc_id", "leaf"])
    cells = stage(cells, "cells")
    langs = stage(cells.groupBy("lang_key").agg(F.first("count").alias("leaves")).withColumn("all", F.lit(0)), "langs")
    langs = stage(_numbered(*_dealt(langs, "all", ["lang_key"]), "all", ["lang_key"]).select("lang_key", F.col("idx").alias("tree")), "langs")
    rows = _numbered(spread, cells.join(langs, "lang_key"), "lang_key", ["doc_id", "leaf"])
    nodes = rows.select("tree", "idx", "count", F.col("leaf").alias("hash"), "doc_id", "leaf", "tampered")
    low, steps, subroots = _trees(nodes, ["doc_id", "leaf", "tampered"])
    subroots = stage(subroots, "subroots")
    height, n = subroots.agg(F.max("level"), F.count(F.lit(1))).first()
    bottom = max(1, height or 0)
    top_nodes = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(n).cast("long").alias("count"), "hash")
    top_low, top_steps, top_root = _trees(top_nodes, [])
    # a shorter tree's root is carried up to the level where the last tree begins
    rest = F.sequence(F.greatest("level", F.lit(1)), F.lit(bottom - 1))
    carried = subroots.filter(F.greatest("level", F.lit(1)) < bottom).select("tree", F.explode(rest).alias("level"), F.lit(0).cast("long").alias("idx"), F.lit(b"").alias("segment"))
    turn = top_low.select(F.col("idx").alias("tree"), F.lit(bottom).alias("level"), F.lit(0).cast("long").alias("idx"), "segment")
    high = top_steps.withColumn("level", F.col("level") + bottom)
    upper = stage(steps.unionByName(carried).unionByName(turn).unionByName(high), "steps")
    total, distance = bottom + max(0, (n or 1) - 1).bit_length(), 1
    while distance < total:
        low = _jump(low, upper.filter(F.col("level") == distance), distance, bottom, F.lit(0))
        at = F.col("level") % (2 * distance)
        upper_next = _jump(upper.filter(at == 0), upper.filter(at == distance), distance, bottom, F.col("level"))
        upper = stage(upper_next, "steps")
        distance *= 2
    own = subroots.select("tree", F.col("hash").alias("subroot"))
    root = stage(top_root.select(F.col("hash").alias("root")), "root")
    return low.join(own, "tree").select("doc_id", "leaf", "tampered", "segment", "subroot", root.scalar().alias("root"))


def steps_of(segment: bytes) -> list[tuple[bytes, bytes]]:
    """(side, sibling) from the leaf upwards; the sibling is empty where there is none."""
    out, at = [], 0
    while at < len(segment):
        side = segment[at : at + 1]
        end = at + 1 + (0 if side == ALONE else 32)
        out.append((side, segment[at + 1 : end]))
        at = end
    return out


def fold(leaf: bytes, segment: bytes) -> bytes:
    """Root that a leaf and its proof lead to."""
    now = leaf
    for side, sibling in steps_of(segment):
        now = _h(sibling.hex() + now.hex() if side == LEFT else now.hex() + sibling.hex())
    return now


def _check(leaf: pa.Array, tampered: pa.Array, segment: pa.Array) -> pa.Array:
    kind = pa.struct([("proof", pa.string()), ("folded", pa.binary())])
    out = []
    for a, b, s in zip(leaf.to_pylist(), tampered.to_pylist(), segment.to_pylist()):
        out.append({"proof": _h("".join(x.hex() for _, x in steps_of(s))).hex(), "folded": fold(a if b is None else b, s)})
    return pa.array(out, kind)


def manifest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``folded_root`` is what the (for one id in seven edited) leaf and the original proof lead to; it equals
    the root exactly if the leaf was not changed. Rules for nulls, ties and repeats are those of ``proofs``.
    """
    checked = proofs(docs).withColumn("c", F.arrow_udf(_check, "struct<proof:string,folded:binary>")("leaf", "tampered", "segment"))
    text = lambda c: F.lower(F.hex(c))
    return checked.select(
        "doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), F.col("c.proof").alias("proof_sha256"),
        text("c.folded").alias("folded_root"), (F.col("c.folded") == F.col("root")).alias("verified"),
    )


def _sql_field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


_SQL_LEAF = " || ".join(_sql_field(c) for c in FIELDS)
ORACLE = f"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t
  FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) AS v FROM range(256) x(i))
), hashed AS (
  SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ord(x))),
                            lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 7 = 0 AS hit
  FROM documents, crc_table
), docs AS (
  SELECT doc_id, lang, sha256({_SQL_LEAF}) AS leaf,
         CASE WHEN hit AND n_chars IS NOT NULL THEN sha256({_SQL_LEAF.replace("n_chars", "(n_chars + 1)")}) ELSE sha256({_SQL_LEAF}) END AS used
  FROM hashed
), langs AS (
  SELECT lang, CAST(row_number() OVER (ORDER BY lang NULLS FIRST) AS BIGINT) AS tree FROM (SELECT DISTINCT lang FROM docs)
), leaves AS (
  SELECT tree, CAST(row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS BIGINT) AS idx, doc_id, leaf, used
  FROM docs JOIN langs ON docs.lang IS NOT DISTINCT FROM langs.lang
), nodes(tree, level, idx, hash, n) AS (
  SELECT tree, 0, idx, leaf, count(*) OVER (PARTITION BY tree) FROM leaves
  UNION ALL
  SELECT tree, max(level) + 1, idx // 2, sha256(string_agg(hash, '' ORDER BY idx)), (max(n) + 1) // 2 FROM nodes WHERE n > 1 GROUP BY tree, idx // 2
), subroots AS (
  SELECT tree, hash AS subroot FROM nodes WHERE n = 1
), tops(level, idx, hash, n) AS (
  SELECT 0, tree - 1, subroot, count(*) OVER () FROM subroots
  UNION ALL
  SELECT max(level) + 1, idx // 2, sha256(string_agg(hash, '' ORDER BY idx)), (max(n) + 1) // 2 FROM tops WHERE n > 1 GROUP BY idx // 2
), root AS (
  SELECT hash AS root FROM tops WHERE n = 1
), steps AS (
  SELECT l.tree, l.idx AS leaf_idx, x.level, s.hash AS sibling, (l.idx >> x.level) & 1 AS side
  FROM leaves l JOIN (SELECT DISTINCT tree, CAST(level AS BIGINT) AS level FROM nodes WHERE n > 1) x ON x.tree = l.tree
  LEFT JOIN nodes s ON s.tree = l.tree AND s.level = x.level AND s.idx = xor(l.idx >> x.level, 1)
  UNION ALL
  SELECT l.tree, l.idx, 1000 + x.level, s.hash, ((l.tree - 1) >> x.level) & 1
  FROM leaves l CROSS JOIN (SELECT DISTINCT CAST(level AS BIGINT) AS level FROM tops WHERE n > 1) x
  LEFT JOIN tops s ON s.level = x.level AND s.idx = xor((l.tree - 1) >> x.level, 1)
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY tree, leaf_idx ORDER BY level) AS k FROM steps
), proofs AS (
  SELECT tree, leaf_idx AS idx, sha256(coalesce(string_agg(sibling, '' ORDER BY level), '')) AS proof_sha256 FROM steps GROUP BY tree, leaf_idx
), folded(tree, idx, k, hash) AS (
  SELECT tree, idx, CAST(0 AS BIGINT), used FROM leaves
  UNION ALL
  SELECT f.tree, f.idx, f.k + 1, sha256(CASE WHEN side = 1 THEN sibling || f.hash ELSE f.hash || coalesce(sibling, '') END)
  FROM folded f JOIN numbered s ON s.tree = f.tree AND s.leaf_idx = f.idx AND s.k = f.k + 1
), ends AS (
  SELECT tree, idx, last(hash ORDER BY k) AS folded_root FROM folded GROUP BY tree, idx
)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN subroots USING (tree) CROSS JOIN root JOIN ends USING (tree, idx) LEFT JOIN proofs USING (tree, idx)
"""
