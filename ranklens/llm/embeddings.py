"""Embedding near-dedup by int8 tile products with rigorous error bounds.

Unit vectors are rounded once to int8 codes with one scale each, and the length of what rounding left is
kept. For two vectors the product of codes differs from their cosine by at most
``e_v + e_u (1 + e_v)``; pairs whose product is surely above or below the threshold are settled by
it. Only codes, scales and errors are dealt to the tiles. A tile with undecided pairs names the vectors in
them; these alone are fetched in full, and the tile's undecided pairs are computed in double precision.

Vectors are compared cell by cell. A vector's home is the nearest of a few pivots; it also visits
every cell that could hold a vector within the threshold: two vectors at distance r cannot lie
further apart than r across the plane between two pivots. Cells are cut into tiles of bounded size,
so a crowded cell is many tasks, and each pair of cells meets on one side only. Pivots follow the number of
vectors; they decide where the work is done, never which links are found.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklens.llm.common import stage
from ranklens.llm.components import connected_components, forest

THRESHOLD = 0.95
#: Rows on each side of a tile product; vectors per pivot aimed at; pivots at most (a sample of the vectors).
TILE, CELL_ROWS, PIVOTS = 2048, 2048, 2048
#: Room for the rounding of the single-precision arithmetic on bounds.
SLACK = 1e-5


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and lengths of the rounding errors (rounded up to single precision)."""
    scale = np.abs(unit).max(1) / 127
    code = np.rint(unit / scale[:, None])
    error = np.linalg.norm(unit - code * scale[:, None], axis=1)
    return code.astype(np.int8), scale, np.nextafter(error.astype(np.float32), np.float32(np.inf))


def settle(qu, su, eu, qv, sv, ev, threshold: float) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that surely link, and pairs that codes leave undecided.

    A single-precision product picks the pairs near or above the threshold, with room for its rounding;
    these are computed again from whole numbers, so the outcome does not depend on the tile.
    """
    near = (qu.astype(np.float32) * su.astype(np.float32)[:, None]) @ (qv.astype(np.float32) * sv.astype(np.float32)[:, None]).T
    worst = float(eu.max()) * (1 + float(ev.max())) + float(ev.max())
    x, y = np.nonzero(near >= np.float32(threshold - worst - SLACK - 1e-6 * qu.shape[1]))
    sure, open_ = [], []
    for at in range(0, len(x), 100_000):
        i, j = x[at : at + 100_000], y[at : at + 100_000]
        product = np.einsum("ij,ij->i", qu[i].astype(np.int32), qv[j].astype(np.int32)) * su[i] * sv[j]
        gap = eu[i].astype(np.float64) * (1 + ev[j].astype(np.float64)) + ev[j] + SLACK
        yes = product - gap >= threshold
        maybe = ~yes & (product + gap >= threshold)
        sure.append((i[yes], j[yes]))
        open_.append((i[maybe], j[maybe]))
    join = lambda parts: tuple(np.concatenate([np.zeros(0, np.int64), *(p[k] for p in parts)]) for k in (0, 1))
    return join(sure), join(open_)


def exact(u: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs (i, j) of rows of u and v link, by their cosine in double precision."""
    yes = np.zeros(len(i), dtype=bool)
    for at in range(0, len(i), 100_000):
        x, y = i[at : at + 100_000], j[at : at + 100_000]
        yes[at : at + 100_000] = np.einsum("ij,ij->i", u[x], v[y]) >= threshold
    return i[yes], j[yes]


def _units(batch: pa.RecordBatch, name: str = "embedding") -> np.ndarray:
    column = batch.column(name)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    # divided by the largest component first, so that squares of very large or small values stay finite
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _homes(pivots: dict[int, np.ndarray], reach: float):
    """Adds to each vector its home cell and the cells it visits."""

    def cells(unit: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        own = pivots.get(unit.shape[1])
        if own is None or len(own) < 2:
            return np.zeros(len(unit), dtype=np.int32), [np.zeros(0, dtype=np.int32)] * len(unit)
        near = unit @ own.T
        home = near.argmax(1)
        apart = np.sqrt(np.maximum(2 - 2 * own @ own.T, 0))
        np.fill_diagonal(apart, np.inf)
        apart[apart < 1e-6] = np.inf
        # how far the vector lies outside the cell: first across the plane to its home, then the worst of all planes
        visits = (near[np.arange(len(unit)), home][:, None] - near) / apart[home] <= reach
        for a in range(len(own)):
            some = np.flatnonzero(visits[:, a])
            visits[some, a] = ((near[some] - near[some, a : a + 1]) / apart[a]).max(1) <= reach
        number = np.arange(len(own))
        one_way = np.where((number + home[:, None]) % 2 == 0, number < home[:, None], number > home[:, None])
        return home.astype(np.int32), [np.flatnonzero(x).astype(np.int32) for x in visits & one_way]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                size = np.array([len(x) for x in part.column("embedding")])
                for dim in np.unique(size):
                    rows = part.filter(pa.array(size == dim))
                    unit = _units(rows)
                    home, visits = cells(unit)
                    code, scale, error = quantise(unit)
                    yield pa.RecordBatch.from_arrays(
                        [*(rows.column(c) for c in ("node", "copies")), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale), pa.array(error),
                         pa.array([int(dim)] * len(rows), pa.int32()), pa.array(home), pa.array(visits, pa.list_(pa.int32()))],
                        names=["node", "copies", "code", "scale", "error", "dim", "home", "visits"],
                    )

    return run


def _compare(threshold: float, full: bool):
    """Tile products over rows sorted by tile pair; one pair is held at a time.

    From codes alone (``full`` false) the sure links come out, and the vectors of undecided pairs with their
    tile; from those vectors in full, the undecided pairs that link.
    """

    def product(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        left = table.column("left").to_numpy(zero_copy_only=False)
        node, n = table.column("node").to_numpy(), table.column("copies").to_numpy()
        code = np.frombuffer(b"".join(table.column("code").to_pylist()), np.int8).reshape(len(node), -1)
        scale, error = table.column("scale").to_numpy(), table.column("error").to_numpy()
        same = bool(table.column("same")[0].as_py())
        a, b = (np.arange(len(node)),) * 2 if same else (np.flatnonzero(left), np.flatnonzero(~left))
        if not len(a) or not len(b):
            return
        sure, undecided = settle(code[a], scale[a], error[a], code[b], scale[b], error[b], threshold)
        x, y = undecided
        if same:  # each pair once
            x, y = x[x < y], y[x < y]
        if full:
            unit = _units(table)
            x, y = exact(unit[a], unit[b], x, y, threshold)
        else:
            rows_open = np.unique(np.concatenate([a[x], b[y]]))
            if len(rows_open):
                yield _result(node[rows_open], unit=np.full(len(rows_open), table.column("unit")[0].as_py()), left=left[rows_open], same=same)
            x, y = sure
            if same:
                x, y = x[x < y], y[x < y]
        if not len(x):
            return
        x, y = a[x], b[y]
        total = np.bincount(x, n[y], len(node)) + np.bincount(y, n[x], len(node))
        linked = np.flatnonzero(total)
        yield _result(node[linked], links=total[linked].astype(np.int64))
        label = forest(len(node), x, y)
        moved = np.flatnonzero(label != np.arange(len(node)))
        yield _result(node[moved], b=node[label[moved]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            unit = batch.column("unit").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1), len(unit)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if now is not None and unit[a] != now:
                    yield from product(held)
                    held = []
                now = unit[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from product(held)

    return run


_FOUND = "a long, b long, links long, unit long, left boolean, same boolean"


def _result(a: np.ndarray, b=None, links=None, unit=None, left=None, same=None) -> pa.RecordBatch:
    """Rows of three kinds: an edge (a, b), a number of links of a, or a as a vector to be fetched for a tile."""
    n = len(a)
    given = [pa.nulls(n, pa.int64()) if c is None else pa.array(c, pa.int64()) for c in (b, links, unit)]
    given += [pa.nulls(n, pa.bool_()) if c is None else pa.array(np.broadcast_to(c, n), pa.bool_()) for c in (left, same)]
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), *given], names=["a", "b", "links", "unit", "left", "same"])


def _valid(vector):
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(good, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


#: What a tile gets of a vector.
_CODED = ("node", "copies", "code", "scale", "error")


def _tiled(cells: DataFrame, tile: int) -> DataFrame:
    """Rows by tile pair: (unit, left, same, node, copies, code, scale, error).

    Tiles of a cell are numbered by hash. Home tiles meet each other and the tiles of visitors.
    """
    homes = cells.groupBy("dim", "home").count().collect()
    guests = cells.select("dim", F.explode("visits").alias("cell")).groupBy("dim", "cell").count().collect()
    n_home = {(r["dim"], r["home"]): ceil(r["count"] / tile) for r in homes}
    n_guest = {(r["dim"], r["cell"]): ceil(r["count"] / tile) for r in guests}
    sizes = [(d, c, h, n_guest.get((d, c), 0)) for (d, c), h in n_home.items()]
    sizes = cells.sparkSession.createDataFrame(sizes, "dim int, cell int, h int, g int")
    # one row for each pivot (PIVOTS at most) and each length of vector
    rows = cells.join(F.broadcast(sizes.withColumnRenamed("cell", "home")), ["dim", "home"])
    mine = F.pmod(F.xxhash64("node"), F.col("h")).cast("int")
    number = lambda i, j, kind: F.xxhash64("dim", "cell", i, j, F.lit(kind))
    base = rows.select("dim", F.col("home").alias("cell"), "h", "g", mine.alias("m"), *_CODED)
    among = base.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("h") - 1)))
    among = among.select(
        number(F.greatest("k", "m"), F.least("k", "m"), "home").alias("unit"), (F.col("k") <= F.col("m")).alias("left"),
        (F.col("k") == F.col("m")).alias("same"), *_CODED)
    against = base.filter(F.col("g") > 0).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    against = against.select(number("m", "k", "guest").alias("unit"), F.lit(True).alias("left"), F.lit(False).alias("same"), *_CODED)
    visiting = cells.select("dim", F.explode("visits").alias("cell"), *_CODED)
    visiting = visiting.join(F.broadcast(sizes), ["dim", "cell"])
    chunk = F.pmod(F.xxhash64("node"), F.col("g")).cast("int")
    visiting = visiting.withColumn("m", chunk).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("h") - 1)))
    visiting = visiting.select(number("k", "m", "guest").alias("unit"), F.lit(False).alias("left"), F.lit(False).alias("same"), *_CODED)
    return among.unionByName(against).unionByName(visiting)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Links join vectors of one length whose cosine in double precision is at least the threshold.
    Vectors that are null, empty, all zero, or hold a null or non-finite component link with nothing
    and are their own component. Equal vectors are one node until the end, so copies never become
    pairs. Repeated rows are vectors of their own; a null vec_id is counted as a link and never
    names a component (without any other id the component is null). Other columns are ignored.
    """
    spark = vectors.sparkSession
    own = vectors.select("vec_id", F.when(_valid(F.col("embedding")), F.col("embedding")).alias("embedding"))
    classes = own.filter(F.col("embedding").isNotNull()).groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    count = classes.count()
    sample = classes.orderBy(F.xxhash64("node")).limit(max(1, min(PIVOTS, count // cell_rows))).select("embedding").collect()
    pivots: dict[int, list] = {}
    for (x,) in sample:
        x = np.array(x, dtype=np.float64) / max(map(abs, x))
        pivots.setdefault(len(x), []).append(x / np.linalg.norm(x))
    homes = _homes({k: np.array(v) for k, v in pivots.items()}, sqrt(2 - 2 * threshold) + 1e-6)
    coded = "node long, copies long, code binary, scale double, error float, dim int, home int, visits array<int>"
    cells = stage(classes.select("node", "copies", "embedding").mapInArrow(homes, coded), "cells")
    tiles = _tiled(cells, tile).repartition("unit").sortWithinPartitions("unit")
    by_code = stage(tiles.mapInArrow(_compare(threshold, False), _FOUND), "tile-links")
    wanted = by_code.filter(F.col("unit").isNotNull()).select("unit", F.col("a").alias("node"), "left", "same")
    full = wanted.join(cells.select(*_CODED), "node").join(classes.select("node", "embedding"), "node").repartition("unit").sortWithinPartitions("unit")
    by_vector = stage(full.mapInArrow(_compare(threshold, True), _FOUND), "tile-links")
    found = by_code.filter(F.col("unit").isNull()).unionByName(by_vector)
    links = found.filter(F.col("b").isNull()).groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    groups = connected_components(found.filter(F.col("b").isNotNull()).select("a", "b"))
    known = classes.select("node", "first", "copies").join(links, "node", "left").join(groups, "node", "left")
    known = known.select("node", "first", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("root"))
    low = known.groupBy("root").agg(F.min("first").alias("component_id"))
    done = stage(known.join(low, "root").select("node", "n_links", "component_id"), "linked")
    results = classes.select("embedding", "node").join(done, "node").select("embedding", "n_links", "component_id")
    linked = own.filter(F.col("embedding").isNotNull()).join(results, "embedding").select("vec_id", "n_links", "component_id")
    alone = own.filter(F.col("embedding").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), u AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95::DOUBLE
), reach AS (
  SELECT a, b FROM links
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), low AS (
  SELECT a, min(b) AS low FROM reach GROUP BY a
), n AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings e LEFT JOIN low ON low.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
