"""Building blocks that stay distributed when one key holds a large part of the rows.

A window over a hot key would sort that key in one task. The helpers here split the order of a key
into slices, total the slices with a plain aggregation, and add the total of the earlier slices to
the position within a slice. Results equal the single-window form exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_SLICES = 1024


def small_value(df: DataFrame) -> Column:
    """One-row, one-column frame as an expression (a scalar subquery, no join)."""
    return df.scalar()


#: Rows of a key that are sorted in one task; a key with more is cut into slices of its own range.
SLICE_ROWS = 10_000
#: Slices of a range, on each of two levels.
CUTS = 4096


def _slice(x: Column, lo: Column, hi: Column) -> Column:
    """Which of equal parts of [lo, hi] holds x; grows with x, the infinite and NaN at the ends."""
    place = (x - lo) / F.when(hi > lo, hi - lo)
    inside = F.greatest(F.lit(0), F.least(F.lit(CUTS - 1), F.floor(place * CUTS)))
    return F.when((x == lo) | place.isNull(), 0).when(F.isnan(place), CUTS - 1).otherwise(inside).cast("long")


def _join_facts(rows: DataFrame, keys: list[str], facts: list[Column]) -> DataFrame:
    """Rows with aggregates of their key; keys may be null. Without keys the aggregates are a scalar subquery."""
    if not keys:
        packed = rows.agg(*facts)
        return rows.withColumn("__f", packed.select(F.struct("*")).scalar()).select(*rows.columns, "__f.*")
    per_key = rows.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(*facts)
    return rows.join(per_key, _same(keys)).drop(*[f"__k_{k}" for k in keys])


def prefix_sums(df: DataFrame, by: list[str], col: str, values: dict[str, Column], descending: bool = False, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Exclusive running sums per ``by`` in the order of the number ``col``, and the key's ``<name>_total``.

    ``col`` is distinct within a key. A key with more than ``slice_rows`` rows is cut into equal parts of
    its own range, and a part that still holds more is cut once again, so outliers do not undo the
    cut. Least and largest values are exact, whatever order they are merged in, so the plan may
    evaluate them more than once. Keys may be null. The cuts only spread the work.
    """
    by = list(by)
    x = F.col(col).cast("double")
    rows = df.select("*", *[v.alias(f"__v_{n}") for n, v in values.items()])
    bounds = [F.count(F.lit(1)).alias("__rows"), F.min(x).alias("__lo"), F.max(x).alias("__hi")]
    rows = _join_facts(rows, by, [*bounds, *[F.sum(f"__v_{n}").alias(f"{n}_total") for n in values]])
    part = F.when(F.col("__rows") > slice_rows, _slice(x, F.col("__lo"), F.col("__hi"))).otherwise(F.lit(0).cast("long"))
    rows = _join_facts(rows.withColumn("__p", part).drop("__rows", "__lo", "__hi"), [*by, "__p"], bounds)
    again = F.when(F.col("__rows") > slice_rows, _slice(x, F.col("__lo"), F.col("__hi"))).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("__s", F.col("__p") * CUTS + again).drop("__rows", "__lo", "__hi", "__p")
    keys = [*by, "__s"]
    slices = rows.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in values])
    over_keys = Window.partitionBy(*[f"__k_{k}" for k in by]) if by else Window.partitionBy()
    before = over_keys.orderBy("__k___s").rowsBetween(Window.unboundedPreceding, -1)
    carry = slices.select(*[f"__k_{k}" for k in keys], *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__c_{n}") for n in values])
    inner = Window.partitionBy(*keys).orderBy(col).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(carry, _same(keys))

    def out(n):
        upto = F.coalesce(F.sum(f"__v_{n}").over(inner), F.lit(0)) + F.col(f"__c_{n}")
        return F.col(f"{n}_total") - upto - F.col(f"__v_{n}") if descending else upto

    return joined.select(*df.columns, *[out(n).alias(n) for n in values], *[f"{n}_total" for n in values])


def _same(keys: list[str]) -> Column:
    """Join condition on keys that may be null, against columns named ``__k_<key>``."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])


def row_hash(df: DataFrame, columns: list[str]) -> Column:
    """Hash of a row's columns, wherever the row stands: a task that runs again gives the same. Maps are left out."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return F.xxhash64(*[F.col(c) for c in columns if "map<" not in kinds[c]])


def places(df: DataFrame, by: list[str], first: str, then: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Distinct (by, first, then) with their number ``n`` and ``place``: rows of the key before them, by ``first`` falling, ``then`` rising.

    Both columns are numbers, ``first`` not null. Rows are counted per value before anything is ordered, and
    the order is cut into slices of the key's own range, on each of the two columns, so neither a key with
    very many rows nor a value that very many of them share is sorted in one task.
    """
    single = df.groupBy(*by, first, then).agg(F.count(F.lit(1)).alias("n"))
    ties = prefix_sums(single, [*by, first], then, {"__tie": F.col("n")}, slice_rows=slice_rows).drop("__tie_total")
    levels = single.groupBy(*[F.col(k).alias(f"__k_{k}") for k in [*by, first]]).agg(F.sum("n").alias("__n"))
    above = prefix_sums(levels, [f"__k_{k}" for k in by], f"__k_{first}", {"__above": F.col("__n")}, descending=True, slice_rows=slice_rows)
    above = above.drop("__n", "__above_total")
    joined = ties.join(above, _same([*by, first]))
    return joined.select(*by, first, then, "n", (F.col("__above") + F.col("__tie")).alias("place"))


def first_by_draw(df: DataFrame, by: list[str], draw: str, tie: list[str], limit: Column) -> DataFrame:
    """Rows whose position in ascending ``draw`` order within ``by`` is at most ``limit``.

    ``limit`` is an expression that is constant per key. Draws are uniform, so equal-width slices of
    [0, 1) are balanced; slices past the limit are dropped before any sorting.
    """
    keys = [*by, "__slice"]
    cut = df.withColumn("__slice", F.floor(F.col(draw) * HASH_SLICES).cast("int")).withColumn("__limit", limit)
    totals = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inner = Window.partitionBy(*keys).orderBy(draw, *tie)
    return (
        cut.join(carry.hint("merge"), keys)
        .filter(F.col("__before") < F.col("__limit"))
        .withColumn("__pos", F.row_number().over(inner) + F.col("__before"))
        .filter(F.col("__pos") <= F.col("__limit"))
        .select(*df.columns)
    )


def pick_one(df: DataFrame, keys: list[str], order: list[str], largest: bool = True) -> DataFrame:
    """One whole row per key, the largest (or smallest) by ``order``.

    A max over structs merges on the map side, so a hot key ships one row per task.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*order, *rest)
    chosen = F.max(packed) if largest else F.min(packed)
    return df.groupBy(*keys).agg(chosen.alias("__row")).select(
        *[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns]
    )


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int, position: str | None = None) -> DataFrame:
    """First n rows per key. Spark limits each task's rows per key before the shuffle."""
    ranked = df.withColumn("__pos", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    kept = ranked.filter(F.col("__pos") <= n)
    return kept.withColumnRenamed("__pos", position) if position else kept.drop("__pos")
