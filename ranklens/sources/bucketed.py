"""Tables stored by user, so that the joins of later jobs on the user move no rows.

A table is bucketed and sorted by (user, part), one file per bucket. Most users have part 0 only. A user
with more rows than a bucket should hold is heavy: a table with many rows per user deals that user's rows to
parts of their own, and a table that others look users up in repeats the user's rows in each of these parts.
Two tables written with the same list of heavy users and the same number of buckets join on (user, part)
without an exchange, and no bucket holds a heavy user whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklens.operators.keyed import row_hash

PART = "user_part"


def heavy_users(df: DataFrame, rows_per_part: int, key: str = "dw_p_id") -> DataFrame:
    """(user, parts) of the users with more than ``rows_per_part`` rows. Stage it: every table is written with it."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > rows_per_part)
    return n.select(key, F.ceil(F.col("n") / rows_per_part).cast("int").alias("parts"))


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int, heavy: DataFrame, key: str = "dw_p_id", lookup: bool = False) -> None:
    """Save ``df`` as a table at ``path`` with the column ``user_part``.

    ``lookup``: rows of a heavy user are repeated in all of the user's parts, for the side that others look
    users up in (at most a few rows per user). Otherwise each row has one part, drawn from a hash of the
    row, so equal rows share it. A null user has part 0 and meets nobody, as in any join.
    """
    marked = df.join(heavy.select(key, F.col("parts").alias("__parts")), key, "left")
    parts = F.coalesce("__parts", F.lit(1))
    if lookup:
        placed = marked.withColumn(PART, F.explode(F.sequence(F.lit(0), parts - 1)))
    else:
        placed = marked.withColumn(PART, F.pmod(row_hash(df, df.columns), parts).cast("int"))
    placed = placed.select(*df.columns, PART).repartition(buckets, key, PART)
    placed.write.mode("overwrite").option("path", path).bucketBy(buckets, key, PART).sortBy(key, PART).saveAsTable(table)


def join_users(rows: DataFrame, other: DataFrame, how: str = "inner", key: str = "dw_p_id") -> DataFrame:
    """Join of a table of rows with a lookup table of the same buckets; semi and anti joins too.

    A merge join is asked for: it reads the buckets as they lie. Full joins would repeat a heavy user's
    unmatched lookup rows, so they are refused.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a {how} join is not possible on repeated lookup rows")
    return rows.join(other.hint("merge"), [key, PART], how).drop(PART)
