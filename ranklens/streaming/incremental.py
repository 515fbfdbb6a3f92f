"""Stored bandit state carried from day to day: reload, add the new increment, write the next version.

The state of a day is additive, so a late or repeated day is one more increment and no stream state is
needed. ``fold_batch`` has the signature ``foreachBatch`` expects, for sources that arrive as a stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklens.operators.bandit import gram, gram_by_arm, update_state
from ranklens.sources.versions import read_version, write_version


def stored_state(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """State cells of a version (the newest by default). Only versions whose write has succeeded count."""
    return read_version(spark, path, version)


def next_state(spark: SparkSession, path: str, act: DataFrame, version: str, previous: str | None, d: int, lam: float = 1.0, arm: str | None = None) -> None:
    """Write version = previous + increment of ``act``; without ``previous`` the state starts anew at lam I.

    A first increment without rows leaves lam I of dimension ``d`` (no arm yet, per arm).

    A version is one folder, overwritten as a whole, so a rerun leaves the same state; until the write has
    succeeded it is no version, and ``previous`` must be one.
    """
    start = lam if previous is None else 0.0
    new = gram_by_arm(act, start, arm) if arm else gram(act, d, start)
    keys = ["arm"] if arm else []
    if previous is not None:
        old = stored_state(spark, path, previous)
        if arm:
            # an arm first seen today gets its own lam I
            fresh = new.filter(F.col("i") == F.col("j")).join(old.select("arm").distinct(), "arm", "left_anti")
            new = new.unionByName(fresh.withColumn("a", F.lit(float(lam))))
        new = update_state(old, new, keys)
    write_version(new, path, version)


def fold_batch(path: str, d: int, lam: float = 1.0, arm: str | None = None) -> Callable[[DataFrame, int], None]:
    """Function for ``foreachBatch``: batch n writes version n on top of version n - 1."""

    def run(batch: DataFrame, number: int) -> None:
        previous = f"{number - 1:012d}" if number > 0 else None
        next_state(batch.sparkSession, path, batch, f"{number:012d}", previous, d, lam, arm)

    return run
