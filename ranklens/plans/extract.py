"""Daily extract: examples of both tasks to feature rows in one pass, and the multi-day training set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklens.functions.hashing import hash_uniform
from ranklens.operators import aggregates, examples, features

EXPOSED, RANDOM_WATCH = 0, 1


def random_watch_examples(positives: DataFrame, catalog: DataFrame, history: DataFrame, n: int) -> DataFrame:
    """First-watch positives (of a sample of users, staged by the caller), each with up to n random negatives."""
    negatives = examples.random_negatives(positives, catalog, history, n)
    return positives.select(*examples.EXAMPLE_COLUMNS).unionByName(negatives.select(*examples.EXAMPLE_COLUMNS))


def as_mtl(ex: DataFrame) -> DataFrame:
    """Single-label examples with the labels of the multi-task set."""
    zero = F.lit(0).cast("bigint")
    return ex.select("dw_p_id", "tray_id", "content_id", "timestamp", F.col("label").alias("click"), F.col("label").alias("watch"), "watch_time",
                     zero.alias("paywall_view"), zero.alias("add_watchlist"))


def extract_day(exposed: DataFrame, random_watch: DataFrame, events: DataFrame, catalog: DataFrame, pop: DataFrame, state_pop: DataFrame,
                country: str, mtl: bool = False, production_house: bool = False, prepare=None) -> DataFrame:
    """Feature rows of both tasks; the task is a column, so events, profiles and dimensions are joined once."""
    second = as_mtl(random_watch) if mtl else random_watch
    both = exposed.withColumn("task", F.lit(EXPOSED)).unionByName(second.withColumn("task", F.lit(RANDOM_WATCH)))
    return features.feature_rows(both, events, catalog, pop, state_pop, country, mtl=mtl, production_house=production_house, prepare=prepare)


def training_set(days: DataFrame, end: str, rate: float) -> DataFrame:
    """Multi-day rows: every exposed row, random-watch rows of a hash-chosen share of (user, day)."""
    draw = hash_uniform(["dw_p_id", "cd", F.lit(end)], "agg")
    return days.filter((F.col("flag") == EXPOSED) | ((F.col("flag") == RANDOM_WATCH) & (draw < rate)))


def training_stats(rows: DataFrame) -> DataFrame:
    """Rows, share and post-click rows per task."""
    label = F.col("click") if "click" in rows.columns else F.col("label")
    return aggregates.task_stats(rows.withColumn("click", label))


def cumwatch_training(feature_rows: DataFrame, watches: DataFrame, start: str, horizons: list[int]) -> DataFrame:
    """Cumulative-watch rows: features of a discovery day with item and user hours per horizon.

    ``day`` is the horizon's index from 0; ``user_hash`` groups a user's rows without the id.
    """
    labels = examples.horizon_labels(watches, start, horizons)
    rows = feature_rows.join(labels, ["dw_p_id", "content_id"])
    return rows.withColumn("day", (F.col("horizon") - 1).cast("int")).withColumn("user_hash", F.xxhash64("dw_p_id")).drop("horizon")
