"""Bandit evaluation end to end: train on closed days, score the next requests, compare the blends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklens.operators import aggregates, bandit, filters, joins, metrics

STRATEGIES = ("cumulative", "penalised", "reset")
SET = ["train_date", "strategy"]


def score_requests(train: DataFrame, requests: DataFrame, d: int, lam: float = 1.0, arm: str | None = None) -> DataFrame:
    """Requests with ``mean`` and ``sd`` from the state of ``train``, shared or per arm, masked labels left out."""
    labelled = requests.filter(F.col("click") != -1)
    if arm:
        return bandit.score_by_arm(labelled, bandit.solve_state(bandit.gram_by_arm(train, lam, arm), "arm"), lam, arm)
    return bandit.score_shared(labelled, bandit.solve_state(bandit.gram(train, d, lam)), lam)


def standardised(scored: DataFrame, tags: DataFrame, item: str = "content_id") -> DataFrame:
    """Scores of each (train date, strategy) with a popularity category, complete rows only, standardised within the set."""
    one = tags.withColumn("__order", F.col("popularity_tag"))
    tagged = joins.lookup(scored, one, item, "popularity_tag", "Unmapped", "__order").withColumnRenamed("popularity_tag", "category")
    return aggregates.zscore(filters.drop_incomplete(tagged), ["base", "sd", "mean"], SET)


def compare(scored: dict[tuple[str, str], DataFrame], tags: DataFrame, item: str = "content_id") -> DataFrame:
    """Standardised score sets of several (train date, matrix strategy) pairs, ready for ``experiment``."""
    named = [df.withColumns({"train_date": F.lit(date), "strategy": F.lit(strategy)}) for (date, strategy), df in scored.items()]
    return standardised(reduce(DataFrame.unionByName, named), tags, item)


def progressive(act: DataFrame, tags: DataFrame, lam: float = 1.0, gamma: float = 0.95, strategies=STRATEGIES, item: str = "content_id") -> DataFrame:
    """Every day scored by the state of the day before, under each way of combining days.

    ``act`` holds (day, h, click, base, ...); days are numbered without gaps. The increments of all
    days are one grouped Gram; a strategy's states of all days are solved side by side, and each row
    meets the state of its day before.
    """
    daily = bandit.gram_by_arm(act, 0.0, "day").withColumnRenamed("arm", "day")
    first = act.agg(F.min("day")).scalar()
    rows = act.filter((F.col("click") != -1) & (F.col("day") > first)).withColumn("train_date", (F.col("day") - 1).cast("string"))
    day = act.schema["day"].dataType.simpleString()
    before = rows.withColumn("__before", (F.col("day") - 1).cast(day))
    sets = []
    for name in strategies:
        states = bandit.combine_days(daily, name, gamma, lam).withColumnRenamed("day", "arm")
        scored = bandit.score_by_arm(before, bandit.solve_state(states, "arm"), lam, "__before", floor=0.0)
        sets.append(scored.drop("__before").withColumn("strategy", F.lit(name)))
    return standardised(reduce(DataFrame.unionByName, sets), tags, item)


def experiment(standard: DataFrame, by: list[str], label: str = "click", item: str = "content_id", digits: int | None = None) -> DataFrame:
    """Experiment table of all blends for each (train date, strategy); every metric reads ``standard``, so stage it first.

    ``digits`` rounds the blended scores, so that scores equal but for rounding tie.
    """
    rows = metrics.blend(standard)
    if digits is not None:
        rows = rows.withColumn("score", F.round("score", digits))
    return metrics.experiment_table(rows, by, "score", label, "category", item)
