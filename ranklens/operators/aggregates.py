"""Aggregations: nesting, histograms, greedy bins, profiles, standardisation, describe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranklens.operators.keyed import prefix_sums


def nest(df: DataFrame, key: str, cols: list[str], as_: str, time: str = "timestamp") -> DataFrame:
    """List of structs per (key, day), in the order of ``time`` and the other columns.

    The rule is the same for every user: a list holds one day of events.
    """
    order = [time, *[c for c in cols if c != time]]
    day = F.floor(F.col(time) / 86400).cast("bigint").alias("day")
    events = F.array_sort(F.collect_list(F.struct(*order)))
    return df.groupBy(key, day).agg(F.transform(events, lambda e: F.struct(*[e[c].alias(c) for c in cols])).alias(as_))


def agg_watch(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """Named aggregates by keys, merged on the map side."""
    return df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])


def distinct_items(df: DataFrame, by: list[str], item: str = "content_id") -> DataFrame:
    """Exact number of distinct items per group."""
    return df.select(*by, item).distinct().groupBy(*by).agg(F.count(item).alias("items"))


#: Registers of a distinct-count sketch, as a power of two; the standard error is about 1.04 / sqrt(2 ** this) (0.8 %).
SKETCH_BITS = 14


def item_sketches(df: DataFrame, by: list[str], item: str = "content_id", bits: int = SKETCH_BITS) -> DataFrame:
    """A mergeable sketch of the distinct items per group: keep one per day, and any span of days is a merge.

    For counts that may be off by a stated error; ``distinct_items`` is exact. Null items do not count.
    """
    return df.groupBy(*by).agg(F.hll_sketch_agg(item, bits).alias("sketch"))


def merge_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches united per group; the groups may be coarser than those they were made for."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))


def sketched_items(sketches: DataFrame) -> DataFrame:
    """Sketches read as estimated numbers of distinct items."""
    return sketches.withColumn("items", F.hll_sketch_estimate("sketch")).drop("sketch")


def sum_days(df: DataFrame, key: str, arrays: list[str], days: int) -> DataFrame:
    """One sum per array column and day: ``<array>_<day>``."""
    return df.groupBy(key).agg(*[F.sum(F.get(a, F.lit(i))).alias(f"{a}_{i}") for a in arrays for i in range(days)])


def minute_hist(df: DataFrame, key: str, seconds: str) -> DataFrame:
    """Rows per key and started minute, positive times only."""
    minute = F.ceil(F.col(seconds) / 60).cast("bigint").alias("minute")
    return df.filter(F.col(seconds) > 0).groupBy(key, minute).agg(F.count(F.lit(1)).alias("n"))


def _greedy(sorted_pairs: Column, start: list[int], per_bin: Column, early=None, scale: int = 1) -> Column:
    """Fold over (value, n): close a bin once its count reaches ``per_bin``, noting value * scale."""

    def step(acc, x):
        filled = acc["filled"] + x["n"]
        close = filled >= per_bin
        if early is not None:
            close = close | early(x["value"], filled)
        edges = F.when(close, F.concat(acc["edges"], F.array(x["value"] * F.lit(scale)))).otherwise(acc["edges"])
        return F.struct(edges.alias("edges"), F.when(close, F.lit(0).cast("bigint")).otherwise(filled).alias("filled"))

    zero = F.struct(F.array(*[F.lit(e).cast("bigint") for e in start]).alias("edges"), F.lit(0).cast("bigint").alias("filled"))
    return F.aggregate(sorted_pairs, zero, step)["edges"]


def freq_bins(hist: DataFrame, key: str, max_bins: int = 20, min_per_bin: int = 100) -> DataFrame:
    """Equal-frequency right edges in seconds per key, from a minute histogram.

    The list folded per key has one entry per watched minute, so it is bounded by run time, not rows.
    """
    pairs = F.array_sort(F.collect_list(F.struct(F.col("minute").alias("value"), F.col("n").alias("n"))))
    grouped = hist.groupBy(key).agg(F.sum("n").alias("total"), pairs.alias("pairs"))
    bins = F.greatest(F.least(F.floor(F.col("total") / min_per_bin), F.lit(max_bins - 1)), F.lit(1))
    sized = grouped.withColumn("per_bin", F.floor(F.col("total") / bins).cast("bigint"))
    early = lambda minute, filled: (minute == 1) & (filled >= min_per_bin)
    edges = _greedy(F.col("pairs"), [0], F.col("per_bin"), early, 60)
    return sized.select(key, F.slice(edges, 1, max_bins).alias("edges"))


def cluster_bins(mass: DataFrame, kind: str = "kind", max_bins: int = 20) -> DataFrame:
    """Edges per kind from (second, n) mass: 0 and 60 fixed, then greedy over seconds above 60."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col("second").cast("bigint").alias("value"), F.col("n").cast("bigint").alias("n"))))
    grouped = mass.groupBy(kind, "second").agg(F.sum("n").alias("n"))
    late = grouped.filter(F.col("second") > 60).groupBy(kind).agg(F.sum("n").alias("total"), pairs.alias("pairs"))
    sized = grouped.select(kind).distinct().join(late, kind, "left").withColumn(
        "per_bin", F.floor(F.coalesce("total", F.lit(0)) / (max_bins - 2)).cast("bigint"))
    empty = F.array().cast("array<struct<value:bigint,n:bigint>>")
    edges = _greedy(F.coalesce("pairs", empty), [0, 60], F.col("per_bin"))
    return sized.select(kind, F.slice(edges, 1, max_bins).alias("edges"))


def task_stats(df: DataFrame) -> DataFrame:
    """Rows, share and post-click rows per task, from one aggregation."""
    per_task = df.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("click") > 0).alias("post_click"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return per_task.withColumn("share", F.col("n") / total)


def task_counters(tasks: list, task: str = "task", click: str = "click") -> dict[str, Column]:
    """Aggregates of all rows that hold the counts of ``task_stats`` for known tasks, for a writing pass."""
    out = {"n": F.count(F.lit(1))}
    for t in tasks:
        out[f"n_{t}"] = F.count_if(F.col(task) == t)
        out[f"post_click_{t}"] = F.count_if((F.col(task) == t) & (F.col(click) > 0))
    return out


def task_rows(facts: dict, tasks: list) -> list[tuple]:
    """(task, n, post_click, share) of the tasks with rows, from the values of ``task_counters``."""
    return [(t, facts[f"n_{t}"], facts[f"post_click_{t}"], facts[f"n_{t}"] / facts["n"]) for t in tasks if facts[f"n_{t}"]]


def example_counters(kinds: list[str]) -> dict[str, Column]:
    """Users in all, and examples and users per kind, over one row per user with a count per kind.

    A null count (user without that kind) is 0.
    """
    size = lambda k: F.coalesce(F.col(k), F.lit(0))
    return {
        "users": F.count(F.lit(1)),
        **{f"{k}_examples": F.coalesce(F.sum(size(k)), F.lit(0)).cast("bigint") for k in kinds},
        **{f"{k}_users": F.count_if(size(k) > 0) for k in kinds},
    }


def example_stats(counts: DataFrame, kinds: list[str]) -> DataFrame:
    """``example_counters`` of a table that is not written."""
    return counts.agg(*[c.alias(n) for n, c in example_counters(kinds).items()])


PROFILE_SCALARS = ["studio_id", "parental_rating", "content_type_id", "year_bucket", "production_house_id"]


def profile(watches: DataFrame, catalog: DataFrame, key: list[str], weight: str = "weight", extra: list[str] = ()) -> DataFrame:
    """Share of watch weight per attribute value: (key, attr, value, share).

    ``catalog`` holds the scalar attributes and ``genre_ids``. An attribute whose weights sum to 0
    has no rows. All attributes come from one pass through a long (attr, value) form. ``extra`` names
    attributes that the watches carry themselves.
    """
    scalars = [c for c in PROFILE_SCALARS if c in catalog.columns]
    pairs = [F.struct(F.lit(c).alias("attr"), F.col(c).cast("string").alias("value")) for c in [*scalars, *extra]]
    genres = F.transform("genre_ids", lambda g: F.struct(F.lit("genre").alias("attr"), g.cast("string").alias("value")))
    rows = watches.join(catalog.select("content_id", *scalars, "genre_ids").hint("merge"), "content_id").select(
        *key, F.col(weight).alias("w"), F.inline(F.concat(F.array(*pairs), genres)))
    summed = rows.groupBy(*key, "attr", "value").agg(F.sum("w").alias("w"))
    total = F.sum("w").over(Window.partitionBy(*key, "attr"))
    return summed.withColumn("t", total).filter(F.col("t") != 0).select(*key, "attr", "value", (F.col("w") / F.col("t")).alias("share"))


def zscore(df: DataFrame, cols: list[str], by: list[str] = ()) -> DataFrame:
    """Columns standardised by mean and sample standard deviation, over all rows or per group.

    A constant column (or a single row) is 0 everywhere. The moments are one aggregation; over all
    rows they are read as a single scalar-subquery column, per group by a join of one row per group.
    """
    moments = df.groupBy(*by).agg(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(f"__{c}") for c in cols])
    packed = moments.select(*by, F.struct(*[F.col(f"__{c}").alias(c) for c in cols]).alias("__z"))
    rows = df.join(packed.hint("merge"), list(by)) if by else df.withColumn("__z", packed.scalar())
    scaled = lambda c: F.coalesce(F.try_divide(F.col(c) - F.col(f"__z.{c}.m"), F.col(f"__z.{c}.s")), F.when(F.col(c).isNotNull(), 0.0))
    return rows.withColumns({c: scaled(c) for c in cols}).drop("__z")


def rescale(df: DataFrame, source: str, target: str, out: str) -> DataFrame:
    """``source`` moved to the mean and standard deviation of ``target``; a constant source goes to the mean."""
    moments = df.agg(F.struct(F.avg(source).alias("ms"), F.stddev_samp(source).alias("ss"),
                              F.avg(target).alias("mt"), F.stddev_samp(target).alias("st")))
    rows = df.withColumn("__z", moments.scalar())
    z = F.coalesce(F.try_divide(F.col(source) - F.col("__z.ms"), F.col("__z.ss")), F.when(F.col(source).isNotNull(), 0.0))
    return rows.withColumn(out, z * F.col("__z.st") + F.col("__z.mt")).drop("__z")


def quantiles(df: DataFrame, by: list[str], x: str, probs: list[float]) -> DataFrame:
    """Exact interpolated quantiles per group: columns ``q0, q1, ...``.

    Works on the histogram of values with running counts, so no group is held in one task.
    """
    hist = df.filter(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("__n"))
    rows = prefix_sums(hist, by, x, {"__p": F.col("__n")}).withColumnRenamed("__p_total", "__t")

    def at(position):
        inside = (F.col("__p") <= position) & (position < F.col("__p") + F.col("__n"))
        return F.max(F.when(inside, F.col(x)))

    out = []
    for i, p in enumerate(probs):
        pos = (F.col("__t") - 1) * F.lit(p)
        out += [at(F.floor(pos)).alias(f"__lo{i}"), at(F.ceil(pos)).alias(f"__hi{i}"),
                F.max(pos - F.floor(pos)).alias(f"__f{i}")]
    picked = rows.groupBy(*by).agg(*out)
    return picked.select(*by, *[
        (F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * F.col(f"__f{i}")).alias(f"q{i}")
        for i in range(len(probs))])


def describe_by(df: DataFrame, category: str, x: str) -> DataFrame:
    """Count, mean, sample sd, min, quartiles and max of x per category."""
    basic = df.groupBy(category).agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                                     F.min(x).alias("min"), F.max(x).alias("max"))
    q = quantiles(df, [category], x, [0.25, 0.5, 0.75])
    q = q.select(F.col(category).alias("__c"), F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75"))
    return basic.join(q, F.col(category).eqNullSafe(F.col("__c")), "left").drop("__c")


def label_mix(df: DataFrame, category: str, label: str) -> DataFrame:
    """Rows per (label, category) and their share of the label."""
    counts = df.groupBy(label, category).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(label)))


def request_sizes(df: DataFrame, by: list[str]) -> DataFrame:
    """Deciles of rows per request: columns q0 (min) to q10 (max)."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return quantiles(sizes, [], "n", [i / 10 for i in range(11)])


def result_counters(items: str = "items") -> dict[str, Column]:
    """Predicted users, users with an empty list, and results in total."""
    return {
        "predicted": F.count(F.lit(1)),
        "empty": F.count_if(F.size(items) == 0),
        "total": F.coalesce(F.sum(F.size(items)), F.lit(0)).cast("bigint"),
    }


def counters(results: DataFrame, items: str = "items") -> DataFrame:
    """``result_counters`` of a table that is not written."""
    return results.agg(*[c.alias(n) for n, c in result_counters(items).items()])


def last_by(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order, value)).alias(value))


def corr(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.corr(a, b).alias("corr"))


def hist(df: DataFrame, x: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Rows per equal-width bucket; 0 and bins + 1 hold the values outside."""
    return df.groupBy(F.width_bucket(F.col(x), F.lit(lo), F.lit(hi), F.lit(bins)).cast("bigint").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"))
