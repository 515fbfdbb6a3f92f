"""Watch-time curves per title, kind and prior-watch group.

Curves are long: one row per (key, day) with summed ``watch`` seconds and exposed ``users``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranklens.functions.scalars import day_offset
from ranklens.operators.aggregates import cluster_bins
from ranklens.operators.examples import split_watches
from ranklens.operators.joins import assign_bin

PAIR = ["dw_p_id", "content_id"]


def discovery_matrix(watches: DataFrame, history: DataFrame, now: int, days: int = 30, min_first_day: int = 600) -> DataFrame:
    """Seconds per (user, title, day since the first watch), one row per day with a watch.

    ``history`` holds (dw_p_id, content_id, first_watch). A pair counts when its first watch is not
    later than the history's and day 0 reaches ``min_first_day`` seconds. ``complete`` is the number of
    days (at most days + 1) that are over; later watches are left out.
    """
    firsts = watches.groupBy(*PAIR).agg(F.min("first_watch_ts").alias("first_ts"))
    known = history.groupBy(*PAIR).agg(F.min("first_watch").alias("known_ts"))
    pairs = firsts.join(known, PAIR).filter(F.col("first_ts") <= F.col("known_ts"))
    complete = F.least(F.greatest(day_offset(F.lit(now), F.col("first_ts")), F.lit(0)), F.lit(days + 1))
    pairs = pairs.select(*PAIR, "first_ts", complete.alias("complete"))
    dayed = watches.join(pairs, PAIR).withColumn("day", day_offset(F.col("last_watch_ts"), F.col("first_ts")))
    dayed = dayed.filter((F.col("day") >= 0) & (F.col("day") < F.col("complete")))
    sums = dayed.groupBy(*PAIR, "first_ts", "complete", "day").agg(F.sum("watch_time").cast("bigint").alias("wt"))
    # a pair has at most days + 1 rows
    first_day = F.max(F.when(F.col("day") == 0, F.col("wt"))).over(Window.partitionBy(*PAIR))
    return sums.withColumn("__first", first_day).filter(F.col("__first") >= min_first_day).drop("__first")


def title_curve(matrix: DataFrame, days: int = 30) -> DataFrame:
    """(content_id, day, watch, users) for each day of each title of ``discovery_matrix``.

    Watch is summed per (title, day); exposure is counted per (title, complete days) first, so what is
    spread over the days is at most days + 1 rows per title.
    """
    zero = F.lit(0).cast("bigint")
    watch = matrix.groupBy("content_id", "day").agg(F.sum("wt").alias("watch")).select("content_id", "day", "watch", zero.alias("users"))
    exposed = matrix.filter(F.col("day") == 0).groupBy("content_id", "complete").agg(F.count(F.lit(1)).alias("users"))
    day = lambda upto: F.explode(F.sequence(F.lit(0).cast("bigint"), upto.cast("bigint"))).alias("day")
    users = exposed.select("content_id", day(F.col("complete") - 1), zero.alias("watch"), "users")
    axis = exposed.groupBy("content_id").agg(F.max("complete").alias("m")).select("content_id", day(F.lit(days)), zero.alias("watch"), zero.alias("users"))
    rows = watch.unionByName(users).unionByName(axis)
    return rows.groupBy("content_id", "day").agg(F.sum("watch").alias("watch"), F.sum("users").alias("users"))


def kind_curve(curve: DataFrame, catalog: DataFrame, effect: int = 14) -> DataFrame:
    """Show and movie curves with seconds per user and the total of the first ``effect`` days."""
    kind = F.when(F.col("content_type_id") == 100, "show").when(F.col("content_type_id") == 200, "movie")
    kinds = catalog.select("content_id", kind.alias("kind")).filter("kind is not null")
    sums = curve.join(kinds, "content_id").groupBy("kind", "day").agg(F.sum("watch").alias("watch"), F.sum("users").alias("users"))
    per_user = sums.withColumn("per_user", F.col("watch") / F.greatest("users", F.lit(1)))
    complete = F.sum(F.when(F.col("day") < effect, F.col("per_user"))).over(Window.partitionBy("kind"))
    return per_user.withColumn("complete", complete)


def _fold(days: Column, defaults: Column, min_users: int) -> Column:
    """Smoothed seconds per user and day, each with the running total up to it.

    A day with enough users keeps its own mean. A thin day 0 blends its mean with the default by the
    share of users it has. A thin later day continues the curve so far in the proportion of the
    default curve (0 while the default curve is still 0).
    """

    def step(acc, x):
        own = x["watch"] / F.greatest(x["users"], F.lit(1))
        base = F.coalesce(F.try_element_at(defaults, (x["day"] + 1).cast("int")), F.lit(0.0))
        share = x["users"] / F.lit(float(min_users))
        blended = share * own + (F.lit(1.0) - share) * base
        continued = F.when(acc["base"] != 0, acc["total"] * (base / acc["base"])).otherwise(0.0)
        value = F.when(x["users"] >= min_users, own).when(x["day"] == 0, blended).otherwise(continued)
        total = acc["total"] + value
        day = F.struct(value.alias("per_user"), total.alias("cumulative"))
        return F.struct(F.concat(acc["out"], F.array(day)).alias("out"), total.alias("total"), (acc["base"] + base).alias("base"))

    zero = F.struct(F.array().cast("array<struct<per_user:double,cumulative:double>>").alias("out"), F.lit(0.0).alias("total"), F.lit(0.0).alias("base"))
    return F.aggregate(days, zero, step)["out"]


def smooth(curve: DataFrame, keys: list[str], defaults: DataFrame, default_keys: list[str], min_users: int = 30) -> DataFrame:
    """Per-key curves smoothed by a default curve (``default_keys``, day, per_user): (keys, day, per_user, cumulative)."""
    own = curve.groupBy(*keys, *[k for k in default_keys if k not in keys]).agg(
        F.array_sort(F.collect_list(F.struct(F.col("day"), F.col("watch").cast("double").alias("watch"), F.col("users").cast("double").alias("users")))).alias("days"))
    base = defaults.groupBy(*default_keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("day", "per_user"))), lambda s: s["per_user"]).alias("defaults"))
    folded = own.join(base, default_keys, "left").withColumn(
        "values", _fold(F.col("days"), F.coalesce("defaults", F.array().cast("array<double>")), min_users))
    rows = folded.select(*keys, F.posexplode("values").alias("pos", "value"))
    return rows.select(*keys, F.col("pos").cast("bigint").alias("day"), "value.per_user", "value.cumulative")


def smooth_curve(curve: DataFrame, kinds: DataFrame, catalog: DataFrame, min_users: int = 30) -> DataFrame:
    """Title curves smoothed by the show curve for shows and the movie curve for everything else."""
    kind = F.when(F.col("content_type_id") == 100, "show").otherwise("movie")
    typed = curve.join(catalog.select("content_id", kind.alias("kind")), "content_id")
    return smooth(typed, ["content_id"], kinds, ["kind"], min_users)


def complete_watch(smoothed: DataFrame, effect: int = 14) -> DataFrame:
    return smoothed.groupBy("content_id").agg(F.sum(F.when(F.col("day") < effect, F.col("per_user"))).alias("complete_watch"))


def cumulative_events(daily: DataFrame, history: DataFrame, n: int, thr: int = 600, salt: str = "split") -> DataFrame:
    """Split daily watches with the seconds watched before the event: history plus the split offset."""
    sums = daily.groupBy(*PAIR).agg(F.sum("watch_time").alias("daily_watch_time"))
    past = history.groupBy(*PAIR).agg(F.sum("watch_len").alias("past"))
    splits = split_watches(sums, n, thr, salt).join(past, PAIR, "left")
    return splits.select(*PAIR, (F.coalesce("past", F.lit(0)) + F.col("before")).cast("bigint").alias("watched"), "wt_0", "is_sample")


def grouped_curves(events: DataFrame, watches: DataFrame, edges: DataFrame, days: int, span: int = 7) -> DataFrame:
    """Curves per (title, prior-watch group): (content_id, group, day, watch, users, num).

    ``events``: (dw_p_id, content_id, event_dt, watched, wt_0); ``watches``: daily rows with ``watch_dt``.
    Day 0 is the event's own watch; a day is exposed when it lies inside the observed ``days``.
    """
    grouped = events.join(edges, "content_id", "left").withColumn("group", assign_bin(F.col("watched"), F.col("edges")))
    grouped = grouped.select(*PAIR, "event_dt", "group", "wt_0")
    key = ["content_id", "group"]
    by_dt = grouped.groupBy(*key, "event_dt").agg(F.count(F.lit(1)).alias("n"), F.sum("wt_0").alias("wt_0"))
    exposed = by_dt.select(
        *key, F.explode(F.sequence(F.lit(0), F.lit(span - 1))).alias("day"), "n",
        (F.least(F.lit(days) - F.col("event_dt"), F.lit(span))).alias("seen"), "wt_0")
    base = exposed.groupBy(*key, "day").agg(
        F.sum(F.when(F.col("day") < F.col("seen"), F.col("n")).otherwise(0)).alias("users"),
        F.sum("n").alias("num"), F.sum(F.when(F.col("day") == 0, F.col("wt_0")).otherwise(0)).alias("first"))
    sums = watches.groupBy(*PAIR, "watch_dt").agg(F.sum("watch_time").alias("watch_time"))
    later = grouped.join(sums, PAIR).withColumn("day", F.col("watch_dt") - F.col("event_dt")).filter((F.col("day") > 0) & (F.col("day") < span))
    more = later.groupBy(*key, F.col("day").cast("int").alias("day")).agg(F.sum("watch_time").alias("later"))
    joined = base.join(more, [*key, "day"], "left")
    return joined.select(*key, F.col("day").cast("bigint").alias("day"),
                         (F.col("first") + F.coalesce("later", F.lit(0))).cast("bigint").alias("watch"),
                         F.col("users").cast("bigint").alias("users"), F.col("num").cast("bigint").alias("num"))


def bin_values(grouped: DataFrame, edges: DataFrame) -> DataFrame:
    """Grouped curves with the edge (seconds) of their group; 0 for group 0 of a title without edges."""
    edge = F.try_element_at("edges", F.col("group") + 1)
    return grouped.join(edges, "content_id", "left").withColumn("bin", F.when(edge.isNotNull(), edge).when(F.col("group") == 0, 0)).drop("edges")


def check_bins(grouped: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows of a group other than 0 that has no edge; an empty result means the bins are complete."""
    return bin_values(grouped, edges).filter(F.col("bin").isNull()).select("content_id", "group").distinct()


def binned_curves(grouped: DataFrame, edges: DataFrame, catalog: DataFrame) -> DataFrame:
    """Grouped curves with the edge of their group and the title's kind, the input of ``cluster_curves``."""
    return bin_values(grouped, edges).filter(F.col("bin").isNotNull()).join(catalog.select("content_id", "kind"), "content_id")


def cluster_curves(rows: DataFrame, max_bins: int = 20, min_users: int = 30) -> DataFrame:
    """Smoothed and cumulative curves per (title, group), thin ones backed by their kind's cluster.

    Clusters are greedy bins over the edges of all titles of a kind, weighted by events. ``rows`` are
    ``binned_curves`` (titles x groups x days); every step reads them, so a caller stages them.
    """
    mass = rows.filter(F.col("day") == 0).groupBy("kind", F.col("bin").alias("second")).agg(F.sum("num").alias("n"))
    clusters = cluster_bins(mass, "kind", max_bins).withColumnRenamed("edges", "cluster_edges")
    placed = rows.join(clusters, "kind").withColumn("cluster", assign_bin(F.col("bin"), F.col("cluster_edges")))
    defaults = placed.groupBy("kind", "cluster", "day").agg((F.sum("watch") / F.greatest(F.sum("users"), F.lit(1))).alias("per_user"))
    return smooth(placed, ["content_id", "group"], defaults, ["kind", "cluster"], min_users)
