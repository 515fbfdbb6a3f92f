"""Joins with semantics a plain equi join does not give: as-of, versioned, binned, anti-membership.

No join carries a broadcast hint. The as-of and version joins, of which a job has dozens, are merge joins, since
the driver holds every broadcast side of a plan; adaptive execution splits skewed partitions, and elsewhere
broadcasts a side when its measured size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def asof_strict(left: DataFrame, right: DataFrame, by: list[str], ts: str, right_ts: str | None = None,
                tie: list[str] = (), keep_unmatched: bool = False, width: int = 3600) -> DataFrame:
    """Each left row with the latest right row strictly before it, per key.

    Right columns (other than the key) keep their names and must not clash with left ones. Time is
    cut into slices of ``width`` seconds: the window runs inside (key, slice), and the last right row
    of earlier slices is carried in from one row per (key, slice), so a heavy key spreads over tasks.
    """
    right_ts = right_ts or ts
    left_cols, right_cols = left.columns, [c for c in right.columns if c not in by]
    slice_l = F.floor(F.col(ts) / width).cast("bigint").alias("__slice")
    slice_r = F.floor(F.col(right_ts) / width).cast("bigint").alias("__slice")
    l_row, r_row = F.struct(*left_cols), F.struct(F.col(right_ts).alias("__t"), *tie, *[c for c in right_cols if c not in tie])
    r_type = right.select(r_row.alias("r")).schema["r"].dataType
    l_type = left.select(l_row.alias("l")).schema["l"].dataType

    lefts = left.select(*by, slice_l, F.col(ts).alias("__ts"), F.lit(0).alias("__side"),
                        l_row.alias("__l"), F.lit(None).cast(r_type).alias("__r"))
    rights = right.select(*by, slice_r, F.col(right_ts).alias("__ts"), F.lit(1).alias("__side"),
                          F.lit(None).cast(l_type).alias("__l"), r_row.alias("__r"))

    inside = Window.partitionBy(*by, "__slice").orderBy(
        "__ts", "__side", *[F.col("__r")[c] for c in tie]).rowsBetween(Window.unboundedPreceding, -1)
    within = lefts.unionByName(rights).withColumn("__in", F.last("__r", ignorenulls=True).over(inside)).filter("__side = 0")

    order = F.struct(F.col("__ts"), *[F.col("__r")[c] for c in tie])
    last_per_slice = rights.groupBy(*by, "__slice").agg(F.max_by("__r", order).alias("__r"))
    slices = last_per_slice.unionByName(
        lefts.select(*by, "__slice").distinct().withColumn("__r", F.lit(None).cast(r_type)))
    per_slice = slices.groupBy(*by, "__slice").agg(F.first("__r", ignorenulls=True).alias("__r"))
    before = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_slice.select(*by, "__slice", F.last("__r", ignorenulls=True).over(before).alias("__carry"))

    found = within.join(carry.hint("merge"), [*by, "__slice"], "left").withColumn("__hit", F.coalesce("__in", "__carry"))
    if not keep_unmatched:
        found = found.filter(F.col("__hit").isNotNull())
    return found.select(*[F.col(f"__l.{c}").alias(c) for c in left_cols], *[F.col(f"__hit.{c}").alias(c) for c in right_cols])


def resolve_version(df: DataFrame, dim: DataFrame, version: str = "version", on_gap: str = "error") -> DataFrame:
    """``resolved``: the asked version, or the newest / oldest one when it lies outside the range.

    A version inside the range that does not exist raises an error, or resolves to null with
    ``on_gap='null'``. An empty dimension resolves to null.
    """
    bounds = dim.agg(F.struct(F.max(version).alias("hi"), F.min(version).alias("lo")))
    hi, lo = F.col("__v.hi"), F.col("__v.lo")
    clamped = df.withColumn("__v", bounds.scalar()).withColumn(
        "resolved", F.when(F.col(version) > hi, hi).when(F.col(version) < lo, lo).otherwise(F.col(version)))
    # a handful of versions: read as one array, no join on a few values
    known = dim.agg(F.collect_set(version).alias("k")).scalar()
    checked = clamped.withColumn("__all", known).withColumn("__known", F.when(F.array_contains("__all", F.col("resolved")), True)).drop("__all")
    gap = F.col("__known").isNull() & F.col(version).isNotNull() & lo.isNotNull()
    resolved = F.when(F.col("__known"), F.col("resolved"))
    if on_gap == "error":
        message = F.concat(F.lit("no matched version for "), F.col(version).cast("string"))
        resolved = F.when(gap, F.raise_error(message).cast(df.schema[version].dataType)).otherwise(resolved)
    return checked.withColumn("resolved", resolved).drop("__known", "__v")


def join_version(df: DataFrame, dim: DataFrame, keys: list[str], version: str = "version", on_gap: str = "error") -> DataFrame:
    """Left join to the dimension rows of the resolved version."""
    resolved = resolve_version(df, dim, version, on_gap)
    return resolved.join(dim.withColumnRenamed(version, "resolved").hint("merge"), ["resolved", *keys], "left")


def assign_bin(x: Column, edges: Column) -> Column:
    """Index of the first edge at or above x, clamped to the last bin; 0 without edges."""
    below = F.size(F.filter(edges, lambda e: e < x))
    return F.coalesce(F.least(below, F.size(edges) - 1), F.lit(0)).cast("int")


def past_watch(watches: DataFrame, latest: DataFrame, history: DataFrame) -> DataFrame:
    """Adds ``past_wt``: earlier seconds on the title, 0 when never seen, -1 when seen without time.

    ``latest`` holds (dw_p_id, content_id) rows, ``history`` the past watch rows.
    """
    keys = ["dw_p_id", "content_id"]
    seen = latest.select(*keys, F.lit(0).cast("bigint").alias("wt")).unionByName(
        history.select(*keys, F.col("watch_len").cast("bigint").alias("wt")))
    totals = seen.groupBy(*keys).agg(F.sum("wt").alias("__wt"))
    past = F.when(F.col("__wt") > 0, F.col("__wt")).when(F.col("__wt").isNotNull(), -1).otherwise(0)
    return watches.join(totals, keys, "left").withColumn("past_wt", past.cast("bigint")).drop("__wt")


def is_new_watch(watches: DataFrame, latest: DataFrame, history: DataFrame) -> DataFrame:
    """Watches whose title is neither in the latest ids nor in the history."""
    keys = ["dw_p_id", "content_id"]
    return watches.join(latest.select(*keys).unionByName(history.select(*keys)), keys, "left_anti")


def without_seen(pred: Column, seen: Column) -> Column:
    """Predicted ids minus seen ids, in order; repeated ids collapse."""
    return F.array_except(pred, F.coalesce(seen, F.array().cast("array<bigint>")))


def qualify(df: DataFrame, by: list[str], having: Column) -> DataFrame:
    """Rows of the groups that satisfy an aggregate condition."""
    groups = df.groupBy(*by).agg(having.alias("__ok")).filter("__ok").select(*by)
    return df.join(groups, by, "left_semi")


def lookup(df: DataFrame, dim: DataFrame, key: str, value: str, default, order: str) -> DataFrame:
    """Left join to one value per key (lowest ``order`` wins) with a default for unmapped keys."""
    one = dim.groupBy(key).agg(F.min_by(value, order).alias(value))
    return df.join(one, key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def active_users(*logs: DataFrame, key: str = "dw_p_id") -> DataFrame:
    """Distinct users of several logs; each log is reduced before the union."""
    out = None
    for log in logs:
        ids = log.select(key).distinct()
        out = ids if out is None else out.unionByName(ids)
    return out.distinct()


def map_identity(df: DataFrame, mapping: DataFrame, key: str = "dw_p_id", target: str = "profile_id") -> DataFrame:
    return df.join(mapping.select(key, target), key, "left")


def coverage(mapped: DataFrame, target: str = "profile_id") -> DataFrame:
    return mapped.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(target).isNotNull()).alias("mapped"),
        F.count_if(F.col(target).isNull()).alias("unmapped"),
    )


def watch_relevance(watches: DataFrame, relevances: DataFrame) -> DataFrame:
    """Watches times item-to-item relevances on (content, language)."""
    rel = relevances.withColumnsRenamed({"src": "content_id", "src_lang": "language", "score": "relevance"})
    return watches.join(rel, ["content_id", "language"])


def dealt_by_target(joined: DataFrame, parts: int = 256) -> DataFrame:
    """Rows of ``watch_relevance`` dealt by (user, target), for sums over them.

    A few watched titles may make very many rows in few join tasks; dealt on as they come, none of these
    tasks holds a table of sums of its own. ``parts`` is fixed, since such rows are small once compressed
    and adaptive execution, which goes by their bytes, would put too many into one task.
    """
    return joined.repartition(parts, "dw_p_id", "dst", "dst_lang")


def missing_fids(df: DataFrame, embeddings: DataFrame, fids: str = "fids", key: str = "fid") -> DataFrame:
    """Feature ids without an embedding row, with the number of uses."""
    used = df.select(F.explode(fids).alias(key)).groupBy(key).agg(F.count(F.lit(1)).alias("uses"))
    return used.join(embeddings.select(key), key, "left_anti")
