"""Weekly popularity tiers and new releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranklens.functions.scalars import TIER_CUTS, tier
from ranklens.operators.filters import clean_titles

NEW_RELEASE = "Current Week New Releases"  # fixed value: tag text


def first_availability(titles: DataFrame, until: str) -> DataFrame:
    """First date each clean title was available, on or before a date."""
    rows = clean_titles(titles).filter(F.col("fromdate") <= F.lit(until).cast("date"))
    return rows.groupBy("show_content_id").agg(F.min("fromdate").alias("fromdate"))


def weekly_viewers(watches: DataFrame, avail: DataFrame, start: str, end: str) -> DataFrame:
    """Distinct viewers per title, and over all titles (the row with ``is_total`` 1).

    Pairs are reduced to distinct (title, user) first, so both levels count from the small set.
    """
    span = F.col("cd").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    rows = watches.filter(span & (F.col("category") != "sports") & (F.col("watch_minutes") > 0))
    pairs = rows.join(avail.select(F.col("show_content_id").alias("sub_title_id")), "sub_title_id", "left_semi").select("sub_title_id", "dw_p_id").distinct()
    per_title = pairs.groupBy("sub_title_id").agg(F.count(F.lit(1)).alias("viewers"), F.lit(0).alias("is_total"))
    users = pairs.select("dw_p_id").distinct().agg(F.count(F.lit(1)).alias("viewers"))
    total = users.select(F.lit(None).cast(pairs.schema["sub_title_id"].dataType).alias("sub_title_id"), "viewers", F.lit(1).alias("is_total"))
    return per_title.unionByName(total)


#: Viewers of a title in a bucket of 32768 users up to which their places are kept as a list, not as a bitmap.
FEW = 256
_SLICES = 4096


def number_users(users: DataFrame, known: DataFrame | None = None, user: str = "dw_p_id") -> DataFrame:
    """(user, number) of the users that ``known`` does not hold yet, numbered on from its largest, without gaps.

    A day adds its new users to the stored numbers, which never change. Null users get none. New users are
    ordered by a hash cut into slices, so no task orders them all.
    """
    new = users.select(user).filter(F.col(user).isNotNull()).distinct()
    start = F.lit(0)
    if known is not None:
        new = new.join(known.select(user), user, "left_anti")
        start = F.coalesce(known.agg(F.max("number")).scalar(), F.lit(0))
    cut = new.withColumn("__slice", F.pmod(F.xxhash64(user), F.lit(_SLICES)))
    sizes = cut.groupBy("__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("__slice").orderBy(user))
    placed = cut.withColumn("__at", within).join(sizes.select("__slice", before.alias("__before")), "__slice")
    return placed.select(user, (start + F.col("__before") + F.col("__at")).cast("long").alias("number"))


def day_viewers(watches: DataFrame, numbers: DataFrame) -> DataFrame:
    """Viewers of each title and day that count, as exact sets of user numbers: (cd, sub_title_id, bucket, few, bits).

    A bucket is 32768 consecutive numbers. A set is a bitmap, or the list of its places where that is
    shorter. Every user of ``watches`` needs a number. A day is kept once and never read from the log again.
    """
    rows = watches.filter((F.col("category") != "sports") & (F.col("watch_minutes") > 0)).select("cd", "sub_title_id", "dw_p_id").distinct()
    rows = rows.join(numbers, "dw_p_id")
    keys = ["cd", "sub_title_id", "bucket"]
    placed = rows.select("cd", "sub_title_id", F.bitmap_bucket_number("number").alias("bucket"), F.bitmap_bit_position("number").cast("smallint").alias("at"))
    lists = placed.groupBy(*keys).agg(F.collect_list("at").alias("few"))  # 32768 places at most
    small = F.size("few") <= FEW
    many = lists.filter(~small).select(*keys, F.explode("few").alias("at")).groupBy(*keys).agg(F.bitmap_construct_agg(F.col("at").cast("long")).alias("bits"))
    return lists.filter(small).withColumn("bits", F.lit(None).cast("binary")).unionByName(many.withColumn("few", F.lit(None).cast("array<smallint>")))


def viewers_of_days(days: DataFrame, avail: DataFrame, start: str, end: str) -> DataFrame:
    """``weekly_viewers`` from the sets of single days: united per title, then over all titles, and counted."""
    span = F.col("cd").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    titles = avail.select(F.col("show_content_id").alias("sub_title_id"))
    rows = days.filter(span).join(titles, "sub_title_id", "left_semi")
    listed = rows.filter(F.col("few").isNotNull()).select("sub_title_id", "bucket", F.explode("few").alias("at"))
    listed = listed.groupBy("sub_title_id", "bucket").agg(F.bitmap_construct_agg(F.col("at").cast("long")).alias("bits"))
    sets = listed.unionByName(rows.filter(F.col("bits").isNotNull()).select("sub_title_id", "bucket", "bits"))
    per_bucket = sets.groupBy("sub_title_id", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    per_title = per_bucket.groupBy("sub_title_id").agg(F.sum(F.bitmap_count("bits")).alias("viewers"), F.lit(0).alias("is_total"))
    total = per_bucket.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits")).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("viewers"))
    none = F.lit(None).cast(days.schema["sub_title_id"].dataType)
    return per_title.unionByName(total.select(none.alias("sub_title_id"), "viewers", F.lit(1).alias("is_total")))


def viewers(df: DataFrame, title: str = "sub_title_id", user: str = "dw_p_id") -> DataFrame:
    """Grouping-sets form: distinct users per title and overall, told apart by ``is_total``."""
    return df.groupingSets([[title], []], title).agg(
        F.count_distinct(user).alias("viewers"), F.grouping_id().cast("int").alias("is_total"))


def with_total(per_title: DataFrame) -> DataFrame:
    """Title rows with the platform total beside them (a scalar subquery, no join)."""
    total = per_title.filter("is_total = 1").agg(F.max("viewers")).scalar()
    return per_title.filter("is_total = 0").withColumn("platform_viewers", total).drop("is_total")


def popularity_tiers(per_title: DataFrame, start: str, end: str, cuts=TIER_CUTS) -> DataFrame:
    """Viewer share in percent, tier, and the week the tier applies to."""
    share = F.col("viewers") * F.lit(100.0) / F.col("platform_viewers")
    rows = with_total(per_title).withColumn("share", share)
    day = lambda d, n: F.date_add(F.lit(d).cast("date"), n)
    return rows.select("sub_title_id", "viewers", "platform_viewers", "share", tier(F.col("share"), cuts).alias("popularity_tag"),
                       day(start, 0).alias("week_start"), day(end, 0).alias("week_end"),
                       day(start, 7).alias("target_week_start"), day(end, 7).alias("target_week_end"))


def new_releases(titles: DataFrame, start: str, end: str) -> DataFrame:
    """Clean titles that have an availability date inside the target week, with the first such date."""
    span = F.col("fromdate").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    rows = clean_titles(titles).filter(span).groupBy("show_content_id").agg(F.min("fromdate").alias("fromdate"))
    return rows.withColumn("new_tag", F.lit(NEW_RELEASE))


def merge_tags(tiers: DataFrame, new: DataFrame) -> DataFrame:
    """One tag per title: High, Medium and Low win over the new-release tag, which wins over the rest."""
    joined = tiers.select("sub_title_id", "popularity_tag").join(
        new.select(F.col("show_content_id").alias("sub_title_id"), "new_tag"), "sub_title_id", "full")
    strong = F.col("popularity_tag").isin("High", "Medium", "Low")
    return joined.select("sub_title_id", F.when(strong, F.col("popularity_tag")).otherwise(F.coalesce("new_tag", "popularity_tag")).alias("tag"))
