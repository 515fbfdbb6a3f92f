"""Row filters and label masks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Content type codes and the block list of test titles.
TYPE_SHOW, TYPE_MOVIE = 100, 200
SPORT_LIVE, SPORT_REPLAY, NEWS_CLIP = 301, 303, 401
SPORTS_GENRES = [19, 21, 25, 26, 27, 29, 30, 31, 32, 33, 34, 39, 44, 45, 49, 50, 54, 55]
BLOCKED_TITLES = ["test", "not to use", "SG_TEST4", "Test Multiplex", "KH Test",
                  "HES_Test_Movie_01_23Nov2020", "DONOT USE", "SG_TEST2", "DO NOT USE"]


def is_reco_tray(full_id: Column, exact: list[str] = (), prefixes: list[str] = ()) -> Column:
    """True for the exact tray ids or any id that starts with one of the prefixes."""
    tests = [full_id.isin(list(exact))] if exact else []
    tests += [full_id.startswith(p) for p in prefixes]
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def adds_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("action") == 1)


def safe_id(col: Column) -> Column:
    """Content id as a number; unparsable ids and 0 become null."""
    number = col.try_cast("bigint")
    return F.when(number != 0, number)


def valid_events(df: DataFrame, country: str) -> DataFrame:
    """Request events of one country with a non-empty payload."""
    return df.filter((F.col("country") == country) & (F.length("payload") > 0))


def alive(df: DataFrame, catalog: DataFrame, key: str = "content_id") -> DataFrame:
    """Rows whose title is a type-200 movie or a show, neither deleted nor hidden."""
    return df.join(alive_ids(catalog).withColumnRenamed("content_id", key), key, "left_semi")


def alive_ids(catalog: DataFrame) -> DataFrame:
    kept = (F.col("kind") == "show") | ((F.col("kind") == "movie") & (F.col("content_type_id") == TYPE_MOVIE))
    return catalog.filter(kept & ~F.col("deleted") & ~F.col("hidden")).select("content_id")


def dropped_targets(df: DataFrame, catalog: DataFrame, key: str = "content_id") -> DataFrame:
    """Report of ids that ``alive`` drops, with row counts."""
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counted.join(alive_ids(catalog).withColumnRenamed("content_id", key), key, "left_anti")


def released(df: DataFrame, catalog: DataFrame, ts: str, key: str = "content_id") -> DataFrame:
    """Rows whose title was out at ``ts``; shows need a positive start time."""
    out = catalog.select(F.col("content_id").alias(key), F.col("kind").alias("__kind"), F.col("start_dt").alias("__start"))
    gate = (F.col("__start") <= F.col(ts)) & ((F.col("__kind") != "show") | (F.col("__start") > 0))
    return df.join(out, key).filter(gate).drop("__kind", "__start")


def new_published(catalog: DataFrame, now: int, days: int = 7) -> DataFrame:
    """Movies and shows of the main types that start between now - days and now + 1 day, exclusive."""
    right_type = ((F.col("kind") == "movie") & (F.col("content_type_id") == TYPE_MOVIE)) | (
        (F.col("kind") == "show") & (F.col("content_type_id") == TYPE_SHOW))
    return catalog.filter(right_type & (F.col("start_dt") > now - days * 86400) & (F.col("start_dt") < now + 86400))


def sports_content(catalog: DataFrame, now: int, look_back_days: int = 90, genres=SPORTS_GENRES) -> DataFrame:
    """(content, language) of sports titles inside the look-back window.

    Movies start within [now - window, now]; shows were last broadcast inside it and had begun.
    """
    edge = now - look_back_days * 86400
    sports = F.arrays_overlap("genre_ids", F.array(*[F.lit(g).cast("int") for g in genres]))
    movie = (F.col("content_type_id") == TYPE_MOVIE) & (F.col("kind") == "movie") & F.col("start_dt").between(edge, now)
    show = (F.col("kind") == "show") & (F.col("last_broadcast") >= edge) & (F.col("first_broadcast") <= now)
    return catalog.filter(sports & (movie | show)).select("content_id", "kind", F.explode("language_ids").alias("language_id"))


def qualified_ns(watches: DataFrame, videos: DataFrame, long_s: int = 600, clip_s: int = 30, clip_ratio: float = 0.5) -> DataFrame:
    """Engaged sports, news-clip and live-news watches, tagged with their class.

    ``videos`` holds content_id, section ('sports' or 'news'), content_type_id, duration, is_live_news;
    ``watches`` holds a ``feed`` column: 'ns' for sports and news clips, 'live' for live news.
    """
    joined = watches.join(videos, "content_id")
    length = F.col("watch_len")
    too_short_clip = (length < clip_s) & ((F.col("duration") <= 0) | (length / F.when(F.col("duration") > 0, F.col("duration")) < clip_ratio))
    long_form = F.col("content_type_id").isin(SPORT_LIVE, SPORT_REPLAY)
    sports = (F.col("feed") == "ns") & (F.col("section") == "sports") & F.when(long_form, length >= long_s).otherwise(~too_short_clip)
    clips = (F.col("feed") == "ns") & (F.col("section") == "news") & (F.col("content_type_id") == NEWS_CLIP) & ~too_short_clip
    live = (F.col("feed") == "live") & (F.col("section") == "news") & F.col("is_live_news") & (length >= long_s)
    label = F.when(sports, "sports").when(clips, "news_clip").when(live, "live_news")
    return joined.withColumn("ns_class", label).filter(F.col("ns_class").isNotNull())


def clean_titles(df: DataFrame, ignore_case: bool = False) -> DataFrame:
    """Active movies and episodes with an id and a title that is not a test title.

    The block list is compared with the lower-cased title as it stands, so its entries with capitals
    never match; ``ignore_case`` lower-cases the list too.
    """
    blocked = [b.lower() for b in BLOCKED_TITLES] if ignore_case else BLOCKED_TITLES
    sub_type = F.upper(F.trim("sub_type")).isin("MOVIE", "EPISODE")
    has_id = F.col("show_content_id").isNotNull() & (F.col("show_content_id") != "")
    title_ok = F.trim("title").isNotNull() & ~F.lower(F.trim("title")).isin(blocked)
    return df.filter(sub_type & (F.col("clip_status") == "10") & has_id & title_ok & (F.col("trailer_flag") == "0"))


def mask_labels(df: DataFrame) -> DataFrame:
    """Per-task labels with -1 for rows the task must ignore.

    Task 0 rows feed the click task, task 1 rows the random-watch task; the post-click tasks use
    rows with a click only.
    """
    click = F.when(F.col("task") == 0, F.col("click").cast("double")).otherwise(-1.0)
    after = lambda c: F.when(click > 0, F.col(c).cast("double")).otherwise(-1.0)
    return df.select(
        *[c for c in df.columns if c not in ("click", "watch", "paywall_view", "add_watchlist")],
        click.alias("click"),
        after("watch").alias("watch"),
        after("paywall_view").alias("paywall_view"),
        after("add_watchlist").alias("add_watchlist"),
        F.when(F.col("task") == 1, F.col("watch").cast("double")).otherwise(-1.0).alias("random_watch"),
    )


def task_rows(df: DataFrame, task: int) -> DataFrame:
    return df.filter(F.col("task") == task)


def drop_oversized(df: DataFrame, limit: int, max_id: int, key: str = "dw_p_id") -> DataFrame:
    """Without users over the row limit and users with an over-long id.

    Counting and an anti join keep the heavy users out of any window.
    """
    heavy = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit)
    return df.filter(F.length(key) <= max_id).join(heavy, key, "left_anti")


def user_watch_totals(watches: DataFrame, before: str | None = None) -> DataFrame:
    """Entertainment and sports seconds per user, of watches that began before ``before``."""
    rows = watches if before is None else watches.filter(F.col("first_watch") < F.col(before))
    ent = F.col("section") == "ent"
    return rows.groupBy("dw_p_id").agg(
        F.sum(F.when(ent, 1).otherwise(0)).alias("ent_watches"),
        F.sum(F.when(ent, F.col("watch_len")).otherwise(0)).alias("ent_seconds"),
        F.sum(F.when(F.col("section") == "sports", F.col("watch_len")).otherwise(0)).alias("sports_seconds"),
    )


def cohort(users: DataFrame, name: str, ent_limit: int = 6000, free_fid: int | None = None) -> DataFrame:
    """Slice of users by the totals of ``user_watch_totals`` (and feature ids for free / paid)."""
    if name == "no_entertainment":
        return users.filter(F.col("ent_watches") == 0)
    if name == "sports_heavy":
        return users.filter((F.col("ent_seconds") < ent_limit) & (F.col("ent_seconds") < F.col("sports_seconds")))
    if name in ("free", "paid"):
        free = F.array_contains("user_fids", F.lit(free_fid))
        return users.filter(free if name == "free" else ~free)
    raise ValueError(f"unknown cohort {name}")


def cohort_counts(users: DataFrame, report_limit: int = 240 * 60) -> DataFrame:
    """Users by (little entertainment, less entertainment than sports), the cohort's statistics."""
    return users.groupBy(
        (F.col("ent_seconds") < report_limit).alias("low_ent"),
        (F.col("ent_seconds") < F.col("sports_seconds")).alias("below_sports"),
    ).agg(F.count(F.lit(1)).alias("users"))


def new_item_users(examples: DataFrame, catalog: DataFrame, start: int, end: int) -> DataFrame:
    """Users with an in-range example whose title started at or after ``start``."""
    fresh = catalog.filter(F.col("start_dt") >= start).select("content_id")
    return in_range(examples, start, end).join(fresh, "content_id", "left_semi").select("dw_p_id").distinct()


def in_range(df: DataFrame, start: int | None, end: int | None, ts: str = "timestamp") -> DataFrame:
    """Rows with start <= ts < end; an absent bound is open."""
    if start is not None:
        df = df.filter(F.col(ts) >= start)
    return df.filter(F.col(ts) < end) if end is not None else df


def drop_incomplete(df: DataFrame) -> DataFrame:
    return df.na.drop()
