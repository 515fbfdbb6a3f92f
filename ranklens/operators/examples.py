"""Training examples from daily logs: positives, negatives, sampling.

Logs stay flat; nothing is nested per user. Joins of logs are merge joins: a job has dozens of them, and as
many broadcast sides would be held by the driver at once. Every draw is a hash of row identity and a salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranklens.functions.hashing import fid_slot, hash_index, hash_uniform
from ranklens.operators.filters import safe_id
from ranklens.operators.joins import past_watch
from ranklens.operators.keyed import first_by_draw, pick_one, prefix_sums

WATCH_SECONDS = 600  # fixed value: a watch counts as positive above this
EXAMPLE_COLUMNS = ["dw_p_id", "tray_id", "content_id", "timestamp", "label", "watch_time", "is_inter_tray"]


def first_impressions(imp: DataFrame) -> DataFrame:
    """First time each (user, tray, item) was shown; ids that do not parse are ignored."""
    rows = imp.select("dw_p_id", F.col("full_tray_id").alias("tray_id"), safe_id(F.col("content_id")).alias("content_id"), "timestamp")
    return rows.filter(F.col("content_id").isNotNull()).groupBy("dw_p_id", "tray_id", "content_id").agg(F.min("timestamp").alias("timestamp"))


def tray_watch_sums(tray_watches: DataFrame, imp: DataFrame) -> DataFrame:
    """Watch seconds per (user, tray, item), for trays that were shown to the user."""
    shown = imp.select("dw_p_id", F.col("full_tray_id").alias("tray_id")).distinct()
    sums = tray_watches.groupBy("dw_p_id", "tray_id", "content_id").agg(F.sum("watch_time").alias("watch_time"))
    return sums.join(shown.hint("merge"), ["dw_p_id", "tray_id"], "left_semi")


def impression_examples(imp: DataFrame, tray_watches: DataFrame, history: DataFrame, thr: int = WATCH_SECONDS) -> DataFrame:
    """Labelled impressions of trays with at least one watch.

    1: watched in the tray for more than ``thr`` seconds. 0: not watched in the tray and not in the
    history. Watched for up to ``thr`` seconds: neither.
    """
    sums = tray_watch_sums(tray_watches, imp)
    watched_trays = sums.select("dw_p_id", "tray_id").distinct()
    seen = history.select("dw_p_id", "content_id").distinct().withColumn("__seen", F.lit(True))
    rows = (
        first_impressions(imp)
        .join(watched_trays.hint("merge"), ["dw_p_id", "tray_id"], "left_semi")
        .join(sums.hint("merge"), ["dw_p_id", "tray_id", "content_id"], "left")
        .join(seen.hint("merge"), ["dw_p_id", "content_id"], "left")
    )
    label = F.when(F.col("watch_time") > thr, 1).when(F.col("watch_time").isNull() & F.col("__seen").isNull(), 0)
    return rows.withColumn("label", label).filter(F.col("label").isNotNull()).select(
        "dw_p_id", "tray_id", "content_id", "timestamp", F.col("label").cast("bigint").alias("label"),
        F.when(F.col("label") == 1, F.col("watch_time")).otherwise(0).cast("bigint").alias("watch_time"),
        F.lit(False).alias("is_inter_tray"))


def _with_positives(ex: DataFrame, by: list[str]) -> DataFrame:
    pos = ex.groupBy(*by).agg(F.count_if(F.col("label") > 0).alias("__pos"))
    return ex.join(pos.hint("merge"), by)


def _draw(ex: DataFrame, salt: str) -> DataFrame:
    return ex.withColumn("__u", hash_uniform(["dw_p_id", "tray_id", "content_id", "timestamp"], salt))


def cap_negatives(ex: DataFrame, ratio: int = 5, salt: str = "cap") -> DataFrame:
    """Examples of trays with positives, with at most ``ratio`` negatives per positive."""
    counted = _with_positives(ex, ["dw_p_id", "tray_id"]).filter(F.col("__pos") > 0)
    negatives = _draw(counted.filter(F.col("label") == 0), salt)
    kept = first_by_draw(negatives, ["dw_p_id", "tray_id"], "__u", ["content_id"], F.col("__pos") * ratio)
    return counted.filter(F.col("label") > 0).select(*ex.columns).unionByName(kept.select(*ex.columns))


def inter_tray_negatives(ex: DataFrame, salt: str = "inter") -> DataFrame:
    """Negatives of trays without positives, at most as many per user as the user has positives."""
    pool = _with_positives(ex, ["dw_p_id", "tray_id"]).filter(F.col("__pos") == 0).drop("__pos")
    totals = ex.groupBy("dw_p_id").agg(F.count_if(F.col("label") > 0).alias("__total")).filter(F.col("__total") > 0)
    drawn = _draw(pool.join(totals.hint("merge"), "dw_p_id"), salt)
    kept = first_by_draw(drawn, ["dw_p_id"], "__u", ["tray_id", "content_id"], F.col("__total"))
    return kept.withColumn("is_inter_tray", F.lit(True)).select(*ex.columns)


def user_examples(imp: DataFrame, tray_watches: DataFrame, history: DataFrame, thr: int = WATCH_SECONDS, ratio: int = 5,
                  cap_salt: str = "cap", inter_salt: str = "inter") -> DataFrame:
    """Single-label examples of a day: capped trays plus inter-tray negatives.

    The labelled impressions feed both samplers and their counts; a caller may stage them and use
    ``sampled_examples``.
    """
    return sampled_examples(impression_examples(imp, tray_watches, history, thr), ratio, cap_salt, inter_salt)


def sampled_examples(ex: DataFrame, ratio: int = 5, cap_salt: str = "cap", inter_salt: str = "inter") -> DataFrame:
    """Labelled impressions with negatives capped per tray, plus inter-tray negatives."""
    return cap_negatives(ex, ratio, cap_salt).unionByName(inter_tray_negatives(ex, inter_salt))


def first_watch_examples(watches: DataFrame, history: DataFrame, thr: int = WATCH_SECONDS) -> DataFrame:
    """Earliest qualifying watch of a title the user had not seen; one per user."""
    fresh = watches.filter(F.col("watch_time") > thr).join(history.select("dw_p_id", "content_id").hint("merge"), ["dw_p_id", "content_id"], "left_anti")
    rows = fresh.select("dw_p_id", "content_id", F.col("first_watch_ts").alias("timestamp"), F.col("watch_time").cast("bigint").alias("watch_time"))
    one = pick_one(rows, ["dw_p_id"], ["timestamp", "content_id", "watch_time"], largest=False)
    return one.select("dw_p_id", F.lit("").alias("tray_id"), "content_id", "timestamp", F.lit(1).cast("bigint").alias("label"),
                      "watch_time", F.lit(False).alias("is_inter_tray"))


def _watched_today(watches: DataFrame) -> DataFrame:
    return watches.filter(F.col("watch_time") > 0).groupBy("dw_p_id", "content_id").agg(F.sum("watch_time").alias("watch_time"))


def mtl_positives(imp: DataFrame, clicks: DataFrame, watches: DataFrame, paywall: DataFrame, watchlist: DataFrame,
                  episode_to_show: DataFrame, reco: Column, thr: int = WATCH_SECONDS) -> DataFrame:
    """Clicked items with watch, paywall and watchlist labels.

    ``reco`` tests ``full_tray_id``. The first click of an item on such a tray counts, if the item was
    shown in the same tray; its time is that of the first impression. The last paywall view and the
    last watchlist add count when they follow the click. Paywall ids of episodes map to their show.
    """
    shown = first_impressions(imp.filter(reco)).filter(F.col("timestamp") != 0)
    hits = clicks.filter(reco).select("dw_p_id", F.col("full_tray_id").alias("tray_id"), "content_id", F.col("timestamp").alias("click_ts"))
    first = pick_one(hits.join(shown, ["dw_p_id", "tray_id", "content_id"]), ["dw_p_id", "content_id"],
                     ["click_ts", "tray_id", "timestamp"], largest=False)
    keys = ["dw_p_id", "content_id"]
    views = paywall.withColumn("episode_id", safe_id(F.col("normalized_content_id"))).filter(F.col("episode_id").isNotNull())
    views = views.join(episode_to_show, "episode_id", "left").withColumn("content_id", F.coalesce("show_id", "episode_id"))
    last_view = views.groupBy(*keys).agg(F.max("timestamp").alias("view_ts"))
    last_add = watchlist.filter(F.col("action") == 1).groupBy(*keys).agg(F.max("timestamp").alias("add_ts"))
    joined = first.join(_watched_today(watches), keys, "left").join(last_view, keys, "left").join(last_add, keys, "left")
    seconds = F.coalesce(F.col("watch_time"), F.lit(0)).cast("bigint")
    flag = lambda test: F.when(test, 1).otherwise(0).cast("bigint")
    return joined.select(
        "dw_p_id", "tray_id", "content_id", "timestamp", F.lit(1).cast("bigint").alias("click"),
        flag(seconds > thr).alias("watch"), seconds.alias("watch_time"),
        flag(F.col("view_ts") > F.col("click_ts")).alias("paywall_view"), flag(F.col("add_ts") > F.col("click_ts")).alias("add_watchlist"))


def mtl_negatives(imp: DataFrame, clicks: DataFrame, watches: DataFrame, reco: Column) -> DataFrame:
    """Shown items the user neither clicked anywhere nor watched today; earliest impression per item."""
    keys = ["dw_p_id", "content_id"]
    touched = clicks.select(*keys).unionByName(watches.filter(F.col("watch_time") > 0).select(*keys))
    rows = first_impressions(imp.filter(reco)).join(touched, keys, "left_anti")
    one = pick_one(rows, keys, ["timestamp", "tray_id"], largest=False)
    zero = F.lit(0).cast("bigint")
    return one.select("dw_p_id", "tray_id", "content_id", "timestamp",
                      *[zero.alias(c) for c in ("click", "watch", "watch_time", "paywall_view", "add_watchlist")])


def downsample(ex: DataFrame, rate: float, salt: str = "neg", label: str = "click") -> DataFrame:
    """Positives as they are, negatives kept at ``rate``."""
    draw = hash_uniform(["dw_p_id", "tray_id", "content_id", "timestamp"], salt)
    return ex.filter((F.col(label) > 0) | (draw < rate))


def mtl_examples(positives: DataFrame, negatives: DataFrame, rate: float, salt: str = "neg") -> DataFrame:
    """Positives and down-sampled negatives of the users that have both."""
    rows = require_both_classes(positives.unionByName(negatives), ["dw_p_id"], "click")
    return downsample(rows, rate, salt)


def hash_sample(df: DataFrame, key_cols: list[str], rate: float, salt: str) -> DataFrame:
    return df.filter(hash_uniform(key_cols, salt) < rate)


def sample_users(df: DataFrame, rate: float, salt: str, user: str = "dw_p_id") -> DataFrame:
    """All rows of a hash-chosen share of the users."""
    return hash_sample(df, [user], rate, salt)


def dense_index(catalog: DataFrame, id_col: str = "content_id") -> DataFrame:
    """Ids numbered 0, 1, 2, ... in order, without sorting the table in one task."""
    return prefix_sums(catalog.select(id_col).distinct(), [], id_col, {"idx": F.lit(1)}).select(id_col, F.col("idx").cast("bigint").alias("idx"))


def random_negatives(positives: DataFrame, catalog: DataFrame, history: DataFrame, n: int, salt: str = "rand") -> DataFrame:
    """Up to n random released titles per positive that the user has not touched.

    Each of n draws names a catalogue position; the draws meet the catalogue by equi join. Repeats,
    titles in the history, the positive itself and titles released later fall away.
    """
    live = catalog.select("content_id", "start_dt").distinct()
    size = live.agg(F.count(F.lit(1))).scalar()
    indexed = dense_index(live).join(live.hint("merge"), "content_id").select(F.col("content_id").alias("candidate"), "idx", "start_dt")
    key = ["dw_p_id", "content_id", "timestamp"]
    draws = positives.select(*key, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))
    draws = draws.withColumn("idx", hash_index([*key, "draw"], salt, size))
    hits = draws.join(indexed.hint("merge"), "idx").filter((F.col("candidate") != F.col("content_id")) & (F.col("start_dt") <= F.col("timestamp")))
    fresh = hits.select(*key, "candidate").distinct().join(
        history.select("dw_p_id", F.col("content_id").alias("candidate")).hint("merge"), ["dw_p_id", "candidate"], "left_anti")
    return fresh.select(
        "dw_p_id", F.lit("").alias("tray_id"), F.col("candidate").alias("content_id"), "timestamp", F.lit(0).cast("bigint").alias("label"),
        F.lit(0).cast("bigint").alias("watch_time"), F.lit(False).alias("is_inter_tray"), F.col("content_id").alias("positive_id"))


def require_both_classes(ex: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    """Rows of the groups with at least one positive and one negative."""
    good = ex.groupBy(*by).agg(F.max(label).alias("__hi"), F.min(label).alias("__lo")).filter("__hi > 0 and __lo <= 0").select(*by)
    return ex.join(good.hint("merge"), by, "left_semi")


def join_example_sets(clicked: DataFrame, impressed: DataFrame, first_watch: DataFrame) -> DataFrame:
    """Per-user counts of three example sets side by side, keeping users found in any of them."""
    count = lambda df, name: df.groupBy("dw_p_id").agg(F.count(F.lit(1)).alias(name))
    return count(clicked, "mtl_examples").join(count(impressed, "tray_examples"), "dw_p_id", "full").join(
        count(first_watch, "first_watch_examples"), "dw_p_id", "full")


def discovery(watches: DataFrame, latest: DataFrame, history: DataFrame, rate: float, salt: str = "disc", thr: int = WATCH_SECONDS) -> DataFrame:
    """First-time watches: dominant language per title above ``thr``; earlier seconds decide.

    ``past_wt`` 0 is kept, above 0 is kept at ``rate``, -1 (seen without time) never.
    """
    per_lang = watches.groupBy("dw_p_id", "content_id", "language").agg(
        F.sum("watch_time").alias("watch_time"), F.min("first_watch_ts").alias("timestamp"))
    main = pick_one(per_lang.withColumn("__neg", -F.col("language")), ["dw_p_id", "content_id"], ["watch_time", "__neg"]).drop("__neg")
    rows = past_watch(main.filter(F.col("watch_time") > thr), latest, history)
    draw = hash_uniform(["dw_p_id", "content_id", "timestamp"], salt)
    return rows.filter((F.col("past_wt") == 0) | ((F.col("past_wt") > 0) & (draw < rate)))


def horizon_labels(watches: DataFrame, start: str, horizons: list[int]) -> DataFrame:
    """Hours per (user, item) and per user over [start, start + n - 1] for each horizon n.

    ``watches`` carries the day in ``cd``. One pass sums all horizons.
    """
    day = F.datediff("cd", F.lit(start).cast("date"))
    longest = max(horizons)
    rows = watches.withColumn("__d", day).filter(F.col("__d").between(0, longest - 1))
    sums = rows.groupBy("dw_p_id", "content_id").agg(*[F.sum(F.when(F.col("__d") < n, F.col("watch_time"))).alias(f"w{n}") for n in horizons])
    long = sums.select("dw_p_id", "content_id", F.inline(F.array(*[
        F.struct(F.lit(n).cast("bigint").alias("horizon"), F.col(f"w{n}").alias("seconds")) for n in horizons]))).filter("seconds is not null")
    users = long.groupBy("dw_p_id", "horizon").agg(F.sum("seconds").alias("all_seconds"))
    hours = lambda c: (F.col(c) / 3600).cast("float")
    return long.join(users, ["dw_p_id", "horizon"]).select(
        "dw_p_id", "content_id", "horizon", hours("seconds").alias("cum_watch_time"), hours("all_seconds").alias("all_watch_time"))


def split_watches(daily: DataFrame, n: int, thr: int = WATCH_SECONDS, salt: str = "split", seconds: str = "daily_watch_time") -> DataFrame:
    """The whole watch, and n random splits into a part before and a part of at least ``thr`` after."""
    rows = daily.filter(F.col(seconds) >= thr).withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(n))))
    draw = hash_uniform(["dw_p_id", "content_id", "__i"], salt)
    before = F.when(F.col("__i") == 0, 0).otherwise(F.floor(draw * (F.col(seconds) - thr + 1))).cast("bigint")
    return rows.withColumn("before", before).select(
        "dw_p_id", "content_id", "before", (F.col(seconds) - F.col("before")).cast("bigint").alias("wt_0"), (F.col("__i") > 0).alias("is_sample"))


def labelled_scores(act: DataFrame, label: str = "click") -> DataFrame:
    """Scored rows whose label is not masked."""
    return act.filter(F.col(label) != -1)


def target_watches(df: DataFrame, thr: int = WATCH_SECONDS, mode: str = "last", inclusive: bool = False) -> DataFrame:
    """Watches above the threshold: the newest per user (``last``) or every one with its position (``all``)."""
    long = F.col("watch_time") >= thr if inclusive else F.col("watch_time") > thr
    rows = df.filter(long)
    if mode == "all":
        return rows
    return pick_one(rows, ["dw_p_id"], ["timestamp", "content_id", "watch_time"])


def mix(parts: list[tuple[float, DataFrame]], salt: str = "mix", user: str = "dw_p_id") -> DataFrame:
    """Union of samplers, each keeping a user with its own weight."""
    out = None
    for i, (weight, df) in enumerate(parts):
        part = hash_sample(df, [user], weight, f"{salt}-{i}").withColumn("sampler", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def mask_new_titles(rows: DataFrame, slot: int, days: int = 2, rate: float = 0.1, salt: str = "mask") -> DataFrame:
    """Item-id features of titles at most ``days`` old set to 0 for a hash-chosen share of rows."""
    draw = hash_uniform(["dw_p_id", "content_id", "timestamp"], salt)
    hide = (F.col("secs_start_dt") <= days * 86400) & (draw < rate)
    masked = F.transform("fids", lambda f: F.when(fid_slot(f) == slot, F.lit(0).cast("bigint")).otherwise(f))
    return rows.withColumn("fids", F.when(hide, masked).otherwise(F.col("fids")))
