"""Feature rows: strict as-of request events, preference profiles, popularity, hashed ids.

Requests and titles stay normalised until the last join: the as-of step carries only event keys, and
a profile is computed once per matched request event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranklens.functions.hashing import slot_fid
from ranklens.functions.scalars import (
    RECENCY_EDGES, RELEASE_DAY_EDGES, WATCH_TIME_EDGES, bucket, geo_key, log_recency, map_text, release_flag, sparse_pairs, year_bucket)
from ranklens.operators.aggregates import profile
from ranklens.operators.examples import require_both_classes
from ranklens.operators.joins import asof_strict, join_version

# Feature slots, scalar indices and keys of the serialized feature map.
SLOTS = {
    "plan_types": 2, "target_id": 50, "content_type_id": 51, "genre_id": 52, "studio_id": 53, "production_house_id": 54,
    "entitlement": 55, "parental_rating": 56, "year_bucket": 57, "priority": 58, "channel_id": 59, "release_time_bucket": 60,
    "language_id": 63, "past_watched_time": 67, "last_watch_to_now": 68,
}
SCALARS = {
    "genre_weight": 1, "studio_weight": 2, "parental_rating_weight": 3, "content_type_weight": 4, "production_house_weight": 5,
    "year_bucket_weight": 6, "log_recency_weight": 7, "release_3d": 8, "release_7d": 9, "release_30d": 10,
    "state_dv": 11, "state_wv": 12, "lang_dv": 13, "lang_wv": 14,
}
MAP_KEYS = {"geo_state": 2, "pop_version": 5, "state_pop_version": 6, "state": 7, "region": 8}


def event_profiles(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """One preference map per event: ``"attr:value" -> share``.

    The map is bounded by the watches inside one payload. Release years bucket relative to the event.
    """
    watches = events.select("event_id", "event_year", F.inline(F.arrays_zip(
        F.col("payload.raw_feature.ent_watches").alias("w"), F.col("payload.raw_feature.ent_watch_weights").alias("weight"))))
    watches = watches.select("event_id", "event_year", F.col("w.content_id").try_cast("bigint").alias("content_id"), F.col("weight").cast("double").alias("weight"))
    years = catalog.select("content_id", "year")
    dated = watches.join(years.hint("merge"), "content_id").withColumn("year_bucket", year_bucket(F.col("year"), F.col("event_year")))
    attrs = catalog.select("content_id", "studio_id", "parental_rating", "content_type_id", "production_house_id", "genre_ids")
    entries = profile(dated, attrs, ["event_id"], extra=["year_bucket"]).select("event_id", F.concat_ws(":", "attr", "value").alias("k"), "share")
    return entries.groupBy("event_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "share"))).alias("profile"))


def match_events(examples: DataFrame, events: DataFrame) -> DataFrame:
    """Examples with the id and time of the latest request event strictly before them."""
    slim = events.select("dw_p_id", F.col("timestamp").alias("event_ts"), "event_id")
    return asof_strict(examples, slim, ["dw_p_id"], "timestamp", "event_ts", tie=["event_id"])


def _weight(attr: str, value: Column) -> Column:
    return F.coalesce(F.try_element_at("profile", F.concat(F.lit(f"{attr}:"), value.cast("string"))), F.lit(0.0))


def feature_rows(examples: DataFrame, events: DataFrame, catalog: DataFrame, pop: DataFrame, state_pop: DataFrame,
                 country: str, task: int = 0, mtl: bool = False, production_house: bool = False, on_gap: str = "null", prepare=None) -> DataFrame:
    """Examples as feature rows.

    ``events``: dw_p_id, event_id, timestamp, event_year, payload. ``pop``: version, content_id,
    language_id, dv, wv. ``state_pop``: version, state, content_id, dv, wv. Single-label rows are kept
    for users with both classes; multi-task rows are all kept. The timestamp is the event's. Examples
    may carry their own ``task`` column; the class rule then holds per (user, task).

    The class rule is applied to the matched examples of known titles, before anything is assembled.
    ``on_gap`` says what a popularity version between the known ones does: "null" leaves the values 0,
    "error" fails. The matched examples feed the profiles and the rows; ``prepare`` is applied to them,
    for a caller that stages them.
    """
    task_col = F.col("task") if "task" in examples.columns else F.lit(task)
    matched = match_events(examples, events).join(catalog.select("content_id").hint("merge"), "content_id", "left_semi")
    if not mtl:
        matched = require_both_classes(matched.withColumn("__task", task_col), ["dw_p_id", "__task"]).drop("__task")
    if prepare is not None:
        matched = prepare(matched)
    needed = events.join(matched.select("event_id").distinct().hint("merge"), "event_id", "left_semi")
    sf = F.col("payload.raw_feature.serialized_features")
    facts = needed.select(
        "event_id", "event_year", F.col("payload.user_feature.fids").alias("user_fids"),
        F.col("payload.user_feature.weighted_fids").alias("user_weighted_fids"),
        F.col("payload.user_feature.fid_weights").alias("user_weighted_fid_weights"),
        map_text(sf, MAP_KEYS["pop_version"]).alias("pop_version"), map_text(sf, MAP_KEYS["state_pop_version"]).alias("state_version"),
        geo_key(map_text(sf, MAP_KEYS["geo_state"]), map_text(sf, MAP_KEYS["state"]), map_text(sf, MAP_KEYS["region"])).alias("state"),
    ).join(event_profiles(needed, catalog).hint("merge"), "event_id", "left")
    items = catalog.select(
        "content_id", "content_type_id", "studio_id", "production_house_id", "parental_rating", "entitlement", "priority", "year", "genre_ids",
        F.coalesce(F.get("language_ids", F.lit(0)).cast("int"), F.lit(-1)).alias("language_id"), "start_dt")
    rows = matched.join(facts.hint("merge"), "event_id").join(items.hint("merge"), "content_id")
    empty = F.create_map().cast("map<string,double>")
    rows = rows.withColumn("profile", F.coalesce("profile", empty)).withColumn("yb", year_bucket(F.col("year"), F.col("event_year")))

    rows = join_version(rows.withColumnRenamed("pop_version", "version"), pop.withColumnsRenamed({"dv": "lang_dv", "wv": "lang_wv"}),
                        ["content_id", "language_id"], on_gap=on_gap).drop("resolved", "version")
    rows = join_version(rows.withColumnRenamed("state_version", "version"), state_pop.withColumnsRenamed({"dv": "state_dv", "wv": "state_wv"}),
                        ["content_id", "state"], on_gap=on_gap).drop("resolved", "version")

    genres = F.when(F.size("genre_ids") > 0, F.transform("genre_ids", lambda g: g.cast("string"))).otherwise(F.array(F.lit("empty")))
    one = lambda slot, col: F.array(slot_fid(SLOTS[slot], F.col(col)))
    fids = F.concat(
        one("target_id", "content_id"), F.transform(genres, lambda g: slot_fid(SLOTS["genre_id"], g)), one("entitlement", "entitlement"),
        one("content_type_id", "content_type_id"), one("parental_rating", "parental_rating"), one("studio_id", "studio_id"),
        one("production_house_id", "production_house_id"), one("year_bucket", "yb"), one("priority", "priority"))
    ts, start = F.col("event_ts"), F.col("start_dt")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    genre_weight = F.aggregate("genre_ids", F.lit(0.0), lambda s, g: s + _weight("genre", g))
    pairs = [
        ("genre_weight", genre_weight), ("parental_rating_weight", _weight("parental_rating", F.col("parental_rating"))),
        ("content_type_weight", _weight("content_type_id", F.col("content_type_id"))), ("studio_weight", _weight("studio_id", F.col("studio_id"))),
        ("year_bucket_weight", _weight("year_bucket", F.col("yb"))), ("log_recency_weight", log_recency(ts, start)),
        ("release_3d", release_flag(ts, start, 3)), ("release_7d", release_flag(ts, start, 7)), ("release_30d", release_flag(ts, start, 30)),
        ("state_dv", zero("state_dv")), ("state_wv", zero("state_wv")), ("lang_dv", zero("lang_dv")), ("lang_wv", zero("lang_wv")),
    ]
    if production_house:
        pairs.append(("production_house_weight", _weight("production_house_id", F.col("production_house_id"))))
    indices, values = sparse_pairs([(SCALARS[n], v) for n, v in pairs])
    labels = ["click", "watch", "watch_time", "paywall_view", "add_watchlist"] if mtl else ["label"]
    return rows.select(
        F.lit(country).alias("country"), "dw_p_id", "content_id", ts.alias("timestamp"), task_col.alias("task"), task_col.alias("flag"),
        "user_fids", "user_weighted_fids", "user_weighted_fid_weights", fids.alias("fids"),
        F.array(F.lit(0).cast("bigint")).alias("weighted_fids"), F.array(F.lit(0.0)).alias("weighted_fid_weights"),
        indices.alias("sparse_indices"), values.alias("sparse_values"), (ts - start).alias("secs_start_dt"), *labels)


def cumwatch_features(base: DataFrame, events: DataFrame, catalog: DataFrame) -> DataFrame:
    """Cumulative-watch feature rows: online watch time and recency from the latest earlier event.

    ``base``: dw_p_id, content_id, language, timestamp, past_wt. Events without a payload are ignored.
    """
    matched = match_events(base, events.filter(F.col("payload").isNotNull()))
    facts = events.select("event_id", F.col("payload.user_feature.fids").alias("user_fids"), F.col("payload.raw_feature.ent_watches").alias("watches"))
    items = catalog.select("content_id", "kind", "content_type_id", "studio_id", "parental_rating", "entitlement", "genre_ids", "start_dt", "channel_id")
    rows = matched.join(facts.hint("merge"), "event_id").join(items.hint("merge"), "content_id")
    own = F.filter("watches", lambda w: w["content_id"] == F.col("content_id").cast("string"))
    rows = rows.withColumn("own", own).withColumn(
        "online", F.aggregate("own", F.lit(0).cast("bigint"), lambda s, w: s + w["watch_time"])).withColumn(
        "last_ts", F.aggregate("own", F.lit(0).cast("bigint"), lambda s, w: F.greatest(s, w["timestamp"])))
    since = F.when(F.col("last_ts") > 0, F.col("timestamp") - F.col("last_ts")).otherwise(0)
    since_bucket = F.when(F.col("last_ts") > 0, bucket(since, RECENCY_EDGES) + 1).otherwise(0)
    age_days = F.greatest((F.col("timestamp") - F.col("start_dt")) / 86400, F.lit(0.0))
    genres = F.when(F.size("genre_ids") > 0, F.transform("genre_ids", lambda g: g.cast("string"))).otherwise(F.array(F.lit("empty")))
    one = lambda slot, col: F.array(slot_fid(SLOTS[slot], col))
    fids = F.concat(
        one("target_id", F.col("content_id")), one("language_id", F.col("language")), one("content_type_id", F.col("content_type_id")),
        F.transform(genres, lambda g: slot_fid(SLOTS["genre_id"], g)), one("entitlement", F.col("entitlement")),
        one("parental_rating", F.col("parental_rating")), one("past_watched_time", bucket(F.col("online"), WATCH_TIME_EDGES)),
        one("last_watch_to_now", since_bucket), one("studio_id", F.col("studio_id")),
        F.when(F.col("kind") == "show", one("channel_id", F.col("channel_id"))).otherwise(F.array().cast("array<bigint>")),
        one("release_time_bucket", bucket(age_days, RELEASE_DAY_EDGES)))
    raw = F.array(*[c.cast("double") for c in (F.col("past_wt"), F.col("online"), since, F.when(F.col("kind") == "movie", 1).otherwise(0))])
    return rows.select(
        "dw_p_id", "content_id", F.col("language").alias("language_id"), "timestamp", "user_fids", fids.alias("fids"), raw.alias("raw"))
