"""Queries for filters, projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ranklens.functions import hashing, scalars
from ranklens.operators import filters
from ranklens.plans.domain import CUT, NOW, RECO_EXACT, RECO_PREFIXES
from ranklens.plans.registry import query, rows_n
from ranklens.sources import packed

_RECO = "(full_tray_id IN ('home-picks') OR starts_with(full_tray_id, 'home-picks') OR starts_with(full_tray_id, 'reco-picks') OR starts_with(full_tray_id, 'reco-wide'))"


@query("f1_reco_tray", f"SELECT full_tray_id, count(*) AS n FROM log WHERE {_RECO} GROUP BY ALL")
def _(t):
    return t.log.filter(filters.is_reco_tray(F.col("full_tray_id"), RECO_EXACT, RECO_PREFIXES)).groupBy("full_tray_id").agg(rows_n())


@query("f2_adds_only", "SELECT dw_p_id, content_id, count(*) AS n FROM watchlist WHERE action = 1 GROUP BY ALL")
def _(t):
    return filters.adds_only(t.watchlist).groupBy("dw_p_id", "content_id").agg(rows_n())


@query("f3_safe_id", "SELECT id, count(*) AS n FROM (SELECT CASE WHEN regexp_full_match(trim(s), '-?[0-9]+') THEN CAST(trim(s) AS BIGINT) END AS id FROM (SELECT CASE WHEN k % 10 = 3 THEN '0' WHEN k % 10 = 4 THEN '12.0' WHEN k % 10 = 5 THEN 'x' || k ELSE ' ' || k || ' ' END AS s FROM log)) WHERE id <> 0 GROUP BY ALL")
def _(t):
    digit = F.col("k") % 10
    text = F.when(digit == 3, "0").when(digit == 4, "12.0").when(digit == 5, F.concat(F.lit("x"), F.col("k"))).otherwise(F.concat(F.lit(" "), F.col("k"), F.lit(" ")))
    return t.log.select(filters.safe_id(text).alias("id")).filter("id is not null").groupBy("id").agg(rows_n())


@query("f4_valid_events", "SELECT dw_p_id, count(*) AS n FROM log WHERE country = 'in' AND value >= 1 GROUP BY ALL")
def _(t):
    raw = t.log.withColumn("payload", F.encode(F.when(F.col("value") >= 1, F.col("event_type")).otherwise(""), "UTF-8"))
    return filters.valid_events(raw, "in").groupBy("dw_p_id").agg(rows_n())


_ALIVE = "(kind = 'show' OR (kind = 'movie' AND content_type_id = 200)) AND NOT deleted AND NOT hidden"


@query("f5_alive", f"SELECT dst, count(*) AS n FROM rel WHERE dst IN (SELECT content_id FROM catalog WHERE {_ALIVE}) GROUP BY ALL")
def _(t):
    return filters.alive(t.rel, t.catalog, "dst").groupBy("dst").agg(rows_n())


@query("f5_dropped_targets", f"SELECT dst, count(*) AS n FROM rel WHERE dst NOT IN (SELECT content_id FROM catalog WHERE {_ALIVE}) GROUP BY ALL")
def _(t):
    return filters.dropped_targets(t.rel, t.catalog, "dst")


@query("f6_released", "SELECT w.content_id, count(*) AS n FROM kwatch w JOIN catalog c USING (content_id) WHERE c.start_dt <= w.first_watch AND (kind <> 'show' OR start_dt > 0) GROUP BY ALL")
def _(t):
    return filters.released(t.kwatch, t.catalog, "first_watch").groupBy("content_id").agg(rows_n())


@query("f7_new_published", f"SELECT content_id, kind FROM catalog WHERE ((kind = 'movie' AND content_type_id = 200) OR (kind = 'show' AND content_type_id = 100)) AND start_dt > {CUT} - 7 * 86400 AND start_dt < {CUT} + 86400")
def _(t):
    return filters.new_published(t.catalog, CUT).select("content_id", "kind")


_GENRES = "[" + ", ".join(map(str, filters.SPORTS_GENRES)) + "]"


@query("f8_sports_content", f"""
    SELECT content_id, kind, unnest(language_ids) AS language_id FROM catalog
    WHERE list_has_any(genre_ids, {_GENRES}) AND ((kind = 'movie' AND content_type_id = 200 AND start_dt BETWEEN {CUT} - 30 * 86400 AND {CUT})
          OR (kind = 'show' AND last_broadcast >= {CUT} - 30 * 86400 AND first_broadcast <= {CUT}))""")
def _(t):
    return filters.sports_content(t.catalog, CUT, 30)


@query("f9_qualified_ns", """
    SELECT ns_class, content_id, count(*) AS n FROM (
        SELECT *, CASE WHEN feed = 'ns' AND section = 'sports' AND CASE WHEN content_type_id IN (301, 303) THEN watch_len >= 600 ELSE NOT short END THEN 'sports'
                       WHEN feed = 'ns' AND section = 'news' AND content_type_id = 401 AND NOT short THEN 'news_clip'
                       WHEN feed = 'live' AND section = 'news' AND is_live_news AND watch_len >= 600 THEN 'live_news' END AS ns_class
        FROM (SELECT *, watch_len < 30 AND (duration <= 0 OR watch_len / duration < 0.5) AS short FROM ns_watches JOIN videos USING (content_id)))
    WHERE ns_class IS NOT NULL GROUP BY ALL""")
def _(t):
    return filters.qualified_ns(t.ns_watches, t.videos).groupBy("ns_class", "content_id").agg(rows_n())


_BLOCK = "(" + ", ".join(f"'{x}'" for x in filters.BLOCKED_TITLES) + ")"
CLEAN_SQL = f"upper(trim(sub_type)) IN ('MOVIE', 'EPISODE') AND clip_status = '10' AND show_content_id <> '' AND lower(trim(title)) NOT IN {_BLOCK} AND trailer_flag = '0'"


@query("f10_clean_titles", f"SELECT show_content_id, title FROM titles WHERE {CLEAN_SQL}")
def _(t):
    return filters.clean_titles(t.titles).select("show_content_id", "title")


def _mtl(t):
    return t.scored.select("event_id", "task", "click", "label", F.col("label").alias("watch"), (F.col("content_id") % 2).alias("paywall_view"), (F.col("event_id") % 2).alias("add_watchlist"))


@query("f11_mask_labels", """
    SELECT event_id, task, label, click, CASE WHEN click > 0 THEN label ELSE -1 END::DOUBLE AS watch, CASE WHEN click > 0 THEN content_id % 2 ELSE -1 END::DOUBLE AS paywall_view,
           CASE WHEN click > 0 THEN event_id % 2 ELSE -1 END::DOUBLE AS add_watchlist, CASE WHEN task = 1 THEN label ELSE -1 END::DOUBLE AS random_watch
    FROM (SELECT event_id, task, label, content_id, CASE WHEN task = 0 THEN click ELSE -1 END::DOUBLE AS click FROM scored)""")
def _(t):
    return filters.mask_labels(_mtl(t))


@query("f12_task_rows", "SELECT dw_p_id, count(*) AS n FROM scored WHERE task = 1 GROUP BY ALL")
def _(t):
    return filters.task_rows(t.scored, 1).groupBy("dw_p_id").agg(rows_n())


@query("f13_drop_oversized", "SELECT dw_p_id, count(*) AS n FROM log GROUP BY dw_p_id HAVING count(*) <= 70 AND length(dw_p_id) <= 2")
def _(t):
    return filters.drop_oversized(t.log, limit=70, max_id=2).groupBy("dw_p_id").agg(rows_n())


def _sections(t):
    part = lambda e, s: t.between(e).select("dw_p_id", F.lit(s).alias("section"), F.col("watch_time").alias("watch_len"), F.col("timestamp").alias("first_watch"))
    return part("purchase", "ent").unionByName(part("error", "sports")).withColumn("at", F.lit(CUT - 86400 * 10))


TOTALS_SQL = f"""
    SELECT dw_p_id, count(*) FILTER (event_type = 'purchase') AS ent_watches, coalesce(sum(watch_time) FILTER (event_type = 'purchase'), 0)::BIGINT AS ent_seconds,
           coalesce(sum(watch_time) FILTER (event_type = 'error'), 0)::BIGINT AS sports_seconds
    FROM log WHERE event_type IN ('purchase', 'error') AND timestamp < {CUT - 86400 * 10} GROUP BY dw_p_id"""


@query("f14_no_entertainment", f"SELECT * FROM ({TOTALS_SQL}) WHERE ent_watches = 0")
def _(t):
    return filters.cohort(filters.user_watch_totals(_sections(t), "at"), "no_entertainment")


@query("f14_sports_heavy", f"SELECT * FROM ({TOTALS_SQL}) WHERE ent_seconds < 6000 AND ent_seconds < sports_seconds")
def _(t):
    return filters.cohort(filters.user_watch_totals(_sections(t), "at"), "sports_heavy")


@query("f14_cohort_counts", f"SELECT ent_seconds < 14400 AS low_ent, ent_seconds < sports_seconds AS below_sports, count(*) AS users FROM ({TOTALS_SQL}) GROUP BY ALL")
def _(t):
    return filters.cohort_counts(filters.user_watch_totals(_sections(t), "at"))


@query("f14_free_paid", "SELECT CASE WHEN k % 2 = 0 THEN 'free' ELSE 'paid' END AS cohort, dw_p_id, count(*) AS n FROM requests GROUP BY ALL")
def _(t):
    users = t.requests.select("dw_p_id", F.col("payload.user_feature.fids").alias("fids"), F.array(F.lit(7) + F.col("k") % 2).alias("user_fids"))
    parts = [filters.cohort(users, c, free_fid=7).groupBy(F.lit(c).alias("cohort"), "dw_p_id").agg(rows_n()) for c in ("free", "paid")]
    return parts[0].unionByName(parts[1])


@query("f14_new_item_users", f"SELECT DISTINCT dw_p_id FROM clicks JOIN catalog USING (content_id) WHERE start_dt >= {CUT - 86400 * 8} AND timestamp >= {CUT} AND timestamp < {CUT + 86400 * 7}")
def _(t):
    return filters.new_item_users(t.clicks, t.catalog, CUT - 86400 * 8, CUT + 86400 * 7)


@query("f15_drop_incomplete", "SELECT content_id, category, count(*) AS n FROM scored JOIN (SELECT content_id, popularity_tag AS category FROM tags) USING (content_id) WHERE base <> 0.01 GROUP BY ALL")
def _(t):
    rows = t.scored.select("content_id", F.when(F.col("base") != 0.01, F.col("base")).alias("base")).join(t.tags, "content_id", "left")
    return filters.drop_incomplete(rows).groupBy("content_id", F.col("popularity_tag").alias("category")).agg(rows_n())


@query("f16_column_pruning", "SELECT dw_p_id, CAST(max(watch_time) AS BIGINT) AS longest FROM log GROUP BY ALL")
def _(t):
    return t.log.select("dw_p_id", "watch_time").groupBy("dw_p_id").agg(F.max("watch_time").alias("longest"))


# ---- scalar functions


@query("x1_dates", """
    SELECT cd, strftime(CAST(cd AS DATE) + 7, '%Y-%m-%d') AS target, strftime(CAST(cd AS DATE) + 1, '%Y-%m-%d') AS next_day,
           strftime(CAST(cd AS DATE) - CAST(i AS INTEGER), '%Y-%m-%d') AS back, strftime(CAST(cd AS DATE) + CAST(i AS INTEGER), '%Y-%m-%d') AS ahead
    FROM (SELECT DISTINCT cd FROM log), range(0, 3) r(i)""")
def _(t):
    d = t.log.select("cd").distinct()
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    lists = F.arrays_zip(scalars.date_list(F.col("cd"), 3).alias("b"), scalars.date_list(F.col("cd"), 3, False).alias("a"))
    rows = d.select("cd", F.inline(lists))
    return rows.select("cd", text(scalars.add_days(F.col("cd"), 7)).alias("target"), text(scalars.add_days(F.col("cd"), 1)).alias("next_day"),
                       text(F.col("b")).alias("back"), text(F.col("a")).alias("ahead"))


@query("x2_day_offset", f"SELECT event_id, CAST(floor((timestamp - {CUT}) / 86400) AS BIGINT) AS day FROM log")
def _(t):
    return t.log.select("event_id", scalars.day_offset(F.col("timestamp"), F.lit(CUT)).alias("day"))


@query("x3_recency", f"SELECT event_id, round(pow(0.5, ({NOW} - timestamp) / 1209600.0::DOUBLE), 6) AS decay FROM log")
def _(t):
    return t.log.select("event_id", F.round(scalars.recency(F.col("timestamp"), NOW), 6).alias("decay"))


@query("x4_release_flags", """
    SELECT event_id, round(1 / (1 + ln(1 + greatest((timestamp - start_dt) / 86400.0::DOUBLE, 0))), 6) AS decay,
           CAST(timestamp - start_dt < 259200 AS INTEGER)::DOUBLE AS d3, CAST(timestamp - start_dt < 604800 AS INTEGER)::DOUBLE AS d7, CAST(timestamp - start_dt < 2592000 AS INTEGER)::DOUBLE AS d30
    FROM log JOIN catalog USING (content_id)""")
def _(t):
    rows = t.log.join(t.catalog, "content_id")
    ts, start = F.col("timestamp"), F.col("start_dt")
    return rows.select("event_id", F.round(scalars.log_recency(ts, start), 6).alias("decay"), *[scalars.release_flag(ts, start, d).alias(f"d{d}") for d in (3, 7, 30)])


_BUCKET = lambda x, edges: "len(list_filter(" + str([float(e) for e in edges]) + f", lambda e: e <= {x}))::INTEGER"


@query("x5_bucket", f"""
    SELECT event_id, {_BUCKET('watch_time', scalars.WATCH_TIME_EDGES)} AS watch_bucket, {_BUCKET(f'({NOW} - timestamp)', scalars.RECENCY_EDGES)} AS recency_bucket,
           {_BUCKET('value', scalars.RELEASE_DAY_EDGES)} AS release_bucket FROM log""")
def _(t):
    return t.log.select("event_id", scalars.bucket(F.col("watch_time"), scalars.WATCH_TIME_EDGES).alias("watch_bucket"),
                        scalars.bucket(F.lit(NOW) - F.col("timestamp"), scalars.RECENCY_EDGES).alias("recency_bucket"),
                        scalars.bucket(F.col("value"), scalars.RELEASE_DAY_EDGES).alias("release_bucket"))


@query("x6_year_bucket", "SELECT content_id, CAST(least(greatest(2024 - year, 0), 10) AS INTEGER) AS bucket FROM catalog")
def _(t):
    return t.catalog.select("content_id", scalars.year_bucket(F.col("year"), F.lit(2024)).alias("bucket"))


@query("x7_slot_fid", "SELECT event_id, (50::BIGINT << 48) + ('0x' || substr(md5(CAST(content_id AS VARCHAR)), 1, 12))::BIGINT AS fid, 50 AS slot FROM log")
def _(t):
    fid = hashing.slot_fid(50, F.col("content_id"))
    return t.log.select("event_id", fid.alias("fid"), hashing.fid_slot(fid).alias("slot"))


@query("x8_sparse_pairs", "SELECT event_id, unnest([1, 7, 11])::INTEGER AS idx, unnest([value, watch_time::DOUBLE, k::DOUBLE]) AS val FROM log")
def _(t):
    i, v = scalars.sparse_pairs([(1, F.col("value")), (7, F.col("watch_time")), (11, F.col("k"))])
    return t.log.select("event_id", F.inline(F.arrays_zip(i.alias("idx"), v.alias("val"))))


@query("x9_geo_key", "SELECT event_id, lower(coalesce(CASE WHEN k % 3 = 0 THEN 'KA' END, CASE WHEN k % 3 = 1 THEN upper(country) END, 'mh')) AS geo FROM log")
def _(t):
    m = F.col("k") % 3
    return t.log.select("event_id", scalars.geo_key(F.when(m == 0, "KA"), F.when(m == 1, F.upper("country"))).alias("geo"))


@query("x10_map_get", "SELECT event_id, cd AS version, upper(country) AS state, CAST(NULL AS VARCHAR) AS gender, round(CASE WHEN k % 3 = 1 THEN value ELSE 0 END, 2) AS lpv FROM requests")
def _(t):
    m = F.col("payload.raw_feature.serialized_features")
    lpv = F.transform_values("payload.raw_feature.lpv", lambda _, v: v.cast("double"))
    return t.requests.select("event_id", scalars.map_text(m, 5).alias("version"), scalars.map_text(m, 7).alias("state"), scalars.map_text(m, 3).alias("gender"),
                             F.round(scalars.map_number(lpv, "l1"), 2).alias("lpv"))


@query("x11_l2_normalize", """
    SELECT vec_id, generate_subscripts(h, 1) AS pos, unnest(list_transform(h, lambda x: round(x / (sqrt(list_sum(list_transform(h, lambda y: y * y))) + 1e-8), 6))) AS x FROM acts""")
def _(t):
    rows = t.acts.select("vec_id", F.posexplode(scalars.l2_normalize(F.col("h"))).alias("pos", "x"))
    return rows.select("vec_id", (F.col("pos") + 1).cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


@query("x12_heads", """
    SELECT vec_id, round(c, 6) AS click_logit, round(w, 6) AS watch_logit, round(1 / (1 + exp(-c)) * (1 / (1 + exp(-w))), 6) AS p_watch FROM (
        SELECT vec_id, list_sum(list_transform(h, lambda x, i: x * (i % 5 - 2))) + ln(0.08::DOUBLE) AS c, list_sum(list_transform(h, lambda x, i: x * (i % 3 - 1))) AS w FROM acts)""")
def _(t):
    weights = lambda m, s: F.transform("h", lambda x, i: ((i + 1) % m - s).cast("double"))
    out = scalars.heads(F.col("h"), weights(5, 2), weights(3, 1), 0.08)
    return t.acts.select("vec_id", *[F.round(c, 6).alias(n) for n, c in out.items()])


@query("x13_tier", "SELECT event_id, CASE WHEN value >= 100 THEN 'High' WHEN value >= 10 THEN 'Medium' WHEN value >= 1 THEN 'Low' ELSE 'Negligible' END AS tier FROM log")
def _(t):
    return t.log.select("event_id", scalars.tier(F.col("value") / 100).alias("tier"))


@query("x14_items_json", "SELECT event_id, unnest([content_id, k]) AS content_id, unnest([value, value / 2]) AS score FROM log")
def _(t):
    items = F.array(F.struct("content_id", F.col("value").alias("score")), F.struct(F.col("k").alias("content_id"), (F.col("value") / 2).alias("score")))
    text = t.log.select("event_id", packed.to_items_json(items).alias("json"))
    return text.select("event_id", F.inline(packed.from_items_json(F.col("json"))))


@query("x15_to_hours", "SELECT event_id, round(CAST(CAST(watch_time / 3600 AS FLOAT) AS DOUBLE), 4) AS hours FROM log")
def _(t):
    return t.log.select("event_id", F.round(scalars.to_hours(F.col("watch_time")).cast("double"), 4).alias("hours"))


@query("x16_variant_suffix", "SELECT '-' || event_type AS suffix, count(*) AS n FROM log GROUP BY ALL")
def _(t):
    names = ["click", "-view", "purchase", "signup", "error"]
    mapping = F.create_map(*[F.lit(x) for n in names for x in (n.lstrip("-"), scalars.variant_suffix(n))])
    return t.log.groupBy(F.element_at(mapping, F.col("event_type")).alias("suffix")).agg(rows_n())


@query("x17_horizon_output", """
    SELECT event_id, round(CASE k % 3 WHEN 0 THEN value WHEN 1 THEN value / 2 ELSE value / 100 END, 6) AS hours, round(greatest(value / 100 * 3600, 600), 6) AS seconds FROM log""")
def _(t):
    hours = F.array("value", F.col("value") / 2, F.col("value") / 100)
    return t.log.select("event_id", F.round(scalars.horizon_output(hours, F.col("k") % 3), 6).alias("hours"), F.round(scalars.horizon_seconds(hours), 6).alias("seconds"))
