"""Queries for joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ranklens.operators import aggregates, joins, popularity
from ranklens.plans.domain import CUT
from ranklens.plans.registry import query, rows_n



@query("j1_inner_user", "SELECT r.dw_p_id, event_id, h.seconds FROM requests r JOIN (SELECT dw_p_id, CAST(sum(watch_len) AS BIGINT) AS seconds FROM history GROUP BY ALL) h USING (dw_p_id)")
def _(t):
    """Requests of users with a history, one history row per user."""
    past = aggregates.agg_watch(t.history, ["dw_p_id"], seconds=F.sum("watch_len"))
    return t.requests.select("dw_p_id", "event_id").join(past, "dw_p_id", "inner")


@query("j2_left_optional", """
    SELECT d.dw_p_id, d.content_id, CAST(sum(d.watch_time) AS BIGINT) AS today, CAST(coalesce(max(h.past), 0) AS BIGINT) AS past FROM daily d
    LEFT JOIN (SELECT dw_p_id, content_id, sum(watch_len) AS past FROM history GROUP BY ALL) h USING (dw_p_id, content_id) GROUP BY ALL""")
def _(t):
    keys = ["dw_p_id", "content_id"]
    today = aggregates.agg_watch(t.daily, keys, today=F.sum("watch_time"))
    return today.join(aggregates.agg_watch(t.history, keys, past=F.sum("watch_len")), keys, "left").fillna({"past": 0})


@query("j4_left_anti", "SELECT content_id, count(*) AS n FROM kwatch WHERE dw_p_id NOT IN (SELECT dw_p_id FROM log WHERE event_type = 'error' AND value > 100) GROUP BY ALL")
def _(t):
    bad = t.between("error").filter("value > 100").select("dw_p_id")
    return t.kwatch.join(bad, "dw_p_id", "left_anti").groupBy("content_id").agg(rows_n())


@query("j5_scalar_total", """
    WITH v AS (SELECT sub_title_id, count(DISTINCT dw_p_id) AS viewers FROM view_log GROUP BY ALL), o AS (SELECT count(DISTINCT dw_p_id) AS platform_viewers FROM view_log)
    SELECT * FROM v LEFT JOIN o ON 1 = 1""")
def _(t):
    return popularity.with_total(popularity.viewers(t.view_log))


@query("j6_active_users", """
    SELECT dw_p_id, count(*) AS n FROM history WHERE dw_p_id IN (SELECT dw_p_id FROM log WHERE event_type = 'view' AND timestamp >= 1706572800
        UNION SELECT dw_p_id FROM log WHERE event_type = 'click' AND timestamp >= 1706572800) GROUP BY ALL""")
def _(t):
    late = F.col("timestamp") >= 1706572800
    active = joins.active_users(t.between("view").filter(late), t.between("click").filter(late))
    return t.history.join(active, "dw_p_id", "left_semi").groupBy("dw_p_id").agg(rows_n())


@query("j7_lookup", "SELECT s.content_id, coalesce(popularity_tag, 'Unmapped') AS popularity_tag, count(*) AS n FROM scored s LEFT JOIN tags USING (content_id) GROUP BY ALL")
def _(t):
    return joins.lookup(t.scored, t.tags.withColumn("o", F.lit(1)), "content_id", "popularity_tag", "Unmapped", "o").groupBy("content_id", "popularity_tag").agg(rows_n())


@query("j8_asof_strict", f"""
    SELECT v.event_id AS example_id, v.dw_p_id, r.timestamp AS event_ts, r.event_id AS request_id
    FROM (SELECT * FROM log WHERE event_type = 'view' AND timestamp >= {CUT}) v
    ASOF JOIN (SELECT dw_p_id, timestamp, max(event_id) AS event_id FROM requests GROUP BY ALL) r ON v.dw_p_id = r.dw_p_id AND v.timestamp > r.timestamp""")
def _(t):
    left = t.between("view", False).select(F.col("event_id").alias("example_id"), "dw_p_id", "timestamp")
    right = t.requests.select("dw_p_id", F.col("timestamp").alias("event_ts"), F.col("event_id").alias("request_id"))
    return joins.asof_strict(left, right, ["dw_p_id"], "timestamp", "event_ts", tie=["request_id"]).drop("timestamp")


@query("j8_asof_all", """
    SELECT v.event_id AS example_id, r.timestamp AS event_ts, r.event_id AS request_id FROM log v
    ASOF LEFT JOIN (SELECT dw_p_id, timestamp, max(event_id) AS event_id FROM requests GROUP BY ALL) r ON v.dw_p_id = r.dw_p_id AND v.timestamp > r.timestamp""")
def _(t):
    left = t.log.select(F.col("event_id").alias("example_id"), "dw_p_id", "timestamp")
    right = t.requests.select("dw_p_id", F.col("timestamp").alias("event_ts"), F.col("event_id").alias("request_id"))
    return joins.asof_strict(left, right, ["dw_p_id"], "timestamp", "event_ts", tie=["request_id"], keep_unmatched=True).select("example_id", "event_ts", "request_id")


@query("j9_join_version", """
    SELECT r.event_id, resolved, round(p.dv, 6) AS dv FROM (
        SELECT *, CASE WHEN cd > '2024-01-18' THEN '2024-01-18' WHEN cd < '2024-01-15' THEN '2024-01-15' WHEN cd IN (SELECT version FROM pop) THEN cd END AS resolved,
               1 + k % 10 AS content_id, CAST(k % 3 AS INTEGER) AS language_id FROM requests) r
    LEFT JOIN pop p ON p.version = resolved AND p.content_id = r.content_id AND p.language_id = r.language_id""")
def _(t):
    asked = t.requests.select("event_id", F.col("cd").alias("version"), (1 + F.col("k") % 10).alias("content_id"), (F.col("k") % 3).cast("int").alias("language_id"))
    return joins.join_version(asked, t.pop, ["content_id", "language_id"], on_gap="null").select("event_id", "resolved", F.round("dv", 6).alias("dv"))


@query("j10_assign_bin", """
    SELECT w.dw_p_id, w.content_id, w.watch_len, CASE WHEN p_partkey IS NULL THEN 0 ELSE least(len(list_filter([0, p_size * 10, p_size * 40, p_size * 100], lambda e: e < w.watch_len)), 3) END::INTEGER AS bin
    FROM (SELECT dw_p_id, CASE WHEN language = 2 THEN -content_id ELSE content_id END AS content_id, watch_len FROM kwatch) w LEFT JOIN part ON p_partkey = w.content_id""")
def _(t):
    """Watches of one language have titles that the table of edges does not hold."""
    size = F.col("p_size")
    edges = t.raw("part").select(F.col("p_partkey").alias("content_id"), F.array(F.lit(0), size * 10, size * 40, size * 100).alias("edges"))
    watches = t.kwatch.withColumn("content_id", F.when(F.col("language") == 2, -F.col("content_id")).otherwise(F.col("content_id")))
    return watches.join(edges, "content_id", "left").select("dw_p_id", "content_id", "watch_len", joins.assign_bin(F.col("watch_len"), F.col("edges")).alias("bin"))


PAST_SQL = """
    SELECT d.*, CASE WHEN h.wt > 0 THEN h.wt WHEN h.dw_p_id IS NOT NULL OR l.dw_p_id IS NOT NULL THEN -1 ELSE 0 END::BIGINT AS past_wt FROM daily d
    LEFT JOIN (SELECT dw_p_id, content_id, sum(watch_len) AS wt FROM history GROUP BY ALL) h USING (dw_p_id, content_id)
    LEFT JOIN (SELECT DISTINCT dw_p_id, content_id FROM latest) l USING (dw_p_id, content_id)"""


@query("j12_past_watch", f"SELECT dw_p_id, content_id, first_watch_ts, watch_time, past_wt FROM ({PAST_SQL})")
def _(t):
    return joins.past_watch(t.daily, t.latest, t.history).select("dw_p_id", "content_id", "first_watch_ts", "watch_time", "past_wt")


@query("j12_is_new_watch", """
    SELECT dw_p_id, content_id, count(*) AS n FROM daily d WHERE NOT EXISTS (SELECT 1 FROM history h WHERE h.dw_p_id = d.dw_p_id AND h.content_id = d.content_id)
      AND NOT EXISTS (SELECT 1 FROM latest h WHERE h.dw_p_id = d.dw_p_id AND h.content_id = d.content_id) GROUP BY ALL""")
def _(t):
    return joins.is_new_watch(t.daily, t.latest, t.history).groupBy("dw_p_id", "content_id").agg(rows_n())


@query("j13_without_seen", "SELECT event_id, unnest(list_distinct(list_filter([k, k + 1, content_id, k], lambda x: NOT list_contains([content_id, k + 2], x)))) AS item FROM log")
def _(t):
    pred = F.array("k", F.col("k") + 1, "content_id", "k")
    return t.log.select("event_id", F.explode(joins.without_seen(pred, F.array("content_id", F.col("k") + 2))).alias("item"))


@query("j14_qualify", """
    SELECT dw_p_id, timestamp, count(*) AS n FROM scored WHERE (dw_p_id, timestamp) IN (SELECT (dw_p_id, timestamp) FROM scored GROUP BY dw_p_id, timestamp HAVING count(*) >= 12 AND max(click) = 1) GROUP BY ALL""")
def _(t):
    by = ["dw_p_id", "timestamp"]
    return joins.qualify(t.scored, by, (F.count(F.lit(1)) >= 12) & (F.max("click") == 1)).groupBy(*by).agg(rows_n())


@query("j15_map_identity", "SELECT count(*) AS rows, count(c_custkey) AS mapped, count(*) - count(c_custkey) AS unmapped FROM (SELECT dw_p_id FROM users UNION ALL SELECT DISTINCT 'guest-' || cd FROM log) LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = dw_p_id")
def _(t):
    """Users of the log, and a guest per day, who has no profile."""
    mapping = t.raw("customer").select(F.col("c_custkey").cast("string").alias("dw_p_id"), F.col("c_name").alias("profile_id"))
    guests = t.log.select(F.concat(F.lit("guest-"), "cd").alias("dw_p_id")).distinct()
    return joins.coverage(joins.map_identity(t.users.unionByName(guests), mapping))


@query("j16_watch_relevance", """
    SELECT w.dw_p_id, r.dst, r.dst_lang, count(*) AS n, round(sum(r.score), 6) AS score FROM kwatch w JOIN rel r ON w.content_id = r.src AND w.language = r.src_lang GROUP BY ALL""")
def _(t):
    return joins.dealt_by_target(joins.watch_relevance(t.kwatch, t.rel)).groupBy("dw_p_id", "dst", "dst_lang").agg(rows_n(), F.round(F.sum("relevance"), 6).alias("score"))


@query("j17_missing_fids", """
    SELECT fid, count(*) AS uses FROM (SELECT k AS fid FROM requests UNION ALL SELECT 7 + k % 2 FROM requests) WHERE fid NOT IN (SELECT DISTINCT vec_id % 60 FROM embeddings) GROUP BY ALL""")
def _(t):
    rows = t.requests.select(F.col("payload.user_feature.fids").alias("fids"))
    known = t.raw("embeddings").select((F.col("vec_id") % 60).alias("fid")).distinct()
    return joins.missing_fids(rows, known)
