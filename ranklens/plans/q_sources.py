"""Queries for scans, sources and sinks. Tables are written below the shared folder and read back."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranklens.functions.scalars import step_value
from ranklens.plans.domain import CUT
from ranklens.plans.registry import query, rows_n
from ranklens.session import scratch_path
from ranklens.sources import bucketed, logs, packed, versions

_WRITTEN: dict[tuple[int, str, str], str] = {}


def _stored(t, name: str, write) -> str:
    """Path of a table written once per session and folder."""
    key = (id(t.spark), t.dir, name)
    if key not in _WRITTEN:
        path = scratch_path(t.spark, name)
        write(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def _log_table(t) -> str:
    """The log as a table partitioned by country and day; one user becomes anonymous, one blank."""
    user = F.when(F.col("dw_p_id") == "1", "-1").when(F.col("dw_p_id") == "2", "").otherwise(F.col("dw_p_id"))
    return _stored(t, "log", lambda p: t.log.withColumn("dw_p_id", user).hint("rebalance", F.col("country"), F.col("cd")).write.partitionBy("country", "cd").parquet(p))


_VALID = "(dw_p_id NOT IN ('1', '2'))"


@query("s1_read_day", f"SELECT event_type, count(*) AS n, CAST(sum(watch_time) AS BIGINT) AS seconds FROM log WHERE cd = '2024-01-20' AND country = 'in' AND {_VALID} GROUP BY ALL")
def _(t):
    day = logs.read_day(t.spark, _log_table(t), "2024-01-20", "in")
    return day.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("watch_time").alias("seconds"))


@query("s2_read_days", "SELECT cd, country, count(*) AS n FROM log WHERE cd BETWEEN '2024-01-14' AND '2024-01-20' GROUP BY ALL")
def _(t):
    days = logs.read_days(t.spark, _log_table(t), "2024-01-20", 7)
    return days.groupBy(F.col("cd").cast("string").alias("cd"), "country").agg(F.count(F.lit(1)).alias("n"))


@query("s2_read_days_forward", "SELECT cd, count(*) AS n FROM log WHERE cd BETWEEN '2024-01-20' AND '2024-01-22' GROUP BY ALL")
def _(t):
    days = logs.read_days(t.spark, _log_table(t), "2024-01-20", 3, backwards=False)
    return days.groupBy(F.col("cd").cast("string").alias("cd")).agg(F.count(F.lit(1)).alias("n"))


@query("s3_require_days", "SELECT country, count(*) AS n FROM log GROUP BY ALL")
def _(t):
    path = _log_table(t)
    logs.require_days(t.spark, [path])
    assert logs.done(t.spark, path)
    return t.spark.read.parquet(path).groupBy("country").agg(F.count(F.lit(1)).alias("n"))


@query("s4_latest_partition", """
    SELECT cd, count(*) AS n FROM log
    WHERE country = 'in' AND cd = (SELECT max(cd) FROM log WHERE country = 'in' AND cd <= '2024-02-03' AND cd > '2024-01-27') GROUP BY ALL""")
def _(t):
    table = f"{_log_table(t)}/country=in"
    day = logs.latest_partition(t.spark, table, "2024-02-03", 7)
    return t.spark.read.parquet(f"{table}/cd={day}").groupBy(F.lit(day).alias("cd")).agg(F.count(F.lit(1)).alias("n"))


@query("s5_materialize", """
    SELECT r.dw_p_id, count(*) AS requests, max(w.watches) AS watches, max(w.seconds) AS seconds FROM requests r
    JOIN (SELECT dw_p_id, count(*) AS watches, CAST(sum(watch_len) AS BIGINT) AS seconds FROM kwatch GROUP BY ALL) w USING (dw_p_id) GROUP BY ALL""")
def _(t):
    """Requests with one row of watch totals per user, written once and read for the extract."""
    totals = t.kwatch.groupBy("dw_p_id").agg(F.count(F.lit(1)).alias("watches"), F.sum("watch_len").alias("seconds"))
    once = logs.materialize(t.requests.select("dw_p_id", "event_id").join(totals, "dw_p_id"), scratch_path(t.spark, "joined"))
    return once.groupBy("dw_p_id").agg(F.count(F.lit(1)).alias("requests"), F.max("watches").alias("watches"), F.max("seconds").alias("seconds"))


@query("s6_read_csv", "SELECT dw_p_id, count(*) AS n FROM log WHERE event_type = 'error' AND value > 100 GROUP BY ALL")
def _(t):
    rows = t.log.filter("event_type = 'error' and value > 100").select("dw_p_id")
    path = _stored(t, "abnormal", lambda p: rows.write.csv(p))
    return logs.read_csv(t.spark, path, "dw_p_id string").groupBy("dw_p_id").agg(F.count(F.lit(1)).alias("n"))


@query("s7_packed_triples", """
    SELECT src, src_lang, dst, dst_lang, count(*) AS n, CAST(round(sum(score), 4) AS DOUBLE) AS score FROM (
        SELECT l_orderkey AS src, l_linenumber AS src_lang, l_suppkey AS dst, l_linenumber % 3 AS dst_lang, l_discount AS score FROM lineitem
        UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber % 5, l_tax FROM lineitem) GROUP BY ALL""")
def _(t):
    li = t.raw("lineitem")
    text = F.concat_ws(",", "l_suppkey", F.col("l_linenumber") % 3, "l_discount", "l_partkey", F.col("l_linenumber") % 5, "l_tax")
    rows = packed.explode_packed_triples(li.select("l_orderkey", "l_linenumber", text.alias("packed")), "l_orderkey", "l_linenumber", "packed")
    return rows.groupBy("src", "src_lang", "dst", "dst_lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("score"))


def _steps(t):
    text = F.concat_ws(",", F.lit(0), F.lit(0.1), "p_size", F.lit(0.5), F.col("p_size") * 2, F.round(F.col("p_retailprice") / 1000, 3))
    return t.raw("part").select("p_partkey", (F.col("p_partkey") % 3).cast("int").alias("language"), text.alias("packed"))


@query("s8_step_table", """
    SELECT p_partkey, CAST(p_partkey % 3 AS INTEGER) AS language, unnest([0, 1, 2])::INTEGER AS pos, unnest([0.0::DOUBLE, p_size, p_size * 2]) AS threshold,
           unnest([0.1::DOUBLE, 0.5, round(p_retailprice / 1000, 3)]) AS value FROM part""")
def _(t):
    return packed.explode_steps(_steps(t), ["p_partkey", "language"], "packed")


@query("j11_step_value", """
    SELECT w.content_id, w.watch_len, count(*) AS n, max(CASE WHEN p.p_partkey IS NULL THEN 1.0::DOUBLE WHEN w.watch_len / 60.0 - 1 < 0 THEN round(p_retailprice / 1000, 3)
           WHEN w.watch_len / 60.0 - 1 >= p_size * 2 THEN round(p_retailprice / 1000, 3) WHEN w.watch_len / 60.0 - 1 >= p_size THEN 0.5 ELSE 0.1 END) AS value
    FROM kwatch w LEFT JOIN part p ON p.p_partkey = w.content_id AND p.p_partkey % 3 = w.language GROUP BY ALL""")
def _(t):
    """Watches in a language that a title has no steps for get the default."""
    steps = _steps(t)
    thresholds, values = packed.step_arrays(F.col("packed"))
    dim = steps.select(F.col("p_partkey").alias("content_id"), "language", thresholds.alias("thr"), values.alias("val"))
    rows = t.kwatch.join(dim, ["content_id", "language"], "left")
    return rows.groupBy("content_id", "watch_len").agg(F.count(F.lit(1)).alias("n"), F.max(step_value(F.col("watch_len") - 60, F.col("thr"), F.col("val"))).alias("value"))


@query("s9_pivot_popularity", f"""
    SELECT day, content_id, language_id, {", ".join(f"coalesce(max(value) FILTER (tag = '{x}'), 0.0) AS {x}" for x in packed.POPULARITY_TAGS)}
    FROM pop_tags WHERE tag <> 'zz' GROUP BY day, content_id, language_id""")
def _(t):
    return packed.pivot_popularity(t.pop_tags)


_WINDOW_SQL = "SELECT *, rank() OVER (PARTITION BY state ORDER BY count) AS percentile FROM (SELECT country AS state, content_id, count(*) AS count FROM log WHERE timestamp >= {0} GROUP BY ALL)"


@query("s10_merge_windows", f"""
    WITH d1 AS ({_WINDOW_SQL.format(1706572800)}), d7 AS ({_WINDOW_SQL.format(1706054400)}), d30 AS ({_WINDOW_SQL.format(CUT - 86400 * 20)})
    SELECT state, content_id, coalesce(d1.count, 0)::DOUBLE AS dc, coalesce(d1.percentile, 0)::DOUBLE AS dv, coalesce(d7.count, 0)::DOUBLE AS wc,
           coalesce(d7.percentile, 0)::DOUBLE AS wv, coalesce(d30.count, 0)::DOUBLE AS mc, coalesce(d30.percentile, 0)::DOUBLE AS mv
    FROM d1 FULL JOIN d7 USING (state, content_id) FULL JOIN d30 USING (state, content_id)""")
def _(t):
    def window(start):
        counts = t.log.filter(F.col("timestamp") >= start).groupBy(F.col("country").alias("state"), "content_id").agg(F.count(F.lit(1)).alias("count"))
        return counts.withColumn("percentile", F.rank().over(Window.partitionBy("state").orderBy("count")))

    return packed.merge_windows(window(1706572800), window(1706054400), window(CUT - 86400 * 20))


@query("s11_union_countries", "SELECT country, dw_p_id, count(*) AS n FROM log GROUP BY ALL")
def _(t):
    both = logs.union_countries([t.log.filter("country = 'in'"), t.log.filter("country = 'my'")], 8)
    return both.groupBy("country", "dw_p_id").agg(F.count(F.lit(1)).alias("n"))


@query("s12_write_by_user", "SELECT dw_p_id, count(*) AS n, CAST(sum(watch_len) AS BIGINT) AS seconds FROM kwatch GROUP BY ALL")
def _(t):
    path = scratch_path(t.spark, "by-user")
    logs.write_by_user(t.kwatch, path, 4)
    return t.spark.read.parquet(path).groupBy("dw_p_id").agg(F.count(F.lit(1)).alias("n"), F.sum("watch_len").alias("seconds"))


@query("s12_bucketed_joins", """
    WITH c AS (SELECT dw_p_id, count(*) AS clicks FROM log WHERE event_type = 'click' GROUP BY ALL), s AS (SELECT DISTINCT dw_p_id FROM log WHERE event_type = 'signup' AND k % 4 = 0)
    SELECT dw_p_id, count(*) AS n, CAST(sum(watch_len) AS BIGINT) AS seconds, max(clicks) AS clicks FROM kwatch LEFT JOIN c USING (dw_p_id) WHERE dw_p_id NOT IN (SELECT dw_p_id FROM s) GROUP BY ALL""")
def _(t):
    """Watches, clicks per user and users to leave out, each stored by user; the joins read buckets as they lie."""
    heavy = logs.stage(bucketed.heavy_users(t.kwatch, 12), "heavy")
    clicks = t.between("click").groupBy("dw_p_id").agg(rows_n("clicks"))
    out = t.between("signup").filter("k % 4 = 0").select("dw_p_id").distinct()
    stored = {}
    for name, df, lookup in (("watches", t.kwatch, False), ("clicks", clicks, True), ("left_out", out, True)):
        table = f"{name}_{uuid.uuid4().hex}"
        bucketed.write_bucketed(df, table, scratch_path(t.spark, name), 8, heavy, lookup=lookup)
        stored[name] = t.spark.table(table)
    kept = stored["watches"].join(stored["left_out"].hint("merge"), ["dw_p_id", bucketed.PART], "left_anti")
    return bucketed.join_users(kept, stored["clicks"], "left").groupBy("dw_p_id").agg(
        rows_n(), F.sum("watch_len").alias("seconds"), F.max("clicks").alias("clicks"))


@query("s13_append", "SELECT horizon, count(*) AS n FROM kwatch, (VALUES (1), (7)) h(horizon) GROUP BY ALL")
def _(t):
    """One horizon is run twice; its rows are those of one run."""
    path = scratch_path(t.spark, "append")
    for n in (1, 7, 1):
        versions.write_increment(t.kwatch, path, {"horizon": n})
    return t.spark.read.parquet(path).groupBy("horizon").agg(F.count(F.lit(1)).alias("n"))


@query("s13_increment_stats", """
    SELECT CAST(h.horizon AS INTEGER) AS horizon, count(*) FILTER (w.watch_len > h.horizon * 60) AS n, CAST(sum(watch_len) FILTER (w.watch_len > h.horizon * 60) AS BIGINT) AS seconds
    FROM kwatch w, (VALUES (1), (7), (1000000)) h(horizon) GROUP BY h.horizon""")
def _(t):
    """Counts of each increment from its writing pass; the last one has no rows and leaves no rows of its first run."""
    path = scratch_path(t.spark, "increments")
    versions.write_increment(t.kwatch, path, {"horizon": 1000000})
    facts = [
        (h, versions.write_increment(t.kwatch.filter(F.col("watch_len") > h * 60), path, {"horizon": h}, seconds=F.sum("watch_len")))
        for h in (1, 7, 1000000)
    ]
    left = t.spark.read.parquet(path).groupBy("horizon").agg(F.count(F.lit(1)).alias("rows"))
    rows = [versions.to_rows(t.spark, f).withColumn("horizon", F.lit(h)) for h, f in facts]
    said = reduce(DataFrame.unionByName, rows)
    # the table holds what the counts say
    return said.join(left, "horizon", "left").filter(F.coalesce("rows", F.lit(0)) == F.col("n")).drop("rows")


@query("s14_write_csv1", "SELECT content_id, count(*) AS n FROM kwatch GROUP BY ALL")
def _(t):
    path = scratch_path(t.spark, "report")
    logs.write_csv1(t.kwatch.groupBy("content_id").agg(F.count(F.lit(1)).alias("n")), path)
    return logs.read_csv(t.spark, path, "content_id bigint, n bigint", header=True)


@query("s15_stats_and_pointer", "SELECT cd AS version, count(*) AS n FROM log WHERE cd = (SELECT max(cd) FROM log) GROUP BY ALL")
def _(t):
    path = scratch_path(t.spark, "stats")
    logs.write_stats(t.log.groupBy(F.col("cd").alias("version")).agg(F.count(F.lit(1)).alias("n")), path)
    return logs.current_version(t.spark.read.schema("version string, n bigint").json(path))


@query("s15_published", "SELECT cd AS version, dw_p_id, count(*) AS n FROM log WHERE cd = (SELECT max(cd) FROM log) GROUP BY ALL")
def _(t):
    """The newest day is published; a later one, written half way, and a pointer without its marker do not count."""
    path = scratch_path(t.spark, "published")
    days = [r[0] for r in t.log.groupBy("cd").agg(rows_n()).orderBy("cd").select("cd").tail(2)]
    for cd in days:
        versions.write_version(t.log.filter(F.col("cd") == cd).select("dw_p_id"), path, cd)
        versions.publish(t.spark, path, cd, {"day": cd})
    versions.write_version(t.log.select("dw_p_id"), path, "9999-12-31")
    logs.unmark(t.spark, f"{path}/version=9999-12-31")
    now = versions.published(t.spark, path).select("version").scalar()
    return versions.read_published(t.spark, path).groupBy(now.alias("version"), "dw_p_id").agg(rows_n())


@query("s16_insert_into", "SELECT content_id, popularity_tag, count(*) AS n FROM tags GROUP BY ALL")
def _(t):
    tag = uuid.uuid4().hex
    base, copy = f"tags_{tag}", f"tags_copy_{tag}"
    t.spark.sql(f"CREATE TABLE {base} (content_id BIGINT, popularity_tag STRING) USING PARQUET LOCATION '{scratch_path(t.spark, 'tags')}'")
    logs.create_like(t.spark, copy, base, scratch_path(t.spark, "tags-copy"))
    logs.insert_into(copy, t.tags)
    return t.spark.table(copy).groupBy("content_id", "popularity_tag").agg(F.count(F.lit(1)).alias("n"))


@query("s17_decode_watches", """
    SELECT event_id, content_id, language, watch_len, first_watch, last_watch FROM (
        SELECT event_id, content_id, language, watch_time AS watch_len, timestamp AS first_watch, timestamp AS last_watch FROM log
        UNION ALL SELECT event_id, k, language + 1, watch_time * 2, timestamp - 10, timestamp + 10 FROM log)""")
def _(t):
    long = lambda c: F.col(c).cast("bigint") if isinstance(c, str) else c.cast("bigint")
    flat = F.array(*[long(c) for c in (
        "content_id", "language", "watch_time", "timestamp", "timestamp", "k", F.col("language") + 1, F.col("watch_time") * 2, F.col("timestamp") - 10, F.col("timestamp") + 10)])
    rows = t.log.select("event_id", F.inline(packed.decode_watches(flat)))
    return rows.withColumn("language", F.col("language").cast("int"))


@query("s18_pack_items", """
    SELECT dw_p_id AS id, CAST(content_id AS VARCHAR) AS item, CAST(1706659200 AS BIGINT) AS updated_at, CAST(1706659200 + 63072000 AS BIGINT) AS ttl
    FROM kwatch WHERE watch_len > 600 GROUP BY ALL""")
def _(t):
    lists = t.kwatch.groupBy("dw_p_id").agg(F.collect_set(F.when(F.col("watch_len") > 600, F.col("content_id"))).alias("ids"))
    return packed.pack_items(lists, "dw_p_id", "ids", 1706659200).select("id", F.explode("items").alias("item"), "updated_at", "ttl")
