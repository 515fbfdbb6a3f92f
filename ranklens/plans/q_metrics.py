"""Queries for aggregations, windows and ranking evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ranklens.operators import aggregates, keyed, metrics, popularity
from ranklens.operators.filters import mask_labels
from ranklens.plans.domain import WEEK0
from ranklens.plans.q_filters import CLEAN_SQL
from ranklens.plans.registry import ORACLES, query, rows_n
from ranklens.session import scratch_path
from ranklens.sources import versions
from ranklens.sources.logs import stage

REQ = ["dw_p_id", "timestamp"]


def r6(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


# ---- aggregations


@query("a1_nest", """
    SELECT dw_p_id, timestamp // 86400 AS day, CAST(row_number() OVER (PARTITION BY dw_p_id, timestamp // 86400 ORDER BY timestamp, content_id, full_tray_id) - 1 AS INTEGER) AS pos, timestamp, content_id, full_tray_id FROM clicks""")
def _(t):
    """Every element of every list with its place."""
    nested = aggregates.nest(t.clicks, "dw_p_id", ["timestamp", "content_id", "full_tray_id"], "clicks")
    return nested.select("dw_p_id", "day", F.posexplode("clicks").alias("pos", "e")).select("dw_p_id", "day", "pos", "e.*")


@query("a2_agg_watch", "SELECT dw_p_id, content_id, CAST(sum(watch_len) AS BIGINT) AS seconds, min(first_watch) AS first_watch, count(*) AS n FROM kwatch GROUP BY ALL")
def _(t):
    return aggregates.agg_watch(t.kwatch, ["dw_p_id", "content_id"], seconds=F.sum("watch_len"), first_watch=F.min("first_watch"), n=F.count(F.lit(1)))


@query("a3_grouping_sets", "SELECT sub_title_id, count(DISTINCT dw_p_id) AS viewers, CAST(grouping(sub_title_id) AS INTEGER) AS is_total FROM view_log GROUP BY GROUPING SETS ((sub_title_id), ())")
def _(t):
    return popularity.viewers(t.view_log)


@query("a4_distinct_items", "SELECT dw_p_id, timestamp, count(DISTINCT content_id) AS items FROM scored GROUP BY ALL")
def _(t):
    return aggregates.distinct_items(t.scored, REQ)


_SKETCHED = "SELECT content_id, count(DISTINCT dw_p_id) AS viewers, true AS within FROM log GROUP BY ALL"


@query("a4_item_sketches", _SKETCHED)
def _(t):
    """Distinct viewers per title from one sketch per day: exact beside estimated, which is within 4 standard errors."""
    days = aggregates.item_sketches(t.log, ["cd", "content_id"], "dw_p_id")
    about = aggregates.sketched_items(aggregates.merge_sketches(days, ["content_id"])).withColumnRenamed("items", "about")
    exact = aggregates.distinct_items(t.log, ["content_id"], "dw_p_id").withColumnRenamed("items", "viewers")
    most = 4 * 1.04 / 2 ** (aggregates.SKETCH_BITS / 2)
    near = F.abs(F.col("about") - F.col("viewers")) <= F.col("viewers") * most + 0.5
    return exact.join(about, "content_id").select("content_id", "viewers", near.alias("within"))


@query("a5_sum_days", "SELECT o_custkey, " + ", ".join(f"CAST(sum(CASE WHEN l_linenumber = {i + 1} THEN l_quantity ELSE 0 END) AS BIGINT) AS wt_{i}, count(*) FILTER (l_linenumber > {i}) AS seen_{i}" for i in range(7)) + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def _(t):
    line = F.col("l_linenumber")
    wt = F.array(*[F.when(line == i + 1, F.col("l_quantity")).otherwise(0).cast("bigint") for i in range(7)])
    seen = F.array(*[F.when(line > i, 1).otherwise(0) for i in range(7)])
    return aggregates.sum_days(t._orders().select("o_custkey", wt.alias("wt"), seen.alias("seen")), "o_custkey", ["wt", "seen"], 7)


HIST_SQL = "SELECT content_id, CAST(ceil(watch_time / 60) AS BIGINT) AS minute, count(*) AS n FROM curve_watches WHERE watch_time > 0 GROUP BY ALL"


@query("a6_minute_hist", HIST_SQL)
def _(t):
    return aggregates.minute_hist(t.curve_watches, "content_id", "watch_time")


def greedy_sql(source: str, key: str, start: str, early: str, scale: int, max_bins: int) -> str:
    """Recursive form of the greedy bins over ``source`` (key, value, n, rn, per_bin)."""
    return f"""
        WITH RECURSIVE src AS MATERIALIZED ({source}),
        bin_fold AS (
            SELECT {key}, CAST(0 AS BIGINT) AS rn, {start} AS edges, CAST(0 AS BIGINT) AS filled FROM (SELECT DISTINCT {key} FROM src)
            UNION ALL
            SELECT f.{key}, s.rn, CASE WHEN {early} f.filled + s.n >= s.per_bin THEN list_append(f.edges, s.value * {scale}) ELSE f.edges END,
                   CASE WHEN {early} f.filled + s.n >= s.per_bin THEN 0 ELSE f.filled + s.n END
            FROM bin_fold f JOIN src s ON s.{key} = f.{key} AND s.rn = f.rn + 1),
        edges AS (SELECT {key}, arg_max(edges, rn)[1:{max_bins}] AS edges FROM bin_fold GROUP BY {key})"""


def freq_sql(hist: str, max_bins: int, min_per_bin: int) -> str:
    source = f"""
        SELECT content_id, minute AS value, n, row_number() OVER (PARTITION BY content_id ORDER BY minute) AS rn,
               total // greatest(least(total // {min_per_bin}, {max_bins - 1}), 1) AS per_bin
        FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY content_id) AS BIGINT) AS total FROM ({hist}))"""
    return greedy_sql(source, "content_id", "[CAST(0 AS BIGINT)]", f"(s.value = 1 AND f.filled + s.n >= {min_per_bin}) OR", 60, max_bins)


@query("a7_freq_bins", freq_sql(HIST_SQL, 12, 20) + " SELECT content_id, generate_subscripts(edges, 1) - 1 AS bin, unnest(edges) AS edge FROM edges")
def _(t):
    hist = aggregates.minute_hist(t.curve_watches, "content_id", "watch_time")
    edges = aggregates.freq_bins(hist, "content_id", 12, 20)
    return edges.select("content_id", F.posexplode("edges").alias("bin", "edge")).withColumn("bin", F.col("bin").cast("bigint"))


_MASS_SQL = "SELECT kind, CAST(watch_len // 60 * 60 AS BIGINT) AS second, count(*) AS n FROM kwatch JOIN catalog USING (content_id) GROUP BY ALL"


@query("a8_cluster_bins", greedy_sql(f"""
        SELECT kind, second AS value, n, row_number() OVER (PARTITION BY kind ORDER BY second) AS rn, CAST(sum(n) OVER (PARTITION BY kind) AS BIGINT) // 18 AS per_bin
        FROM ({_MASS_SQL}) WHERE second > 60""", "kind", "[CAST(0 AS BIGINT), CAST(60 AS BIGINT)]", "", 1, 20)
       + " SELECT kind, generate_subscripts(edges, 1) - 1 AS bin, unnest(edges) AS edge FROM edges")
def _(t):
    second = (F.floor(F.col("watch_len") / 60) * 60).cast("bigint")
    mass = t.kwatch.join(t.catalog, "content_id").groupBy("kind", second.alias("second")).agg(rows_n())
    edges = aggregates.cluster_bins(mass, "kind", 20)
    return edges.select("kind", F.posexplode("edges").alias("bin", "edge")).withColumn("bin", F.col("bin").cast("bigint"))


@query("a9_task_stats", "SELECT task, count(*) AS n, count(*) FILTER (click > 0) AS post_click, round(count(*) / (SELECT count(*) FROM scored), 6) AS share FROM scored GROUP BY task")
def _(t):
    return aggregates.task_stats(t.scored).withColumn("share", F.round("share", 6))


_EXAMPLES = """
    SELECT count(*) AS users, CAST(sum(coalesce(c, 0)) AS BIGINT) AS clicks_examples, CAST(sum(coalesce(w, 0)) AS BIGINT) AS watches_examples, count(c) AS clicks_users, count(w) AS watches_users
    FROM (SELECT dw_p_id, count(*) AS c FROM clicks GROUP BY ALL) FULL JOIN (SELECT dw_p_id, count(*) AS w FROM daily GROUP BY ALL) USING (dw_p_id)"""


@query("a10_example_stats", _EXAMPLES)
def _(t):
    one = lambda df, name: df.groupBy("dw_p_id").agg(rows_n(name))
    return aggregates.example_stats(one(t.clicks, "clicks").join(one(t.daily, "watches"), "dw_p_id", "full"), ["clicks", "watches"])


def _written(t, df, counters):
    """One row of aggregates of ``df``, taken while it is written."""
    return versions.to_rows(t.spark, versions.write_observed(df, scratch_path(t.spark, "counted"), **counters))


@query("a9_written_stats", "SELECT task, count(*) AS n, count(*) FILTER (click > 0) AS post_click, round(count(*) / (SELECT count(*) FROM scored), 6) AS share FROM scored GROUP BY task")
def _(t):
    """The task shares of a table, from the pass that writes it."""
    facts = versions.write_observed(t.scored, scratch_path(t.spark, "counted"), **aggregates.task_counters([0, 1]))
    rows = t.spark.createDataFrame(aggregates.task_rows(facts, [0, 1]), "task long, n long, post_click long, share double")
    return rows.withColumn("share", F.round("share", 6))


@query("a10_written_stats", _EXAMPLES)
def _(t):
    one = lambda df, name: df.groupBy("dw_p_id").agg(rows_n(name))
    counts = one(t.clicks, "clicks").join(one(t.daily, "watches"), "dw_p_id", "full")
    return _written(t, counts, aggregates.example_counters(["clicks", "watches"]))


@query("a11_profile", """
    WITH rows AS (SELECT w.dw_p_id, w.watch_len AS wt, c.* FROM kwatch w JOIN catalog c USING (content_id)),
    long AS (SELECT dw_p_id, 'studio_id' AS attr, CAST(studio_id AS VARCHAR) AS value, wt FROM rows UNION ALL SELECT dw_p_id, 'parental_rating', CAST(parental_rating AS VARCHAR), wt FROM rows
             UNION ALL SELECT dw_p_id, 'content_type_id', CAST(content_type_id AS VARCHAR), wt FROM rows UNION ALL SELECT dw_p_id, 'production_house_id', CAST(production_house_id AS VARCHAR), wt FROM rows
             UNION ALL SELECT dw_p_id, 'genre', CAST(unnest(genre_ids) AS VARCHAR), wt FROM rows)
    SELECT dw_p_id, attr, value, round(w / sum(w) OVER (PARTITION BY dw_p_id, attr), 6) AS share FROM (SELECT dw_p_id, attr, value, CAST(sum(wt) AS DOUBLE) AS w FROM long GROUP BY ALL)""")
def _(t):
    return aggregates.profile(t.kwatch, t.catalog, ["dw_p_id"], "watch_len").withColumn("share", F.round("share", 6))


_Z = ", ".join(f"({c} - (SELECT avg({c}) FROM scored)) / (SELECT stddev_samp({c}) FROM scored) AS {c}" for c in ("base", "sd", "mean"))
ZSCORED = f"SELECT event_id, dw_p_id, timestamp, content_id, label, category, {_Z} FROM tagged"


@query("a12_zscore", f"SELECT event_id, round(base, 6) AS base, round(sd, 6) AS sd, round(mean, 6) AS mean FROM ({ZSCORED})")
def _(t):
    return aggregates.zscore(t.scored, ["base", "sd", "mean"]).select("event_id", *r6("base", "sd", "mean"))


@query("a12_rescale", """
    SELECT event_id, round((sd - (SELECT avg(sd) FROM scored)) / (SELECT stddev_samp(sd) FROM scored) * (SELECT stddev_samp(base) FROM scored) + (SELECT avg(base) FROM scored), 6) AS scaled FROM scored""")
def _(t):
    return aggregates.rescale(t.scored, "sd", "base", "scaled").select("event_id", *r6("scaled"))


@query("a13_describe_by", """
    SELECT category, count(base) AS count, round(avg(base), 6) AS mean, round(stddev_samp(base), 6) AS std, min(base) AS min, max(base) AS max, round(quantile_cont(base, 0.25), 6) AS p25,
           round(quantile_cont(base, 0.5), 6) AS p50, round(quantile_cont(base, 0.75), 6) AS p75 FROM tagged GROUP BY category""")
def _(t):
    return aggregates.describe_by(t.tagged, "category", "base").select("category", "count", "min", "max", *r6("mean", "std", "p25", "p50", "p75"))


@query("a14_label_mix", "SELECT *, round(n / sum(n) OVER (PARTITION BY label), 6) AS share FROM (SELECT label, category, count(*) AS n FROM tagged GROUP BY ALL)")
def _(t):
    return aggregates.label_mix(t.tagged, "category", "label").withColumn("share", F.round("share", 6))


@query("a15_request_sizes", "SELECT " + ", ".join(f"round(quantile_cont(n, {i / 10}), 4) AS q{i}" for i in range(11)) + " FROM (SELECT count(*)::DOUBLE AS n FROM scored GROUP BY dw_p_id, timestamp)")
def _(t):
    return aggregates.request_sizes(t.scored, REQ).select(*[F.round(f"q{i}", 4).alias(f"q{i}") for i in range(11)])


_COUNTERS = "SELECT count(*) AS predicted, count(*) FILTER (n = 0) AS empty, CAST(sum(n) AS BIGINT) AS total FROM (SELECT dw_p_id, count(DISTINCT CASE WHEN watch_len > 2000 THEN content_id END) AS n FROM kwatch GROUP BY ALL)"


@query("a16_counters", _COUNTERS)
def _(t):
    return aggregates.counters(t.kwatch.groupBy("dw_p_id").agg(F.collect_set(F.when(F.col("watch_len") > 2000, F.col("content_id"))).alias("items")))


@query("a16_written_counters", _COUNTERS)
def _(t):
    """The job counters of a table of predictions, from the pass that writes it."""
    lists = t.kwatch.groupBy("dw_p_id").agg(F.collect_set(F.when(F.col("watch_len") > 2000, F.col("content_id"))).alias("items"))
    return _written(t, lists, aggregates.result_counters())


@query("a17_last_by", "SELECT dw_p_id, content_id, arg_max(watch_len, (last_watch, watch_len)) AS watch_len FROM kwatch GROUP BY ALL")
def _(t):
    return aggregates.last_by(t.kwatch, ["dw_p_id", "content_id"], "watch_len", ["last_watch"])


@query("a18_corr", "SELECT round(corr(base, sd), 6) AS corr FROM scored")
def _(t):
    return aggregates.corr(t.scored, "base", "sd").select(*r6("corr"))


@query("a18_hist", "SELECT CASE WHEN value < 0 THEN 0 WHEN value >= 200 THEN 21 ELSE CAST(floor(value / 10) AS BIGINT) + 1 END::BIGINT AS bucket, count(*) AS n FROM log GROUP BY ALL")
def _(t):
    return aggregates.hist(t.log, "value", 0.0, 200.0, 20)


# ---- windows, order, set operations


@query("w1_first_by_key", "SELECT dw_p_id, content_id, arg_max(language, (s, -language)) AS language, max(s) AS seconds FROM (SELECT dw_p_id, content_id, language, CAST(sum(watch_time) AS BIGINT) AS s FROM curve_watches GROUP BY ALL) GROUP BY dw_p_id, content_id")
def _(t):
    sums = t.curve_watches.groupBy("dw_p_id", "content_id", "language").agg(F.sum("watch_time").alias("seconds")).withColumn("neg", -F.col("language"))
    return keyed.pick_one(sums, ["dw_p_id", "content_id"], ["seconds", "neg"]).drop("neg")


RANK_SQL = "SELECT *, rank() OVER (PARTITION BY dw_p_id, timestamp ORDER BY {0} DESC) + (count(*) OVER (PARTITION BY dw_p_id, timestamp, {0}) - 1) / 2.0::DOUBLE AS rank FROM {1}"


@query("w2_avg_rank", f"SELECT event_id, rank FROM ({RANK_SQL.format('value', '(SELECT *, (timestamp - ' + str(WEEK0) + ') // 604800 AS w FROM log)').replace('dw_p_id, timestamp', 'dw_p_id, w')})")
def _(t):
    rows = t.log.withColumn("w", F.floor((F.col("timestamp") - WEEK0) / 604800))
    return metrics.avg_rank(rows, ["dw_p_id", "w"], "value").select("event_id", "rank")


_TIED = "(SELECT event_id, dw_p_id, timestamp, content_id, label, CAST(floor(base * 50) AS BIGINT) AS base FROM scored)"


@query("w3_rank_at_k", f"SELECT event_id, rank, 'le' AS mode FROM ({RANK_SQL.format('base', _TIED)}) WHERE rank <= 3 UNION ALL SELECT event_id, rank, 'eq' FROM ({RANK_SQL.format('base', _TIED)}) WHERE rank = 3")
def _(t):
    rows = t.scored.withColumn("base", F.floor(F.col("base") * 50).cast("bigint"))
    le, eq = (metrics.at_k(rows, REQ, "base", 3, m).select("event_id", "rank", F.lit(m).alias("mode")) for m in ("le", "eq"))
    return le.unionByName(eq)


@query("w6_cumsum", "SELECT content_id, watch_dt, CAST(sum(s) OVER (PARTITION BY content_id ORDER BY watch_dt) AS BIGINT) AS total FROM (SELECT content_id, watch_dt, sum(watch_time) AS s FROM curve_watches GROUP BY ALL)")
def _(t):
    daily = t.curve_watches.groupBy("content_id", "watch_dt").agg(F.sum("watch_time").alias("s"))
    return daily.select("content_id", "watch_dt", F.sum("s").over(Window.partitionBy("content_id").orderBy("watch_dt")).alias("total"))


@query("w9_global_order", "SELECT sub_title_id, count(*) AS n FROM view_log GROUP BY ALL ORDER BY n DESC, sub_title_id")
def _(t):
    return t.view_log.groupBy("sub_title_id").agg(rows_n()).orderBy(F.desc("n"), "sub_title_id")


@query("w10_last_n", "SELECT dw_p_id, event_id FROM log QUALIFY row_number() OVER (PARTITION BY dw_p_id ORDER BY timestamp DESC, event_id) <= 20")
def _(t):
    return keyed.top_n(t.log, ["dw_p_id"], [F.col("timestamp").desc(), F.col("event_id")], 20).select("dw_p_id", "event_id")


@query("w11_set_operations", "SELECT dw_p_id, content_id FROM ((SELECT dw_p_id, content_id FROM clicks UNION SELECT dw_p_id, content_id FROM daily) EXCEPT SELECT dw_p_id, content_id FROM history)")
def _(t):
    keys = ["dw_p_id", "content_id"]
    return t.clicks.select(*keys).union(t.daily.select(*keys)).distinct().subtract(t.history.select(*keys))


# ---- ranking evaluation


def blended(t):
    """Standardised scores, written once as every metric reads them, times the blends."""
    standard = aggregates.zscore(t.tagged, ["base", "sd", "mean"]).select("event_id", *REQ, "content_id", "label", "category", "base", "sd", "mean")
    return metrics.blend(stage(standard, "standardised"))


_BLENDS = " UNION ALL ".join(f"SELECT *, '{n}' AS blend, {a} * base + {b} * sd + {c} * mean AS score FROM z" for n, (a, b, c) in metrics.BLENDS.items())


@query("b12_blend", f"WITH z AS ({ZSCORED}) SELECT event_id, blend, round(score, 6) AS score FROM ({_BLENDS})")
def _(t):
    return blended(t).select("event_id", "blend", *r6("score"))


@query("m1_validation_set", """
    SELECT dw_p_id, timestamp, content_id, count(*) AS n FROM scored WHERE task = 0 AND (dw_p_id, timestamp) IN (
        SELECT (dw_p_id, timestamp) FROM scored WHERE task = 0 GROUP BY dw_p_id, timestamp HAVING count(DISTINCT content_id) >= 5 AND max(click) = 1) GROUP BY ALL""")
def _(t):
    return metrics.validation_set(t.scored.withColumn("flag", F.col("task"))).groupBy("dw_p_id", "timestamp", "content_id").agg(rows_n())


def ndcg_sql(source: str, score: str, label: str, ks=(1, 3, 5), by="dw_p_id, timestamp") -> str:
    """Per-request NDCG: tie groups share their mean gain."""
    cols = ", ".join(f"""CASE WHEN max({label}) = min({label}) THEN 0.0 ELSE sum(mean_gain / log2(pos + 1)) FILTER (pos <= {k}) / sum({label} / log2(ideal_pos + 1)) FILTER (ideal_pos <= {k}) END AS ndcg_{k}""" for k in ks)
    return f"""SELECT {by}, {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {score} DESC) AS pos, row_number() OVER (PARTITION BY {by} ORDER BY {label} DESC) AS ideal_pos,
        avg({label}) OVER (PARTITION BY {by}, {score}) AS mean_gain FROM {source}) GROUP BY {by} HAVING count(*) >= {max(ks)}"""


@query("m2_request_ndcg", f"SELECT dw_p_id, timestamp, round(ndcg_1, 6) AS ndcg_1, round(ndcg_3, 6) AS ndcg_3, round(ndcg_5, 6) AS ndcg_5 FROM ({ndcg_sql(_TIED, 'base', 'label')})")
def _(t):
    rows = t.scored.withColumn("base", F.floor(F.col("base") * 50).cast("bigint"))
    return metrics.request_ndcg(rows, REQ, "base", "label").select(*REQ, *r6("ndcg_1", "ndcg_3", "ndcg_5"))


_PER_BLEND = ndcg_sql("s", "score", "label", by="blend, dw_p_id, timestamp")


@query("m2_ndcg", f"""
    WITH z AS ({ZSCORED}), s AS (SELECT * REPLACE (round(score, 9) AS score) FROM ({_BLENDS})), r AS ({_PER_BLEND}), m AS (SELECT blend, avg(ndcg_1) AS a, avg(ndcg_3) AS b, avg(ndcg_5) AS c FROM r GROUP BY blend)
    SELECT blend, CAST(unnest([1, 3, 5]) AS BIGINT) AS k, round(unnest([a, b, c]), 6) AS value FROM m""")
def _(t):
    """Mean NDCG of all blends from one pass: the blend is part of the request key."""
    rows = blended(t).withColumn("score", F.round("score", 9))
    return metrics.ndcg_at(rows, REQ, "score", "label", group=["blend"]).select("blend", "k", *r6("value"))


_RANKED = RANK_SQL.format("base", "tagged")


@query("m3_popularity_mix", f"""
    SELECT k, category, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY k), 2) AS value FROM ({_RANKED}), (VALUES (1::BIGINT), (3), (5)) v(k) WHERE rank <= v.k GROUP BY k, category""".replace("SELECT k, category", "SELECT v.k AS k, category").replace("PARTITION BY k", "PARTITION BY v.k").replace("GROUP BY k", "GROUP BY v.k"))
def _(t):
    return metrics.popularity_mix_at(t.tagged, REQ, "base", "category").drop("metric")


@query("m4_catalog", f"SELECT v.k AS k, count(DISTINCT content_id)::DOUBLE AS value FROM ({_RANKED}), (VALUES (1::BIGINT), (3), (5)) v(k) WHERE rank <= v.k GROUP BY v.k")
def _(t):
    return metrics.catalog_at(t.tagged, REQ, "base", "content_id").drop("metric")


_PERP = "SELECT k, round(pow(2, -sum(n / t * log2(n / t))), 6) AS value FROM (SELECT *, sum(n) OVER (PARTITION BY k) AS t FROM (SELECT v.k AS k, content_id, count(*)::DOUBLE AS n FROM ({0}), (VALUES (1::BIGINT), (3), (5)) v(k) WHERE rank {1} v.k GROUP BY v.k, content_id)) GROUP BY k"


@query("m5_perplexity", _PERP.format(_RANKED, "="))
def _(t):
    return metrics.perplexity_at(t.tagged, REQ, "base", "content_id").select("k", *r6("value"))


@query("m5_perplexity_le", _PERP.format(_RANKED, "<="))
def _(t):
    return metrics.perplexity_at(t.tagged, REQ, "base", "content_id", mode="le").select("k", *r6("value"))


def auc_sql(source: str, score: str, label: str, by: str = "") -> str:
    part, group = (f"PARTITION BY {by} ", f"GROUP BY {by}") if by else ("", "")
    lead = f"{by}, " if by else ""
    return f"""SELECT {lead}(sum(CASE WHEN {label} > 0 THEN r END) - count(*) FILTER ({label} > 0) * (count(*) FILTER ({label} > 0) + 1) / 2.0::DOUBLE)
        / (count(*) FILTER ({label} > 0)::DOUBLE * count(*) FILTER ({label} <= 0)) AS auc
        FROM (SELECT *, rank() OVER ({part}ORDER BY {score}) + (count(*) OVER (PARTITION BY {lead}{score}) - 1) / 2.0::DOUBLE AS r FROM {source}) {group}"""


_USERS = f"(SELECT * FROM (SELECT event_id, dw_p_id, label, floor(base * 20) / 4 - 2 AS logit FROM scored) WHERE dw_p_id IN (SELECT dw_p_id FROM scored GROUP BY dw_p_id HAVING max(label) > 0 AND min(label) <= 0))"
_LOSS = lambda y, z: f"avg(-({y} * ln(least(greatest(1 / (1 + exp(-{z})), 1e-8), 1 - 1e-8)) + (1 - {y}) * ln(1 - least(greatest(1 / (1 + exp(-{z})), 1e-8), 1 - 1e-8))))"


@query("m6_user_metrics", f"""
    WITH u AS {_USERS},
    pos AS (SELECT *, row_number() OVER (PARTITION BY dw_p_id ORDER BY logit DESC) AS pos, row_number() OVER (PARTITION BY dw_p_id ORDER BY label DESC) AS ipos, avg(label) OVER (PARTITION BY dw_p_id, logit) AS gain,
                   sum(label) OVER (PARTITION BY dw_p_id ORDER BY logit DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / count(*) OVER (PARTITION BY dw_p_id ORDER BY logit DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prec FROM u),
    per AS (SELECT dw_p_id, sum(label * prec) / sum(label) AS ap, sum(gain / log2(pos + 1)) / sum(label / log2(ipos + 1)) AS ndcg FROM pos GROUP BY dw_p_id), a AS ({auc_sql('u', 'logit', 'label', 'dw_p_id')})
    SELECT count(*) AS num_users, round(avg(ap), 6) AS map, round(avg(ndcg), 6) AS ndcg, round(avg(a.auc), 6) AS group_auc, round((SELECT auc FROM ({auc_sql('u', 'logit', 'label')})), 6) AS auc,
           round((SELECT {_LOSS('label', 'logit')} FROM u), 6) AS loss FROM per JOIN a USING (dw_p_id)""")
def _(t):
    rows = t.scored.select("event_id", "dw_p_id", "label", (F.floor(F.col("base") * 20) / 4 - 2).alias("logit"))
    return metrics.user_metrics(stage(rows, "evaluated"), "logit", "label").select("num_users", *r6("map", "ndcg", "group_auc", "auc", "loss"))


@query("m7_pooled_auc", f"SELECT round(auc, 6) AS auc FROM ({auc_sql('scored', 'base', 'label')})")
def _(t):
    return metrics.pooled_auc(t.scored, "base", "label").select(*r6("auc"))


@query("m8_log_loss", f"SELECT round({_LOSS('label', '(base * 10 - 2)')}, 6) AS log_loss FROM scored")
def _(t):
    return metrics.log_loss(t.scored.withColumn("z", F.col("base") * 10 - 2), "label", "z").select(*r6("log_loss"))


@query("m9_rmse", "SELECT round(sqrt(avg(pow(base - sd, 2))), 6) AS rmse FROM scored")
def _(t):
    return metrics.rmse(t.scored, "base", "sd").select(*r6("rmse"))


@query("m10_task_metrics", f"""
    WITH long AS (SELECT 'click' AS task, click::DOUBLE AS y, base * 10 - 2 AS logit FROM scored WHERE task = 0 UNION ALL SELECT 'random_watch', label::DOUBLE, sd * 4 - 2 FROM scored WHERE task = 1
                  UNION ALL SELECT 'watch', (content_id % 2)::DOUBLE, mean * 4 - 2 FROM scored WHERE task = 0 AND click > 0),
    aucs AS (SELECT * FROM ({auc_sql('long', 'logit', 'y', 'task')}))
    SELECT task, count(*) AS n, round({_LOSS('y', 'logit')}, 6) AS log_loss, round(max(CASE WHEN aucs.auc = aucs.auc THEN aucs.auc END), 6) AS auc FROM long JOIN aucs USING (task) GROUP BY task""")
def _(t):
    rows = t.scored.select("task", "click", F.when(F.col("task") == 1, F.col("label")).otherwise(F.col("content_id") % 2).alias("watch"), F.lit(0).alias("paywall_view"),
                           F.lit(0).alias("add_watchlist"), (F.col("base") * 10 - 2).alias("z1"), (F.col("sd") * 4 - 2).alias("z2"), (F.col("mean") * 4 - 2).alias("z3"))
    out = metrics.task_metrics(mask_labels(rows), [("click", "z1"), ("random_watch", "z2"), ("watch", "z3")])
    return out.select("task", "n", *r6("log_loss", "auc"))


_MOMENTS = " UNION ALL ".join(f"SELECT '{b}' AS blend, 'score_mean' AS metric, 0::BIGINT AS k, NULL AS category, avg(score) AS value FROM s WHERE blend = '{b}' UNION ALL SELECT '{b}', 'score_std', 0, NULL, stddev_samp(score) FROM s WHERE blend = '{b}'" for b in metrics.BLENDS)


def _experiment(t):
    rows = blended(t).withColumn("score", F.round("score", 9)).withColumn("category", F.when(F.col("category") == "Unmapped", "new release").otherwise(F.col("category")))
    named = rows.withColumns({"train_date": F.lit("2024-01-16"), "strategy": F.lit("cumulative")})
    return metrics.experiment_table(named, REQ, "score", "label", "category", "content_id").withColumn("value", F.round("value", 5))


@query("m11_experiment_table", f"""
    WITH z AS ({ZSCORED}), s AS (SELECT * REPLACE (round(score, 9) AS score, CASE WHEN category = 'Unmapped' THEN 'High' ELSE category END AS category) FROM ({_BLENDS})),
    nd AS ({_PER_BLEND}), rk AS (SELECT *, rank() OVER (PARTITION BY blend, dw_p_id, timestamp ORDER BY score DESC) + (count(*) OVER (PARTITION BY blend, dw_p_id, timestamp, score) - 1) / 2.0::DOUBLE AS rank FROM s),
    ks AS (SELECT unnest([1::BIGINT, 3, 5]) AS k),
    mix AS (SELECT blend, 'popularity_mix' AS metric, k, category, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY blend, k), 2) AS value FROM rk, ks WHERE rank <= k GROUP BY blend, k, category),
    cat AS (SELECT blend, 'catalog' AS metric, k, NULL AS category, count(DISTINCT content_id)::DOUBLE AS value FROM rk, ks WHERE rank <= k GROUP BY blend, k),
    per AS (SELECT blend, 'perplexity' AS metric, k, NULL AS category, pow(2, -sum(n / t * log2(n / t))) AS value FROM (SELECT *, sum(n) OVER (PARTITION BY blend, k) AS t FROM (SELECT blend, k, content_id, count(*)::DOUBLE AS n FROM rk, ks WHERE rank = k GROUP BY ALL)) GROUP BY blend, k),
    ndl AS (SELECT blend, 'ndcg' AS metric, unnest([1::BIGINT, 3, 5]) AS k, NULL AS category, unnest([a, b, c]) AS value FROM (SELECT blend, avg(ndcg_1) AS a, avg(ndcg_3) AS b, avg(ndcg_5) AS c FROM nd GROUP BY blend))
    SELECT '2024-01-16' AS train_date, 'cumulative' AS strategy, blend, metric, k, category, round(value, 5) AS value FROM (SELECT * FROM mix UNION ALL SELECT * FROM cat UNION ALL SELECT * FROM per UNION ALL SELECT * FROM ndl UNION ALL {_MOMENTS})""")
def _(t):
    return _experiment(t)


def _wide(metric: str, k: int, category: str | None = None) -> str:
    name = "_".join([metric] + ([str(k)] if k else []) + ([category.lower()] if category else []))
    test = f"metric = '{metric}' AND k = {k}" + (f" AND category = '{category}'" if category else "")
    return f"max(value) FILTER ({test}) AS {name}"


_WIDE = ", ".join([_wide(m, k) for m in ("catalog", "ndcg", "perplexity") for k in (1, 3, 5)] + [_wide("popularity_mix", k, c) for k in (1, 3, 5) for c in metrics.TIERS]
                  + [_wide("score_mean", 0), _wide("score_std", 0)])


@query("m11_wide_table", f"SELECT train_date, strategy, blend, {_WIDE} FROM ({ORACLES['m11_experiment_table']}) GROUP BY ALL")
def _(t):
    return metrics.wide_table(_experiment(t))


@query("m12_mean_by", "SELECT category, count(*) AS n, round(avg(base), 6) AS mean FROM tagged GROUP BY category UNION ALL SELECT CAST(label AS VARCHAR), count(*), round(avg(base), 6) FROM tagged GROUP BY label")
def _(t):
    both = metrics.mean_by(t.tagged, "category", "base").unionByName(metrics.mean_by(t.tagged, "label", "base").select(F.col("label").cast("string").alias("category"), "n", "mean"))
    return both.withColumn("mean", F.round("mean", 6))


@query("m13_task_weights", """
    SELECT event_type AS task, count(*) AS n, round(CASE event_type WHEN 'click' THEN 0.5 WHEN 'view' THEN 0.25 WHEN 'purchase' THEN 0.25 ELSE 0 END, 6)::DOUBLE AS loss_weight,
           round(512 * count(*) / (SELECT count(*) FROM log), 6) AS active_rows FROM log GROUP BY event_type""")
def _(t):
    stats = aggregates.task_stats(t.log.select(F.col("event_type").alias("task"), F.lit(0).alias("click")))
    out = metrics.task_weights(stats, {"click": 2.0, "view": 1.0, "purchase": 1.0}, 512)
    return out.select("task", "n", *r6("loss_weight", "active_rows"))


# ---- popularity tiers

_START, _END = "1997-01-01", "1997-12-31"
_AVAIL = f"SELECT show_content_id, min(fromdate) AS fromdate FROM titles WHERE {CLEAN_SQL} AND fromdate <= '{_END}' GROUP BY ALL"
_VIEWERS = f"""SELECT sub_title_id, count(DISTINCT dw_p_id) AS viewers, CAST(grouping(sub_title_id) AS INTEGER) AS is_total FROM view_log
    WHERE cd BETWEEN '{_START}' AND '{_END}' AND category <> 'sports' AND watch_minutes > 0 AND sub_title_id IN (SELECT show_content_id FROM ({_AVAIL})) GROUP BY GROUPING SETS ((sub_title_id), ())"""
_CUTS = [("High", 2.0), ("Medium", 0.8), ("Low", 0.5)]
_TIERS = f"""SELECT sub_title_id, viewers, platform_viewers, share, CASE WHEN share >= 2 THEN 'High' WHEN share >= 0.8 THEN 'Medium' WHEN share >= 0.5 THEN 'Low' ELSE 'Negligible' END AS popularity_tag
    FROM (SELECT *, viewers * 100.0::DOUBLE / platform_viewers AS share FROM (SELECT sub_title_id, viewers, (SELECT max(viewers) FROM v WHERE is_total = 1) AS platform_viewers FROM v WHERE is_total = 0))"""
_NEW = f"SELECT show_content_id, min(fromdate) AS fromdate, '{popularity.NEW_RELEASE}' AS new_tag FROM titles WHERE {CLEAN_SQL} AND fromdate BETWEEN '1997-06-01' AND '1997-12-31' GROUP BY ALL"


def _per_title(t):
    return popularity.weekly_viewers(t.view_log, popularity.first_availability(t.titles, _END), _START, _END)


@query("p1_first_availability", _AVAIL)
def _(t):
    return popularity.first_availability(t.titles, _END).withColumn("fromdate", F.col("fromdate").cast("string"))


@query("p2_weekly_viewers", _VIEWERS)
def _(t):
    return _per_title(t)


@query("p2_viewers_by_day", _VIEWERS)
def _(t):
    """The same from a set of users per title and day, each day's sets made once."""
    days = stage(popularity.day_viewers(t.view_log, popularity.number_users(t.view_log)), "day-viewers")
    return popularity.viewers_of_days(days, popularity.first_availability(t.titles, _END), _START, _END)


@query("p3_popularity_tiers", f"""WITH v AS ({_VIEWERS}) SELECT sub_title_id, viewers, platform_viewers, round(share, 6) AS share, popularity_tag, '{_START}' AS week_start, '{_END}' AS week_end,
    '1997-01-08' AS target_week_start, '1998-01-07' AS target_week_end FROM ({_TIERS})""")
def _(t):
    out = popularity.popularity_tiers(_per_title(t), _START, _END, _CUTS)
    dates = {c: F.col(c).cast("string") for c in ("week_start", "week_end", "target_week_start", "target_week_end")}
    return out.withColumns({"share": F.round("share", 6), **dates})


@query("p4_new_releases", _NEW)
def _(t):
    return popularity.new_releases(t.titles, "1997-06-01", "1997-12-31").withColumn("fromdate", F.col("fromdate").cast("string"))


@query("p5_merge_tags", f"""WITH v AS ({_VIEWERS}), t AS ({_TIERS}), n AS ({_NEW})
    SELECT coalesce(sub_title_id, show_content_id) AS sub_title_id, CASE WHEN popularity_tag IN ('High', 'Medium', 'Low') THEN popularity_tag ELSE coalesce(new_tag, popularity_tag) END AS tag FROM t FULL JOIN n ON sub_title_id = show_content_id""")
def _(t):
    return popularity.merge_tags(popularity.popularity_tiers(_per_title(t), _START, _END, _CUTS), popularity.new_releases(t.titles, "1997-06-01", "1997-12-31"))
