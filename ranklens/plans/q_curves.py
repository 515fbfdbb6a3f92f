"""Queries for watch-time curves."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ranklens.operators import aggregates, curves
from ranklens.plans.domain import CURVE_DAYS
from ranklens.plans.q_metrics import freq_sql
from ranklens.plans.registry import query
from ranklens.sources.logs import stage

R = 30
NOW_C = CURVE_DAYS * 86400
PAIR = ["dw_p_id", "content_id"]


def r4(*cols):
    return [F.round(c, 4).alias(c) for c in cols]


_MATRIX = f"""
    firsts AS (SELECT dw_p_id, content_id, min(first_watch_ts) AS first_ts FROM curve_watches GROUP BY ALL),
    pairs AS (SELECT f.*, least(greatest(({NOW_C} - first_ts) // 86400, 0), {R + 1}) AS complete FROM firsts f JOIN curve_history h USING (dw_p_id, content_id) WHERE f.first_ts <= h.first_watch),
    dayed AS (SELECT w.dw_p_id, w.content_id, p.complete, (w.last_watch_ts - p.first_ts) // 86400 AS day, w.watch_time FROM curve_watches w JOIN pairs p USING (dw_p_id, content_id)),
    sums AS (SELECT dw_p_id, content_id, complete, day, CAST(sum(watch_time) AS BIGINT) AS wt FROM dayed WHERE day >= 0 AND day < complete GROUP BY ALL),
    kept AS (SELECT * FROM sums WHERE (dw_p_id, content_id) IN (SELECT (dw_p_id, content_id) FROM sums WHERE day = 0 AND wt >= 600))"""


def matrix(t):
    return curves.discovery_matrix(t.curve_watches, t.curve_history, NOW_C, R)


@query("c1_discovery_matrix", f"WITH {_MATRIX} SELECT dw_p_id, content_id, complete, day, wt FROM kept")
def _(t):
    return matrix(t).select(*PAIR, "complete", "day", "wt")


_CURVE = f"""{_MATRIX},
    axis AS (SELECT unnest(range(0, {R + 1})) AS day),
    curve AS (SELECT t.content_id, a.day, coalesce((SELECT CAST(sum(wt) AS BIGINT) FROM kept k WHERE k.content_id = t.content_id AND k.day = a.day), 0) AS watch,
                     (SELECT count(*) FROM kept k WHERE k.content_id = t.content_id AND k.day = 0 AND k.complete > a.day) AS users FROM (SELECT DISTINCT content_id FROM kept) t, axis a)"""


def curve(t):
    """Title curves (titles x days), written once for the steps that follow."""
    return stage(curves.title_curve(matrix(t), R), "curves")


@query("c2_title_curve", f"WITH {_CURVE} SELECT * FROM curve")
def _(t):
    return curve(t)


_KIND = f"""{_CURVE},
    kinds AS (SELECT content_id, CASE content_type_id WHEN 100 THEN 'show' WHEN 200 THEN 'movie' END AS kind FROM catalog),
    kcurve AS (SELECT kind, day, CAST(sum(watch) AS BIGINT) AS watch, CAST(sum(users) AS BIGINT) AS users, sum(watch) / greatest(sum(users), 1) AS per_user FROM curve JOIN kinds USING (content_id) WHERE kind IS NOT NULL GROUP BY kind, day)"""


@query("c3_kind_curve", f"WITH {_KIND} SELECT kind, day, watch, users, round(per_user, 4) AS per_user, round(sum(per_user) FILTER (day < 14) OVER (PARTITION BY kind), 4) AS complete FROM kcurve")
def _(t):
    return curves.kind_curve(curve(t), t.catalog).select("kind", "day", "watch", "users", *r4("per_user", "complete"))


def smooth_sql(curve: str, keys: str, default_keys: str, min_users: int) -> str:
    """Recursive form of the smoothing fold over ``curve`` (keys, day, watch, users, base: the default's value)."""
    return f"""
        fold AS (
            SELECT {keys}, day, v AS per_user, v AS total, base AS btotal FROM (
                SELECT *, CASE WHEN users >= {min_users} THEN watch / greatest(users, 1) ELSE users / {min_users}.0::DOUBLE * (watch / greatest(users, 1)) + (1 - users / {min_users}.0::DOUBLE) * base END AS v FROM {curve} WHERE day = 0)
            UNION ALL
            SELECT {', '.join('c.' + k.strip() for k in keys.split(','))}, c.day,
                   CASE WHEN c.users >= {min_users} THEN c.watch / greatest(c.users, 1) WHEN f.btotal <> 0 THEN f.total * (c.base / f.btotal) ELSE 0 END,
                   f.total + CASE WHEN c.users >= {min_users} THEN c.watch / greatest(c.users, 1) WHEN f.btotal <> 0 THEN f.total * (c.base / f.btotal) ELSE 0 END, f.btotal + c.base
            FROM fold f JOIN {curve} c ON {' AND '.join(f'c.{k.strip()} = f.{k.strip()}' for k in keys.split(','))} AND c.day = f.day + 1)"""


@query("c4_smooth_curve", f"""WITH RECURSIVE {_KIND},
    based AS MATERIALIZED (SELECT c.content_id, c.day, c.watch::DOUBLE AS watch, c.users, coalesce(k.per_user, 0) AS base FROM curve c JOIN catalog x USING (content_id) LEFT JOIN kcurve k ON k.day = c.day AND k.kind = CASE WHEN x.content_type_id = 100 THEN 'show' ELSE 'movie' END),
    {smooth_sql('based', 'content_id', '', 30)}
    SELECT content_id, day, round(per_user, 4) AS per_user, round(total, 4) AS cumulative FROM fold""")
def _(t):
    titles = curve(t)
    return curves.smooth_curve(titles, curves.kind_curve(titles, t.catalog), t.catalog).select("content_id", "day", *r4("per_user", "cumulative"))


@query("c4_complete_watch", f"""WITH RECURSIVE {_KIND},
    based AS MATERIALIZED (SELECT c.content_id, c.day, c.watch::DOUBLE AS watch, c.users, coalesce(k.per_user, 0) AS base FROM curve c JOIN catalog x USING (content_id) LEFT JOIN kcurve k ON k.day = c.day AND k.kind = CASE WHEN x.content_type_id = 100 THEN 'show' ELSE 'movie' END),
    {smooth_sql('based', 'content_id', '', 200)}
    SELECT content_id, round(sum(per_user) FILTER (day < 14), 4) AS complete_watch FROM fold GROUP BY content_id""")
def _(t):
    titles = curve(t)
    return curves.complete_watch(curves.smooth_curve(titles, curves.kind_curve(titles, t.catalog), t.catalog, 200)).select("content_id", *r4("complete_watch"))


# ---- curves by prior watch. Event day = day of a watch of 600 s or more, prior = earlier seconds.

_START, _DAYS, _SPAN = 40, 20, 7
_EVENTS = f"""
    days AS (SELECT dw_p_id, content_id, watch_dt, CAST(sum(watch_time) AS BIGINT) AS wt FROM curve_watches GROUP BY ALL),
    prior AS (SELECT *, coalesce(CAST(sum(wt) OVER (PARTITION BY dw_p_id, content_id ORDER BY watch_dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS watched FROM days),
    events_c AS (SELECT dw_p_id, content_id, watch_dt - {_START} AS event_dt, watched, wt AS wt_0 FROM prior WHERE wt >= 600 AND watch_dt BETWEEN {_START} AND {_START + _DAYS - 1}),
    wdays AS (SELECT dw_p_id, content_id, watch_dt - {_START} AS watch_dt, wt FROM days WHERE watch_dt BETWEEN {_START} AND {_START + _DAYS - 1})"""
_CHIST = "SELECT content_id, CAST(ceil(watched / 60) AS BIGINT) AS minute, count(*) AS n FROM events_c WHERE watched > 0 GROUP BY ALL"
_MAXB, _MINB = 8, 10


def _events(t):
    days = t.curve_watches.groupBy(*PAIR, "watch_dt").agg(F.sum("watch_time").alias("wt"))
    before = Window.partitionBy(*PAIR).orderBy("watch_dt").rowsBetween(Window.unboundedPreceding, -1)
    prior = days.withColumn("watched", F.coalesce(F.sum("wt").over(before), F.lit(0)))
    span = F.col("watch_dt").between(_START, _START + _DAYS - 1)
    events = prior.filter(span & (F.col("wt") >= 600)).select(*PAIR, (F.col("watch_dt") - _START).alias("event_dt"), "watched", F.col("wt").alias("wt_0"))
    return stage(events, "events"), t.curve_watches.filter(span).withColumn("watch_dt", F.col("watch_dt") - _START)


def _edges(events):
    return aggregates.freq_bins(aggregates.minute_hist(events, "content_id", "watched"), "content_id", _MAXB, _MINB)


def grouped(t):
    events, watches = _events(t)
    edges = _edges(events)
    return curves.grouped_curves(events, watches, edges, _DAYS, _SPAN), edges


_FREQ = freq_sql(_CHIST, _MAXB, _MINB).strip()[len("WITH RECURSIVE "):]
_GROUPED = f"""{_EVENTS}, {_FREQ},
    ev AS (SELECT e.*, CASE WHEN edges IS NULL THEN 0 ELSE least(len(list_filter(edges, lambda x: x < watched)), len(edges) - 1) END::INTEGER AS grp FROM events_c e LEFT JOIN edges USING (content_id)),
    axis AS (SELECT unnest(range(0, {_SPAN})) AS day),
    later AS (SELECT ev.content_id, grp, w.watch_dt - event_dt AS day, CAST(sum(w.wt) AS BIGINT) AS s FROM ev JOIN wdays w ON w.dw_p_id = ev.dw_p_id AND w.content_id = ev.content_id AND w.watch_dt - event_dt BETWEEN 1 AND {_SPAN - 1} GROUP BY ALL),
    grouped AS (SELECT e.content_id, e.grp, a.day, (CASE WHEN a.day = 0 THEN sum(wt_0) ELSE 0 END + coalesce(max(l.s), 0))::BIGINT AS watch,
                       count(*) FILTER (a.day < least({_DAYS} - event_dt, {_SPAN})) AS users, count(*) AS num
                FROM ev e CROSS JOIN axis a LEFT JOIN later l ON l.content_id = e.content_id AND l.grp = e.grp AND l.day = a.day GROUP BY e.content_id, e.grp, a.day)"""


@query("c5_cumulative_events", f"""
    SELECT s.dw_p_id, s.content_id, coalesce(p.past, 0) + before AS watched, wt_0, is_sample FROM (
        SELECT dw_p_id, content_id, before, daily_watch_time - before AS wt_0, i > 0 AS is_sample FROM (
            SELECT *, CASE WHEN i = 0 THEN 0 ELSE floor((('0x' || substr(md5(dw_p_id || '|' || content_id || '|' || i || '|split'), 1, 8))::BIGINT / 4294967296.0::DOUBLE) * (daily_watch_time - 600 + 1)) END::BIGINT AS before
            FROM (SELECT *, unnest(range(0, 3)) AS i FROM (SELECT dw_p_id, content_id, CAST(sum(watch_time) AS BIGINT) AS daily_watch_time FROM daily GROUP BY ALL) WHERE daily_watch_time >= 600))) s
    LEFT JOIN (SELECT dw_p_id, content_id, CAST(sum(watch_len) AS BIGINT) AS past FROM history GROUP BY ALL) p USING (dw_p_id, content_id)""")
def _(t):
    return curves.cumulative_events(t.daily, t.history, 2)


@query("c6_grouped_curves", f"WITH RECURSIVE {_GROUPED} SELECT content_id, grp AS group_id, day, watch, users, num FROM grouped")
def _(t):
    return grouped(t)[0].withColumnRenamed("group", "group_id")


_BINNED = f"""{_GROUPED},
    binned AS (SELECT g.*, CASE WHEN edges IS NOT NULL THEN edges[grp + 1] WHEN grp = 0 THEN 0 END AS bin, x.kind FROM grouped g LEFT JOIN edges USING (content_id) JOIN catalog x USING (content_id)),
    mass AS (SELECT kind, bin AS value, CAST(sum(num) AS BIGINT) AS n FROM binned WHERE day = 0 GROUP BY ALL),
    ksrc AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY value) AS rn, CAST(sum(n) OVER (PARTITION BY kind) AS BIGINT) // 6 AS per_bin FROM mass WHERE value > 60),
    kfold AS (SELECT kind, CAST(0 AS BIGINT) AS rn, [CAST(0 AS BIGINT), 60] AS kedges, CAST(0 AS BIGINT) AS filled FROM (SELECT DISTINCT kind FROM mass)
              UNION ALL SELECT f.kind, s.rn, CASE WHEN f.filled + s.n >= s.per_bin THEN list_append(f.kedges, s.value) ELSE f.kedges END, CASE WHEN f.filled + s.n >= s.per_bin THEN 0 ELSE f.filled + s.n END
              FROM kfold f JOIN ksrc s ON s.kind = f.kind AND s.rn = f.rn + 1),
    kedge AS (SELECT kind, arg_max(kedges, rn)[1:8] AS kedges FROM kfold GROUP BY kind),
    placed AS (SELECT b.*, least(len(list_filter(kedges, lambda x: x < bin)), len(kedges) - 1) AS cluster FROM binned b JOIN kedge USING (kind)),
    cl AS (SELECT kind, cluster, day, sum(watch) / greatest(sum(users), 1) AS per_user FROM placed GROUP BY kind, cluster, day),
    based AS MATERIALIZED (SELECT p.content_id, p.grp, p.day, p.watch::DOUBLE AS watch, p.users, cl.per_user AS base FROM placed p JOIN cl ON cl.kind = p.kind AND cl.cluster = p.cluster AND cl.day = p.day),
    {smooth_sql('based', 'content_id, grp', '', 30)}"""


@query("c7_cluster_curves", f"WITH RECURSIVE {_BINNED} SELECT content_id, grp AS group_id, day, round(per_user, 4) AS per_user, round(total, 4) AS cumulative FROM fold")
def _(t):
    curve, edges = grouped(t)
    out = curves.cluster_curves(stage(curves.binned_curves(curve, edges, t.catalog), "binned"), max_bins=8)
    return out.select("content_id", F.col("group").alias("group_id"), "day", *r4("per_user", "cumulative"))


@query("c8_check_bins", f"""WITH RECURSIVE {_GROUPED} SELECT DISTINCT content_id, grp AS group_id FROM grouped WHERE grp <> 0 AND content_id IN (SELECT p_partkey FROM part WHERE p_size >= 25)""")
def _(t):
    curve, edges = grouped(t)
    some = edges.join(t.raw("part").filter("p_size >= 25").select(F.col("p_partkey").alias("content_id")), "content_id", "left_anti")
    return curves.check_bins(curve, some).withColumnRenamed("group", "group_id")
