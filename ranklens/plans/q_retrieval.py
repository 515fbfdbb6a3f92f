"""Queries for candidate retrieval and re-ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ranklens.operators import filters, retrieval
from ranklens.plans.domain import CUT, NOW
from ranklens.plans.q_examples import draw_sql
from ranklens.plans.registry import query, rows_n
from ranklens.sources.logs import stage

DATE = "2024-01-31"
_W = f"pow(0.5, ({NOW} - last_watch) / 1209600.0::DOUBLE)"


def r6(df, c="score"):
    return df.withColumn(c, F.round(c, 6))


_SCORES = f"""
    joined AS (SELECT w.dw_p_id, w.watch_len >= 600 AS long, r.dst, r.dst_lang, r.score * {_W} AS s FROM kwatch w JOIN rel r ON r.src = w.content_id AND r.src_lang = w.language),
    sums AS (SELECT dw_p_id, dst, dst_lang, sum(s) FILTER (long) AS ls, sum(s) AS als FROM joined GROUP BY ALL),
    picked AS (SELECT *, CASE WHEN count(ls) OVER (PARTITION BY dw_p_id) > 0 THEN 'long' ELSE 'any' END AS pass FROM sums),
    used AS (SELECT dw_p_id, content_id AS dst, bool_or(watch_len >= 600) AS ul FROM kwatch GROUP BY ALL),
    scores AS (SELECT p.dw_p_id, p.dst, p.dst_lang, round(CASE WHEN pass = 'long' THEN ls ELSE als END, 6) AS score FROM picked p LEFT JOIN used u USING (dw_p_id, dst)
               WHERE CASE WHEN pass = 'long' THEN ls ELSE als END IS NOT NULL AND NOT coalesce(CASE WHEN pass = 'long' THEN u.ul ELSE u.ul IS NOT NULL END, false))"""


def scores(t, rel=None):
    return r6(retrieval.item_scores(t.kwatch, t.rel if rel is None else rel, NOW))


@query("k1_item_scores", f"WITH {_SCORES} SELECT * FROM scores")
def _(t):
    return scores(t)


def quota_sql(source: str, by: str, order: str, n: int, least: int) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rn, row_number() OVER (PARTITION BY {by}, is_show ORDER BY {order}) AS rk,
        row_number() OVER (PARTITION BY {by}, is_brand ORDER BY {order}) AS rf FROM {source}) WHERE rn <= {n} OR rk <= {least} OR (is_brand AND rf <= {least})"""


_FLAGGED = f"{_SCORES}, flagged AS (SELECT s.*, coalesce(kind = 'show', false) AS is_show, coalesce(is_brand, false) AS is_brand FROM scores s LEFT JOIN catalog c ON c.content_id = s.dst)"
_ORDER = "score DESC, dst, dst_lang"


def flagged(t, rel=None):
    info = t.catalog.select(F.col("content_id").alias("dst"), (F.col("kind") == "show").alias("is_show"), "is_brand")
    return scores(t, rel).join(info, "dst", "left").fillna({"is_show": False, "is_brand": False})


@query("w8_quota_topk", f"WITH {_FLAGGED} SELECT dw_p_id, dst, dst_lang, score FROM ({quota_sql('flagged', 'dw_p_id', _ORDER, 20, 12)})")
def _(t):
    kept = retrieval.quota_topk(flagged(t), ["dw_p_id"], [F.col("score").desc(), F.col("dst"), F.col("dst_lang")], 20, 12, "is_show", "is_brand")
    return kept.select("dw_p_id", "dst", "dst_lang", "score")


# the first pass takes watches of 600 s and more; only if it finds no target, a second one takes all
_USED = """usedw AS (SELECT * FROM kwatch k WHERE watch_len >= 600 OR NOT EXISTS (
    SELECT 1 FROM kwatch w JOIN rel r ON r.src = w.content_id AND r.src_lang = w.language WHERE w.dw_p_id = k.dw_p_id AND w.watch_len >= 600))"""


@query("k2_used_watches", f"WITH {_USED} SELECT dw_p_id, content_id, language, watch_len, last_watch FROM usedw")
def _(t):
    return retrieval.used_watches(t.kwatch, t.rel).select("dw_p_id", "content_id", "language", "watch_len", "last_watch")


@query("k2_short_only", "SELECT dw_p_id, content_id, language, watch_len, last_watch FROM kwatch WHERE watch_len < 600")
def _(t):
    """Users whose watches are all short are scored from all of them."""
    return retrieval.used_watches(t.kwatch.filter("watch_len < 600"), t.rel).select("dw_p_id", "content_id", "language", "watch_len", "last_watch")


@query("k2_evidence", f"WITH {_USED} SELECT w.dw_p_id, w.content_id AS src, w.language AS src_lang, r.dst, r.dst_lang, round(r.score, 6) AS relevance, round(max({_W}), 6) AS weight FROM usedw w JOIN rel r ON r.src = w.content_id AND r.src_lang = w.language GROUP BY ALL")
def _(t):
    used = retrieval.used_watches(t.kwatch, t.rel)
    ev = retrieval.evidence(used, t.rel).join(retrieval.watch_weights(used, NOW), ["dw_p_id", "src", "src_lang"])
    return ev.withColumns({"relevance": F.round("relevance", 6), "weight": F.round("weight", 6)})


_TOP = f"{_FLAGGED}, top AS (SELECT dw_p_id, dst, dst_lang, score FROM ({quota_sql('flagged', 'dw_p_id', _ORDER, 200, 50)}))"


def top(t, rel=None):
    """Retrieved candidates, written once for the list steps that follow."""
    kept = retrieval.quota_topk(flagged(t, rel), ["dw_p_id"], [F.col("score").desc(), F.col("dst"), F.col("dst_lang")], 200, 50, "is_show", "is_brand")
    return stage(kept.select("dw_p_id", "dst", "dst_lang", "score"), "candidates")


_GATE = f"""{_TOP},
    langs AS (SELECT dw_p_id, language FROM kwatch GROUP BY ALL HAVING sum(watch_len) >= 1500),
    marked AS (SELECT t.*, EXISTS (SELECT 1 FROM langs l WHERE l.dw_p_id = t.dw_p_id AND l.language = t.dst_lang) OR NOT EXISTS (SELECT 1 FROM langs l WHERE l.dw_p_id = t.dw_p_id) AS pass, min(score) OVER (PARTITION BY dw_p_id) AS low FROM top t),
    gated AS (SELECT dw_p_id, dst, dst_lang, CASE WHEN pass THEN score ELSE round(low - 1 + 1.0::DOUBLE / row_number() OVER (PARTITION BY dw_p_id, pass ORDER BY {_ORDER}), 6) END AS score FROM marked)"""


def gated(t):
    return r6(retrieval.language_gate(top(t), t.kwatch, 1500))


@query("k3_language_gate", f"WITH {_GATE} SELECT * FROM gated")
def _(t):
    return gated(t)


_FILTERED = f"""{_GATE},
    filtered AS (SELECT dw_p_id, dst, max(score) AS score FROM gated g WHERE NOT EXISTS (SELECT 1 FROM kwatch w WHERE w.dw_p_id = g.dw_p_id AND w.content_id = g.dst)
                 AND dst IN (SELECT content_id FROM catalog WHERE kind = 'show' OR content_type_id = 200) GROUP BY dw_p_id, dst)"""


def filtered(t):
    return retrieval.filter_results(gated(t), t.kwatch, t.catalog)


@query("k4_filter_results", f"WITH {_FILTERED} SELECT * FROM filtered")
def _(t):
    return filtered(t)


@query("k5_finalize", f"WITH {_FILTERED} SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY dw_p_id ORDER BY score DESC, dst) AS INTEGER) AS position FROM filtered) WHERE position <= 40")
def _(t):
    return retrieval.finalize(filtered(t), t.catalog)


@query("k5_finalize_paid", f"""WITH {_FILTERED}, p AS (SELECT f.*, is_premium, row_number() OVER (PARTITION BY dw_p_id, is_premium ORDER BY score DESC, dst) AS rp FROM filtered f JOIN catalog c ON c.content_id = dst),
    q AS (SELECT *, row_number() OVER (PARTITION BY dw_p_id ORDER BY CASE WHEN is_premium AND rp <= 12 THEN 0 ELSE 1 END, score DESC, dst) AS rq FROM p)
    SELECT dw_p_id, dst, score, CAST(row_number() OVER (PARTITION BY dw_p_id ORDER BY score DESC, dst) AS INTEGER) AS position FROM q WHERE rq <= 20""")
def _(t):
    return retrieval.finalize(filtered(t), t.catalog, 20, 0.6)


@query("k5_predict", f"WITH {_FILTERED.replace('>= 1500', '>= 600')} SELECT dw_p_id, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY dw_p_id ORDER BY score DESC, dst) AS position FROM filtered) WHERE position <= 40 GROUP BY dw_p_id")
def _(t):
    return retrieval.predict(t.kwatch, t.rel, t.catalog, NOW).groupBy("dw_p_id").agg(rows_n())


_POP = "lp AS (SELECT language, content_id, sum(popularity) AS popularity FROM (SELECT language, k AS content_id, count(*)::DOUBLE AS popularity FROM log GROUP BY ALL) GROUP BY ALL)"
_PLIST = f"""{_POP}, pf AS (SELECT lp.*, kind = 'show' AS is_show, is_brand FROM lp JOIN catalog USING (content_id)),
    plist AS (SELECT language, content_id, CAST(row_number() OVER (PARTITION BY language ORDER BY popularity DESC, content_id) - 1 AS INTEGER) AS position FROM ({quota_sql('pf', 'language', 'popularity DESC, content_id', 12, 8)}))"""


def plist(t):
    pop = t.log.groupBy("language", F.col("k").alias("content_id")).agg(F.count(F.lit(1)).cast("double").alias("popularity"))
    return retrieval.popular_by_language(pop, t.catalog, 12, 8)


@query("k6_popular_by_language", f"WITH {_PLIST} SELECT * FROM plist")
def _(t):
    return plist(t)


_LANGS = """own AS (SELECT dw_p_id, language, CAST(sum(watch_len) AS DOUBLE) AS weight FROM kwatch WHERE watch_len > 0 GROUP BY ALL),
    lg AS (SELECT * FROM (SELECT * FROM own UNION ALL SELECT dw_p_id, unnest([0, 1]), unnest([2.0::DOUBLE, 1.0]) FROM users WHERE dw_p_id NOT IN (SELECT dw_p_id FROM own))
           QUALIFY row_number() OVER (PARTITION BY dw_p_id ORDER BY weight DESC, language) <= 2)"""


def langs(t):
    return retrieval.top_languages(t.kwatch, t.users, {0: 2.0, 1: 1.0})


@query("k6_popular_for_user", f"WITH {_PLIST}, {_LANGS} SELECT dw_p_id, language, content_id, round((position + 0.5) / weight, 9) AS rank_score FROM lg JOIN plist USING (language)")
def _(t):
    return retrieval.popular_for_user(langs(t), plist(t)).withColumn("rank_score", F.round("rank_score", 9))


_BURST = f"""burst AS (SELECT e.content_id, e.language, e.popularity FROM day_pop e LEFT JOIN day_pop s ON s.content_id = e.content_id AND s.language = e.language AND s.day = e.day - 7
    WHERE e.day = {NOW} // 86400 - 3 AND e.popularity > 0.7 AND e.popularity - coalesce(s.popularity, 0) > 0.2)"""
_STRONG = """strong AS (SELECT dw_p_id, language, CAST(sum(watch_len) AS BIGINT) AS seconds FROM kwatch GROUP BY ALL HAVING sum(watch_len) > 3600)"""
_PICK = "SELECT dw_p_id, content_id, arg_max(language, (seconds, -language)) AS language FROM {0} JOIN strong USING (language) GROUP BY dw_p_id, content_id UNION ALL SELECT u.dw_p_id, d.content_id, d.language FROM (SELECT * FROM users WHERE dw_p_id NOT IN (SELECT dw_p_id FROM strong)) u, {1} d"


def bursts(t):
    return retrieval.bursts(t.day_pop, NOW - 2 * 86400)


@query("w7_bursts", f"WITH {_BURST} SELECT content_id, language, round(popularity, 6) AS popularity FROM burst")
def _(t):
    return r6(bursts(t), "popularity")


@query("k7_burst_for_user", f"WITH {_BURST}, {_STRONG}, best AS (SELECT content_id, arg_max(language, (popularity, -language)) AS language FROM burst GROUP BY content_id) {_PICK.format('burst', 'best')}")
def _(t):
    return retrieval.burst_for_user(t.users, t.kwatch, bursts(t))


_NEWT = f"nt AS (SELECT * FROM catalog WHERE ((kind = 'movie' AND content_type_id = 200) OR (kind = 'show' AND content_type_id = 100)) AND start_dt > {CUT} - 7 * 86400 AND start_dt < {CUT} + 86400)"


@query("k8_new_for_user", f"WITH {_NEWT}, {_STRONG}, nl AS (SELECT content_id, unnest(language_ids) AS language FROM nt), nd AS (SELECT content_id, primary_language AS language FROM nt) {_PICK.format('nl', 'nd')}")
def _(t):
    return retrieval.new_for_user(t.users, t.kwatch, filters.new_published(t.catalog, CUT))


_GENRES = "[" + ", ".join(map(str, filters.SPORTS_GENRES)) + "]"
_SPORTS = f"""sp AS (SELECT content_id, kind, unnest(language_ids) AS language FROM catalog WHERE list_has_any(genre_ids, {_GENRES}) AND ((kind = 'movie' AND content_type_id = 200 AND start_dt BETWEEN {CUT} - 90 * 86400 AND {CUT})
    OR (kind = 'show' AND last_broadcast >= {CUT} - 90 * 86400 AND first_broadcast <= {CUT}))),
    sl AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY CASE WHEN kind = 'movie' THEN 0 ELSE 1 END, content_id) AS pos FROM sp)"""


@query("k9_sports_for_user", f"""WITH {_SPORTS}, {_LANGS} SELECT dw_p_id, language, content_id, round((pos - 0.5) / weight, 9) AS rank_score FROM lg JOIN sl USING (language)
    QUALIFY row_number() OVER (PARTITION BY dw_p_id ORDER BY (pos - 0.5) / weight, language, content_id) <= 20""")
def _(t):
    out = retrieval.sports_for_user(langs(t), filters.sports_content(t.catalog, CUT))
    return out.withColumn("rank_score", F.round("rank_score", 9))


_TYPES = "MAP {" + ", ".join(f"{k}: {v}::DOUBLE" for k, v in retrieval.NS_TYPE_WEIGHTS.items()) + "}"


_TOKEN = f"""
    WITH last AS (SELECT * FROM ns_watches QUALIFY row_number() OVER (PARTITION BY dw_p_id ORDER BY last_watch DESC, content_id, language, watch_len) <= 20),
    w AS (SELECT l.*, coalesce({_TYPES}[content_type_id], 0) * {_W} * CASE WHEN watch_len <= 600 THEN 0.1 ELSE 1 END
          * CASE WHEN CASE WHEN content_type_id = 301 THEN watch_len < 600 ELSE watch_len < 30 AND (duration <= 0 OR watch_len / duration < 0.5) END THEN 0.1 ELSE 1 END AS w FROM last l JOIN videos v USING (content_id))
    SELECT w.dw_p_id, r.dst, r.dst_lang, round(sum(r.score * w.w * t.weight), 6) AS score FROM w JOIN tokens t ON t.content_id = w.content_id AND t.language = w.language JOIN token_rel r ON r.name = t.name
    WHERE NOT EXISTS (SELECT 1 FROM kwatch k WHERE k.dw_p_id = w.dw_p_id AND k.content_id = r.dst) GROUP BY ALL"""


@query("k10_token_scores", _TOKEN)
def _(t):
    return retrieval.token_scores(t.ns_watches, t.videos, t.tokens, t.token_rel, t.kwatch, NOW, digits=6)


@query("k10_token_retrieve", f"""WITH ts AS ({_TOKEN}), tf AS (SELECT ts.*, coalesce(kind = 'show', false) AS is_show, false AS is_brand FROM ts LEFT JOIN catalog ON content_id = dst)
    SELECT dw_p_id, dst, dst_lang, score FROM ({quota_sql('tf', 'dw_p_id', _ORDER, 10, 8)})""")
def _(t):
    quota = retrieval.TokenQuota(t.catalog, 10, 8, digits=6)
    scores = r6(retrieval.token_scores(t.ns_watches, t.videos, t.tokens, t.token_rel, t.kwatch, NOW, quota=quota))
    return retrieval.token_retrieve(scores, t.catalog, 10, 8)


@query("k11_tagged_union", "SELECT dw_p_id, content_id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM (SELECT dw_p_id, k AS content_id, event_type AS source FROM log WHERE event_type IN ('view', 'click', 'error')) WHERE content_id IN (SELECT content_id FROM catalog) GROUP BY ALL")
def _(t):
    part = lambda e: t.between(e).select("dw_p_id", F.col("k").alias("content_id"))
    return retrieval.tagged_union({e: part(e) for e in ("view", "click", "error")}, t.catalog).withColumn("sources", F.concat_ws(",", "sources"))


@query("k10_token_retrieve_default", f"""WITH ts AS ({_TOKEN}), tf AS (SELECT ts.*, coalesce(kind = 'show', false) AS is_show, false AS is_brand FROM ts LEFT JOIN catalog ON content_id = dst)
    SELECT dw_p_id, dst, dst_lang, score FROM ({quota_sql('tf', 'dw_p_id', _ORDER, 200, 100)})""")
def _(t):
    quota = retrieval.TokenQuota(t.catalog, digits=6)
    return retrieval.token_retrieve(r6(retrieval.token_scores(t.ns_watches, t.videos, t.tokens, t.token_rel, t.kwatch, NOW, quota=quota)), t.catalog)


_DIV = f"""{_TOP}, {_USED},
    ww AS (SELECT dw_p_id, content_id AS src, language AS src_lang, pow(0.5, ({NOW} - max(last_watch)) / 1209600.0::DOUBLE) AS weight FROM usedw GROUP BY ALL),
    srcs AS (SELECT *, row_number() OVER (PARTITION BY dw_p_id ORDER BY weight DESC, src, src_lang) AS pos FROM ww QUALIFY pos <= 20),
    ev AS (SELECT s.dw_p_id, r.dst, r.dst_lang, s.pos, s.weight, r.score AS relevance FROM srcs s JOIN rel r ON r.src = s.src AND r.src_lang = s.src_lang),
    best AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY dw_p_id, dst, dst_lang ORDER BY relevance DESC, pos) = 1),
    rows AS (SELECT t.*, b.weight, coalesce(b.relevance > 0, false) AS hit, CASE WHEN b.relevance > 0 THEN b.pos ELSE 1 END AS src FROM top t LEFT JOIN best b USING (dw_p_id, dst, dst_lang) WHERE t.dw_p_id IN (SELECT dw_p_id FROM srcs))"""


@query("k12_diversify", f"WITH {_DIV} SELECT dw_p_id, dst, dst_lang, round(CASE WHEN hit THEN score * weight / row_number() OVER (PARTITION BY dw_p_id, src ORDER BY {_ORDER}) ELSE 0 END, 6) AS score FROM rows")
def _(t):
    rel = stage(t.rel, "relevances")  # read for scoring, for the pass and for the evidence
    weights = stage(retrieval.watch_weights(retrieval.used_watches(t.kwatch, rel), NOW), "weights")  # read for the sources and the ranks
    evidence = retrieval.source_evidence(retrieval.top_sources(weights), rel)
    return r6(retrieval.diversify(top(t, rel), evidence, weights))


_D = draw_sql(["dw_p_id", f"'{DATE}'", "dst"], "home")


@query("k13_impression_discount", f"""WITH {_TOP}, imp AS (SELECT dw_p_id, k AS dst, count(*) AS impressions FROM log GROUP BY ALL),
    m AS (SELECT t.*, impressions, min(score) OVER (PARTITION BY t.dw_p_id) AS low, least((impressions - 1) / 3.0::DOUBLE, 1) AS pull FROM top t LEFT JOIN imp USING (dw_p_id, dst))
    SELECT dw_p_id, dst, dst_lang, round(CASE WHEN impressions > 1 THEN (score - low) * (pull * {_D} + (1 - pull)) + low ELSE score END, 6) AS score FROM m""")
def _(t):
    counts = t.log.groupBy("dw_p_id", F.col("k").alias("dst")).agg(rows_n("impressions"))
    return r6(retrieval.impression_discount(top(t), counts, DATE, start=1, most=4))


@query("k13_impression_discount_default", f"""WITH {_TOP}, imp AS (SELECT dw_p_id, k AS dst, count(*) * 3 AS impressions FROM log GROUP BY ALL),
    m AS (SELECT t.*, impressions, min(score) OVER (PARTITION BY t.dw_p_id) AS low, least((impressions - 2) / 8.0::DOUBLE, 1) AS pull FROM top t LEFT JOIN imp USING (dw_p_id, dst))
    SELECT dw_p_id, dst, dst_lang, round(CASE WHEN impressions > 2 THEN (score - low) * (pull * {_D} + (1 - pull)) + low ELSE score END, 6) AS score FROM m""")
def _(t):
    counts = t.log.groupBy("dw_p_id", F.col("k").alias("dst")).agg((F.count(F.lit(1)) * 3).alias("impressions"))
    return r6(retrieval.impression_discount(top(t), counts, DATE))


@query("k14_jitter", f"WITH {_TOP} SELECT dw_p_id, dst, dst_lang, round(CASE WHEN score > 0 THEN score * ({_D} * 0.5 + 0.5) ELSE score END, 6) AS score FROM top")
def _(t):
    return r6(retrieval.jitter(top(t), DATE))


@query("k15_blend_lists", f"""WITH {_FILTERED}, second AS (SELECT dw_p_id, k + 50 AS dst, CAST(max(value) AS DOUBLE) AS score FROM log GROUP BY ALL)
    SELECT dw_p_id, dst, round(sum(score), 6) AS score FROM (SELECT dw_p_id, dst, score FROM filtered UNION ALL
        SELECT dw_p_id, dst, score * 0.3 * pow(0.8, row_number() OVER (PARTITION BY dw_p_id ORDER BY score DESC, dst) - 1) FROM second) GROUP BY ALL""")
def _(t):
    second = t.log.groupBy("dw_p_id", (F.col("k") + 50).alias("dst")).agg(F.max("value").alias("score"))
    return r6(retrieval.blend_lists(filtered(t), second, 0.3))


@query("k15_premium_decay", f"""WITH {_FILTERED}, payer AS (SELECT DISTINCT dw_p_id FROM kwatch JOIN catalog USING (content_id) WHERE is_premium AND watch_len > 3000),
    p AS (SELECT f.*, c.is_premium AND dw_p_id NOT IN (SELECT dw_p_id FROM payer) AS decays, row_number() OVER (PARTITION BY dw_p_id, c.is_premium ORDER BY score DESC, dst) - 1 AS before FROM filtered f JOIN catalog c ON c.content_id = dst)
    SELECT dw_p_id, dst, CASE WHEN decays THEN score * pow(0.5, before // 4) ELSE score END AS score FROM p""")
def _(t):
    return retrieval.premium_decay(filtered(t), t.kwatch.filter("watch_len > 3000"), t.catalog)


@query("w4_position_decay", "SELECT dw_p_id, event_id AS dst, round(sum(value * 2.0 * pow(0.8, pos - 1)), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY dw_p_id ORDER BY value DESC, event_id) AS pos FROM log WHERE event_type = 'view') GROUP BY ALL")
def _(t):
    second = t.between("view").select("dw_p_id", F.col("event_id").alias("dst"), F.col("value").alias("score"))
    return r6(retrieval.blend_lists(second.filter("false"), second, 2.0, whole_logs=True))


@query("k16_export_unseen", f"SELECT DISTINCT dw_p_id, k AS item FROM log l WHERE event_type IN ('view', 'error') AND NOT EXISTS (SELECT 1 FROM kwatch w WHERE w.dw_p_id = l.dw_p_id AND w.content_id = l.k AND w.last_watch >= {CUT})")
def _(t):
    pred = t.log.filter(F.col("event_type").isin("view", "error")).groupBy("dw_p_id").agg(F.array_sort(F.collect_set("k")).alias("items"))
    latest = t.kwatch.filter(F.col("last_watch") >= CUT).groupBy("dw_p_id").agg(F.collect_set("content_id").alias("latest_ids"))
    return retrieval.export_unseen(pred, latest).select("dw_p_id", F.explode("items").alias("item"))
