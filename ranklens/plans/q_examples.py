"""Queries for example building, sampling and feature rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ranklens.functions.hashing import hash_uniform, slot_fid
from ranklens.operators import examples, features, filters
from ranklens.operators.features import SLOTS
from ranklens.plans import daily, extract
from ranklens.plans.domain import RECO_EXACT, RECO_PREFIXES
from ranklens.plans.registry import ORACLES, query, rows_n
from ranklens.session import scratch_path
from ranklens.sources.logs import stage

_RECO = "(starts_with(full_tray_id, 'home-picks') OR starts_with(full_tray_id, 'reco-picks') OR starts_with(full_tray_id, 'reco-wide'))"


def reco():
    return filters.is_reco_tray(F.col("full_tray_id"), RECO_EXACT, RECO_PREFIXES)


def draw_sql(keys: list[str], salt: str) -> str:
    text = " || '|' || ".join([f"CAST({k} AS VARCHAR)" for k in keys] + [f"'{salt}'"])
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


_FIRST = "SELECT dw_p_id, full_tray_id AS tray_id, try_cast(content_id AS BIGINT) AS content_id, min(timestamp) AS timestamp FROM impressions WHERE try_cast(content_id AS BIGINT) <> 0 GROUP BY ALL"
_SUMS = """SELECT dw_p_id, tray_id, content_id, CAST(sum(watch_time) AS BIGINT) AS watch_time FROM tray_watches
    WHERE (dw_p_id, tray_id) IN (SELECT (dw_p_id, full_tray_id) FROM impressions) GROUP BY ALL"""
_IMPR = f"""
    SELECT f.dw_p_id, f.tray_id, f.content_id, f.timestamp, CASE WHEN s.watch_time > 600 THEN 1 ELSE 0 END::BIGINT AS label, CASE WHEN s.watch_time > 600 THEN s.watch_time ELSE 0 END::BIGINT AS watch_time, false AS is_inter_tray
    FROM ({_FIRST}) f LEFT JOIN ({_SUMS}) s USING (dw_p_id, tray_id, content_id)
    WHERE (f.dw_p_id, f.tray_id) IN (SELECT (dw_p_id, tray_id) FROM ({_SUMS}))
      AND (s.watch_time > 600 OR (s.watch_time IS NULL AND NOT EXISTS (SELECT 1 FROM history h WHERE h.dw_p_id = f.dw_p_id AND h.content_id = f.content_id)))"""


def impression_examples(t):
    return examples.impression_examples(t.impressions, t.tray_watches, t.history)


def labelled(t):
    """The same, written once for the samplers, which read it several times."""
    return stage(impression_examples(t), "impressions")


@query("e1_first_impressions", _FIRST)
def _(t):
    return examples.first_impressions(t.impressions)


@query("e2_tray_watch_sums", _SUMS)
def _(t):
    return examples.tray_watch_sums(t.tray_watches, t.impressions)


@query("e3_impression_examples", _IMPR)
def _(t):
    return impression_examples(t)


_KEY = ["dw_p_id", "tray_id", "content_id", "timestamp"]
_CAP = lambda ratio: f"""
    SELECT dw_p_id, tray_id, content_id, timestamp, label, watch_time, is_inter_tray FROM (
        SELECT *, sum(label) OVER (PARTITION BY dw_p_id, tray_id) AS pos, row_number() OVER (PARTITION BY dw_p_id, tray_id, label ORDER BY {draw_sql(_KEY, 'cap')}, content_id) AS rn FROM ({_IMPR}))
    WHERE pos > 0 AND (label = 1 OR rn <= {ratio} * pos)"""
_INTER = f"""
    SELECT dw_p_id, tray_id, content_id, timestamp, label, watch_time, true AS is_inter_tray FROM (
        SELECT *, row_number() OVER (PARTITION BY dw_p_id ORDER BY {draw_sql(_KEY, 'inter')}, tray_id, content_id) AS rn FROM (
            SELECT *, sum(label) OVER (PARTITION BY dw_p_id, tray_id) AS pos, sum(label) OVER (PARTITION BY dw_p_id) AS total FROM ({_IMPR})) WHERE pos = 0) WHERE rn <= total"""


@query("e4_cap_negatives", _CAP(5))
def _(t):
    return examples.cap_negatives(labelled(t))


@query("e4_cap_negatives_tight", _CAP(1))
def _(t):
    return examples.cap_negatives(labelled(t), ratio=1)


@query("e5_inter_tray_negatives", _INTER)
def _(t):
    return examples.inter_tray_negatives(labelled(t))


_FIRST_WATCH = """
    SELECT dw_p_id, '' AS tray_id, content_id, first_watch_ts AS timestamp, 1::BIGINT AS label, watch_time, false AS is_inter_tray FROM daily d
    WHERE watch_time > 600 AND NOT EXISTS (SELECT 1 FROM history h WHERE h.dw_p_id = d.dw_p_id AND h.content_id = d.content_id)
    QUALIFY row_number() OVER (PARTITION BY dw_p_id ORDER BY first_watch_ts, content_id, watch_time) = 1"""


@query("e6_first_watch_examples", _FIRST_WATCH)
def _(t):
    return examples.first_watch_examples(t.daily, t.history)


_RFIRST = _FIRST.replace("FROM impressions WHERE", f"FROM impressions WHERE {_RECO} AND")
_POS = f"""
    SELECT c.dw_p_id, c.tray_id, c.content_id, c.timestamp, 1::BIGINT AS click, CASE WHEN w.s > 600 THEN 1 ELSE 0 END::BIGINT AS watch, coalesce(w.s, 0)::BIGINT AS watch_time,
           CASE WHEN p.ts > c.click_ts THEN 1 ELSE 0 END::BIGINT AS paywall_view, CASE WHEN l.ts > c.click_ts THEN 1 ELSE 0 END::BIGINT AS add_watchlist
    FROM (SELECT k.dw_p_id, k.full_tray_id AS tray_id, k.content_id, k.timestamp AS click_ts, f.timestamp FROM clicks k
          JOIN ({_RFIRST}) f ON f.dw_p_id = k.dw_p_id AND f.tray_id = k.full_tray_id AND f.content_id = k.content_id WHERE {_RECO}
          QUALIFY row_number() OVER (PARTITION BY k.dw_p_id, k.content_id ORDER BY k.timestamp, k.full_tray_id) = 1) c
    LEFT JOIN (SELECT dw_p_id, content_id, sum(watch_time) AS s FROM daily WHERE watch_time > 0 GROUP BY ALL) w ON w.dw_p_id = c.dw_p_id AND w.content_id = c.content_id
    LEFT JOIN (SELECT dw_p_id, coalesce(show_id, CAST(normalized_content_id AS BIGINT)) AS content_id, max(timestamp) AS ts FROM paywall LEFT JOIN ep_map ON episode_id = CAST(normalized_content_id AS BIGINT) GROUP BY ALL) p
        ON p.dw_p_id = c.dw_p_id AND p.content_id = c.content_id
    LEFT JOIN (SELECT dw_p_id, content_id, max(timestamp) AS ts FROM watchlist WHERE action = 1 GROUP BY ALL) l ON l.dw_p_id = c.dw_p_id AND l.content_id = c.content_id"""
_NEG = f"""
    SELECT dw_p_id, tray_id, content_id, timestamp, 0::BIGINT AS click, 0::BIGINT AS watch, 0::BIGINT AS watch_time, 0::BIGINT AS paywall_view, 0::BIGINT AS add_watchlist FROM ({_RFIRST}) f
    WHERE NOT EXISTS (SELECT 1 FROM clicks c WHERE c.dw_p_id = f.dw_p_id AND c.content_id = f.content_id) AND NOT EXISTS (SELECT 1 FROM daily d WHERE d.dw_p_id = f.dw_p_id AND d.content_id = f.content_id AND d.watch_time > 0)
    QUALIFY row_number() OVER (PARTITION BY dw_p_id, content_id ORDER BY timestamp, tray_id) = 1"""
_BOTH = f"SELECT * FROM (SELECT * FROM ({_POS}) UNION ALL SELECT * FROM ({_NEG})) WHERE dw_p_id IN (SELECT dw_p_id FROM ({_POS})) AND dw_p_id IN (SELECT dw_p_id FROM ({_NEG}))"


def positives(t):
    return examples.mtl_positives(t.impressions, t.clicks, t.daily, t.paywall, t.watchlist, t.ep_map, reco())


def negatives(t):
    return examples.mtl_negatives(t.impressions, t.clicks, t.daily, reco())


@query("e7_mtl_positives", _POS)
def _(t):
    return positives(t)


@query("e8_mtl_negatives", _NEG)
def _(t):
    return negatives(t)


@query("e9_downsample", f"SELECT * FROM ({_BOTH}) WHERE click > 0 OR {draw_sql(_KEY, 'neg')} < 0.3")
def _(t):
    return examples.mtl_examples(positives(t), negatives(t), 0.3)


@query("e10_hash_sample", f"SELECT event_id, dw_p_id, round({draw_sql(['dw_p_id', 'cd'], '2024-01-31')}, 8) AS u FROM log WHERE {draw_sql(['dw_p_id', 'cd'], '2024-01-31')} < 0.25")
def _(t):
    rows = examples.hash_sample(t.log, ["dw_p_id", "cd"], 0.25, "2024-01-31")
    return rows.select("event_id", "dw_p_id", F.round(hash_uniform(["dw_p_id", "cd"], "2024-01-31"), 8).alias("u"))


_PCAT = "(SELECT content_id, start_dt, row_number() OVER (ORDER BY content_id) - 1 AS idx FROM catalog)"


@query("e11_random_negatives", f"""
    WITH pos AS ({_FIRST_WATCH}), draws AS (SELECT dw_p_id, content_id, timestamp, CAST(floor({draw_sql(['dw_p_id', 'content_id', 'timestamp', 'draw'], 'rand')} * (SELECT count(*) FROM catalog)) AS BIGINT) AS idx
        FROM (SELECT *, unnest(range(0, 20)) AS draw FROM pos))
    SELECT DISTINCT d.dw_p_id, '' AS tray_id, c.content_id, d.timestamp, 0::BIGINT AS label, 0::BIGINT AS watch_time, false AS is_inter_tray, d.content_id AS positive_id FROM draws d JOIN {_PCAT} c USING (idx)
    WHERE c.content_id <> d.content_id AND c.start_dt <= d.timestamp AND NOT EXISTS (SELECT 1 FROM history h WHERE h.dw_p_id = d.dw_p_id AND h.content_id = c.content_id)""")
def _(t):
    return examples.random_negatives(examples.first_watch_examples(t.daily, t.history), t.catalog, t.history, 20)


@query("e11_dense_index", "SELECT content_id, row_number() OVER (ORDER BY content_id) - 1 AS idx FROM catalog")
def _(t):
    return examples.dense_index(t.catalog)


@query("e12_sample_users", f"SELECT dw_p_id, count(*) AS n FROM log WHERE {draw_sql(['dw_p_id'], 'lw')} < 0.4 GROUP BY ALL")
def _(t):
    return examples.sample_users(t.log, 0.4, "lw").groupBy("dw_p_id").agg(rows_n())


@query("e13_require_both_classes", f"SELECT * FROM ({_IMPR}) WHERE dw_p_id IN (SELECT dw_p_id FROM ({_IMPR}) GROUP BY dw_p_id HAVING max(label) = 1 AND min(label) = 0)")
def _(t):
    return examples.require_both_classes(labelled(t), ["dw_p_id"])


@query("j3_full_outer", f"""
    SELECT dw_p_id, mtl_examples, tray_examples, first_watch_examples FROM (SELECT dw_p_id, count(*) AS mtl_examples FROM ({_POS}) GROUP BY ALL)
    FULL JOIN (SELECT dw_p_id, count(*) AS tray_examples FROM ({_IMPR}) GROUP BY ALL) USING (dw_p_id) FULL JOIN (SELECT dw_p_id, count(*) AS first_watch_examples FROM ({_FIRST_WATCH}) GROUP BY ALL) USING (dw_p_id)""")
def _(t):
    return examples.join_example_sets(positives(t), impression_examples(t), examples.first_watch_examples(t.daily, t.history))


# ---- feature rows

_ASOF = "ASOF JOIN (SELECT dw_p_id, timestamp, max(event_id) AS event_id FROM requests GROUP BY ALL) r ON r.dw_p_id = e.dw_p_id AND e.timestamp > r.timestamp"
_EVW = """evw AS (SELECT event_id, unnest([1 + k % 10, 1 + k // 10]) AS content_id, unnest([value, value / 2]) AS w FROM requests),
    attrs AS (SELECT e.event_id, e.w, c.* FROM evw e JOIN catalog c USING (content_id)),
    pairs AS (SELECT event_id, 'genre:' || unnest(genre_ids) AS k, w FROM attrs UNION ALL SELECT event_id, 'studio_id:' || studio_id, w FROM attrs UNION ALL SELECT event_id, 'parental_rating:' || parental_rating, w FROM attrs
        UNION ALL SELECT event_id, 'content_type_id:' || content_type_id, w FROM attrs UNION ALL SELECT event_id, 'production_house_id:' || production_house_id, w FROM attrs UNION ALL SELECT event_id, 'year_bucket:' || least(greatest(2024 - year, 0), 10), w FROM attrs),
    prof AS (SELECT event_id, k, sum(w) / sum(sum(w)) OVER (PARTITION BY event_id, split_part(k, ':', 1)) AS share FROM pairs GROUP BY event_id, k)"""
_SHARE = lambda expr: f"coalesce((SELECT share FROM prof p WHERE p.event_id = m.event_id AND p.k = {expr}), 0)"
_RESOLVED = "CASE WHEN m.cd > '2024-01-18' THEN '2024-01-18' WHEN m.cd < '2024-01-15' THEN '2024-01-15' WHEN m.cd IN ('2024-01-15', '2024-01-17', '2024-01-18') THEN m.cd END"


def _feature_sql(source: str, extra: str) -> str:
    """Scalar features of matched examples, one column per scalar."""
    return f"""
    WITH {_EVW}, ex AS ({source}), m AS (SELECT e.*, r.event_id, r.timestamp AS event_ts, q.cd, q.country, q.k AS rk, q.value AS rvalue FROM ex e {_ASOF} JOIN requests q ON q.event_id = r.event_id)
    SELECT m.dw_p_id, m.content_id, m.event_ts AS timestamp, {extra}, m.event_ts - c.start_dt AS secs_start_dt,
           round(coalesce((SELECT sum(share) FROM prof p WHERE p.event_id = m.event_id AND p.k IN (SELECT 'genre:' || unnest(c.genre_ids))), 0), 5) AS x1,
           round({_SHARE("'studio_id:' || c.studio_id")}, 5) AS x2, round({_SHARE("'parental_rating:' || c.parental_rating")}, 5) AS x3, round({_SHARE("'content_type_id:' || c.content_type_id")}, 5) AS x4,
           round({_SHARE("'year_bucket:' || least(greatest(2024 - c.year, 0), 10)")}, 5) AS x6, round(1 / (1 + ln(1 + greatest((m.event_ts - c.start_dt) / 86400.0::DOUBLE, 0))), 5) AS x7,
           round({_SHARE("'production_house_id:' || c.production_house_id")}, 5) AS x5,
           {", ".join(f"CAST(m.event_ts - c.start_dt < {d} * 86400 AS INTEGER)::DOUBLE AS x{i}" for i, d in ((8, 3), (9, 7), (10, 30)))},
           rk || ',' || (7 + rk % 2) AS user_fids, CAST(rk AS VARCHAR) AS user_weighted_fids, round(rvalue, 5) AS user_weights,
           round(coalesce(sp.dv, 0), 5) AS x11, round(coalesce(sp.wv, 0), 5) AS x12, round(coalesce(lp.dv, 0), 5) AS x13, round(coalesce(lp.wv, 0), 5) AS x14,
           len(c.genre_ids) + CASE WHEN len(c.genre_ids) = 0 THEN 1 ELSE 0 END + 8 AS n_fids, {_fid_sum('c')} AS fid_sum
    FROM m JOIN catalog c USING (content_id) LEFT JOIN pop lp ON lp.version = {_RESOLVED} AND lp.content_id = m.content_id AND lp.language_id = c.language_ids[1]
    LEFT JOIN state_pop sp ON sp.version = {_RESOLVED} AND sp.content_id = m.content_id AND sp.state = m.country"""


def _h(expr: str) -> str:
    return f"('0x' || substr(md5(CAST({expr} AS VARCHAR)), 1, 12))::BIGINT"


def _fid_sum(c: str) -> str:
    """Sum of all ids with their slots, a check over the id list."""
    id_ = lambda slot, expr: f"({SLOTS[slot]}::BIGINT * 281474976710656 + {_h(expr)})"
    parts = [id_("target_id", f"{c}.content_id"), *[id_(x, f"{c}.{x}") for x in ("entitlement", "content_type_id", "parental_rating", "studio_id", "production_house_id", "priority")]]
    parts.append(id_("year_bucket", f"least(greatest(2024 - {c}.year, 0), 10)"))
    genre = lambda expr: id_("genre_id", expr)
    genres = f"CASE WHEN len({c}.genre_ids) = 0 THEN {genre(chr(39) + 'empty' + chr(39))} ELSE {genre(f'{c}.genre_ids[1]')} + {genre(f'{c}.genre_ids[2]')} END"
    return f"({' + '.join(parts)} + {genres})"


def _flat_features(df, *labels):
    value = lambda i: F.round(F.element_at("sparse_values", F.array_position("sparse_indices", F.lit(i)).cast("int")), 5).alias(f"x{i}")
    whole = F.aggregate("fids", F.lit(0).cast("bigint"), lambda s, f: s + f)
    return df.select("dw_p_id", "content_id", "timestamp", *labels, "secs_start_dt", *[value(i) for i in range(1, 15)],
                     *[F.concat_ws(",", F.col(c).cast("array<string>")).alias(c) for c in ("user_fids", "user_weighted_fids")],
                     F.round(F.aggregate("user_weighted_fid_weights", F.lit(0.0), lambda s, w: s + w), 5).alias("user_weights"),
                     F.size("fids").cast("bigint").alias("n_fids"), whole.alias("fid_sum"))


_SINGLE = _feature_sql(_CAP(5) + " UNION ALL " + _INTER, "m.label")


def _labelled(t):
    """Labelled impressions, written once as both samplers and their counts read them."""
    return stage(examples.impression_examples(t.impressions, t.tray_watches, t.history), "impressions")


def _matched(df):
    return stage(df, "matched")


@query("e14_feature_rows", f"SELECT * FROM ({_SINGLE}) WHERE dw_p_id IN (SELECT dw_p_id FROM ({_SINGLE}) GROUP BY dw_p_id HAVING max(label) = 1 AND min(label) = 0)")
def _(t):
    ex = stage(examples.sampled_examples(_labelled(t)), "examples")
    return _flat_features(features.feature_rows(ex, t.requests, t.catalog, t.pop, t.state_pop.withColumn("state", F.lower("state")), "in", production_house=True, prepare=_matched), "label")


@query("e14_feature_rows_mtl", _feature_sql(f"SELECT * FROM ({_BOTH})", "m.click, m.watch, m.watch_time, m.paywall_view, m.add_watchlist"))
def _(t):
    ex = stage(examples.mtl_examples(positives(t), negatives(t), 1.1), "examples")
    return _flat_features(features.feature_rows(ex, t.requests, t.catalog, t.pop, t.state_pop, "in", mtl=True, production_house=True, prepare=_matched), "click", "watch", "watch_time", "paywall_view", "add_watchlist")


_RANDOM = f"""
    SELECT dw_p_id, tray_id, content_id, timestamp, label, watch_time, is_inter_tray FROM pos
    UNION ALL SELECT DISTINCT d.dw_p_id, '', c.content_id, d.timestamp, 0::BIGINT, 0::BIGINT, false FROM draws d JOIN {_PCAT} c USING (idx)
    WHERE c.content_id <> d.content_id AND c.start_dt <= d.timestamp AND NOT EXISTS (SELECT 1 FROM history h WHERE h.dw_p_id = d.dw_p_id AND h.content_id = c.content_id)"""
_RANDOM_CTES = f"""pos AS (SELECT * FROM ({_FIRST_WATCH}) WHERE {draw_sql(['dw_p_id'], 'lw')} < 0.6),
    draws AS (SELECT dw_p_id, content_id, timestamp, CAST(floor({draw_sql(['dw_p_id', 'content_id', 'timestamp', 'draw'], 'rand')} * (SELECT count(*) FROM catalog)) AS BIGINT) AS idx
        FROM (SELECT *, unnest(range(0, 15)) AS draw FROM pos))"""
_DAY = _feature_sql(f"SELECT *, 0 AS task FROM (SELECT * FROM ({_CAP(5)}) UNION ALL SELECT * FROM ({_INTER})) UNION ALL SELECT *, 1 FROM ({_RANDOM})", "m.label, m.task").replace("WITH evw", f"WITH {_RANDOM_CTES}, evw", 1)


def _random_watch(t):
    positives = stage(examples.sample_users(examples.first_watch_examples(t.daily, t.history), 0.6, "lw"), "first-watch")
    return extract.random_watch_examples(positives, t.catalog, t.history, 15)


@query("e14_extract_day", f"SELECT * FROM ({_DAY}) WHERE (dw_p_id, task) IN (SELECT (dw_p_id, task) FROM ({_DAY}) GROUP BY dw_p_id, task HAVING max(label) = 1 AND min(label) = 0)")
def _(t):
    """Both tasks of a day: exposed items and random-watch items with random negatives."""
    exposed = examples.sampled_examples(_labelled(t))
    out = extract.extract_day(exposed, _random_watch(t), t.requests, t.catalog, t.pop, t.state_pop, "in", production_house=True, prepare=_matched)
    return _flat_features(out, "label", "task")


_MDAY = _feature_sql(f"SELECT dw_p_id, content_id, timestamp, click, watch, watch_time, 0 AS task FROM ({_BOTH}) UNION ALL SELECT dw_p_id, content_id, timestamp, label, label, watch_time, 1 FROM ({_RANDOM})", "m.click, m.task").replace("WITH evw", f"WITH {_RANDOM_CTES}, evw", 1)


@query("e14_training_stats", f"""WITH s AS (SELECT * FROM ({_MDAY}) WHERE task = 0 OR {draw_sql(['dw_p_id', "'2024-01-16'", "'2024-01-31'"], 'agg')} < 0.5)
    SELECT task, count(*) AS n, count(*) FILTER (click > 0) AS post_click, round(count(*) / (SELECT count(*) FROM s), 6) AS share FROM s GROUP BY task""")
def _(t):
    """Shares of the tasks in the sampled multi-task training set."""
    exposed = examples.mtl_examples(positives(t), negatives(t), 1.1)
    day = extract.extract_day(exposed, _random_watch(t), t.requests, t.catalog, t.pop, t.state_pop, "in", mtl=True, prepare=_matched).withColumn("cd", F.lit("2024-01-16"))
    rows = stage(extract.training_set(day, "2024-01-31", 0.5), "training")
    return extract.training_stats(rows).withColumn("share", F.round("share", 6))


_COUNTRY = "CASE WHEN CAST(dw_p_id AS BIGINT) % 2 = 0 THEN 'in' ELSE 'sg' END"


@query("e14_daily_job", f"""
    WITH days AS (SELECT unnest(['2024-01-30', '2024-01-31']) AS cd, unnest([3, 5]) AS part),
    rows AS (SELECT * FROM ({_DAY}) WHERE (dw_p_id, task) IN (SELECT (dw_p_id, task) FROM ({_DAY}) GROUP BY dw_p_id, task HAVING max(label) = 1 AND min(label) = 0)),
    s AS (SELECT cd, {_COUNTRY} AS country, r.* FROM rows r, days WHERE CAST(dw_p_id AS BIGINT) % part <> 0)
    SELECT cd, country, task, dw_p_id, content_id, timestamp, label FROM s WHERE task = 0 OR {draw_sql(['dw_p_id', 'cd', "'2024-01-31'"], 'agg')} < 0.5""")
def _(t):
    """Two days of two countries, the first day run twice; each day leaves out other users."""
    root = scratch_path(t.spark, "daily")
    t.spark.range(1).write.parquet(f"{root}/ready")
    user = F.col("dw_p_id").cast("bigint")

    def rows(part, odd):
        mine = lambda df: df.filter((user % part != 0) & (user % 2 == odd))
        exposed = examples.sampled_examples(stage(examples.impression_examples(mine(t.impressions), t.tray_watches, t.history), "impressions"))
        positives = stage(examples.sample_users(examples.first_watch_examples(mine(t.daily), t.history), 0.6, "lw"), "first-watch")
        second = extract.random_watch_examples(positives, t.catalog, t.history, 15)
        return extract.extract_day(exposed, second, t.requests, t.catalog, t.pop, t.state_pop, "", prepare=_matched)

    for cd, part in (("2024-01-30", 3), ("2024-01-31", 5), ("2024-01-30", 3)):
        countries = {name: (lambda part=part, odd=odd: rows(part, odd)) for odd, name in enumerate(("in", "sg"))}
        daily.run_day(t.spark, f"{root}/features", cd, countries, [f"{root}/ready"], 4)
    picked = daily.run_training(t.spark, f"{root}/features", "2024-01-31", 7, 0.5, f"{root}/training")
    return picked.select("cd", "country", "task", "dw_p_id", "content_id", "timestamp", "label")


_DISC = f"""
    SELECT * FROM (SELECT m.*, CASE WHEN h.wt > 0 THEN h.wt WHEN h.dw_p_id IS NOT NULL OR l.dw_p_id IS NOT NULL THEN -1 ELSE 0 END::BIGINT AS past_wt FROM (
        SELECT dw_p_id, content_id, language, CAST(sum(watch_time) AS BIGINT) AS watch_time, min(first_watch_ts) AS timestamp FROM daily GROUP BY dw_p_id, content_id, language
        QUALIFY row_number() OVER (PARTITION BY dw_p_id, content_id ORDER BY sum(watch_time) DESC, language) = 1) m
        LEFT JOIN (SELECT dw_p_id, content_id, sum(watch_len) AS wt FROM history GROUP BY ALL) h USING (dw_p_id, content_id) LEFT JOIN (SELECT DISTINCT dw_p_id, content_id FROM latest) l USING (dw_p_id, content_id) WHERE watch_time > 600)
    WHERE past_wt = 0 OR (past_wt > 0 AND {draw_sql(['dw_p_id', 'content_id', 'timestamp'], 'disc')} < 0.5)"""


@query("e15_discovery", _DISC)
def _(t):
    return examples.discovery(t.daily, t.latest, t.history, 0.5)


@query("e16_horizon_labels", """
    WITH h AS (SELECT unnest([1::BIGINT, 2, 3, 4, 5, 6, 7]) AS horizon), s AS (SELECT dw_p_id, content_id, horizon, sum(watch_time) AS s FROM curve_watches, h WHERE watch_dt - 36 BETWEEN 0 AND horizon - 1 GROUP BY ALL)
    SELECT dw_p_id, content_id, horizon, round(CAST(s / 3600 AS FLOAT)::DOUBLE, 4) AS cum_watch_time, round(CAST(sum(s) OVER (PARTITION BY dw_p_id, horizon) / 3600 AS FLOAT)::DOUBLE, 4) AS all_watch_time FROM s""")
def _(t):
    rows = examples.horizon_labels(t.curve_watches.withColumn("cd", F.col("cd").cast("date")), "1970-02-06", [1, 2, 3, 4, 5, 6, 7])
    return rows.withColumns({c: F.round(F.col(c).cast("double"), 4) for c in ("cum_watch_time", "all_watch_time")})


_SPLIT = f"""
    SELECT dw_p_id, content_id, before, daily_watch_time - before AS wt_0, i > 0 AS is_sample FROM (
        SELECT *, CASE WHEN i = 0 THEN 0 ELSE floor({draw_sql(['dw_p_id', 'content_id', 'i'], 'split')} * (daily_watch_time - 600 + 1)) END::BIGINT AS before
        FROM (SELECT *, unnest(range(0, 4)) AS i FROM (SELECT dw_p_id, content_id, CAST(sum(watch_time) AS BIGINT) AS daily_watch_time FROM daily GROUP BY ALL) WHERE daily_watch_time >= 600))"""


@query("e17_split_watches", _SPLIT)
def _(t):
    sums = t.daily.groupBy("dw_p_id", "content_id").agg(F.sum("watch_time").alias("daily_watch_time"))
    return examples.split_watches(sums, 3)


@query("e18_labelled_scores", "SELECT vec_id, content_id, click FROM acts WHERE click <> -1")
def _(t):
    return examples.labelled_scores(t.acts).select("vec_id", "content_id", "click")


@query("e19_cumwatch_features", f"""
    WITH base AS ({_DISC}), m AS (SELECT e.*, r.event_id FROM base e {_ASOF}),
    w AS (SELECT event_id, unnest([1 + k % 10, 1 + k // 10]) AS cid, watch_time AS wt, unnest([timestamp - 86400, timestamp - 864000]) AS ts FROM requests),
    o AS (SELECT m.event_id, m.content_id, sum(wt)::BIGINT AS online, max(ts) AS last_ts FROM (SELECT DISTINCT event_id, content_id FROM m) m JOIN w ON w.event_id = m.event_id AND cid = m.content_id GROUP BY ALL)
    SELECT m.dw_p_id, m.content_id, m.language AS language_id, m.timestamp, m.past_wt::DOUBLE AS r1, coalesce(o.online, 0)::DOUBLE AS r2, CASE WHEN o.last_ts > 0 THEN m.timestamp - o.last_ts ELSE 0 END::DOUBLE AS r3,
           CASE WHEN c.kind = 'movie' THEN 1 ELSE 0 END::DOUBLE AS r4, 10 + greatest(len(c.genre_ids), 1) - CASE WHEN kind = 'show' THEN 0 ELSE 1 END AS n_fids,
           {_h("len(list_filter([0, 600, 1800, 3600, 7200, 10800, 36000, 72000, 144000], lambda e: e <= coalesce(o.online, 0)))")} + ({SLOTS['past_watched_time']}::BIGINT << 48) AS past_fid,
           {_h("CASE WHEN o.last_ts > 0 THEN 1 + len(list_filter([0, 259200, 604800, 1209600, 2592000, 5184000, 15552000], lambda e: e <= m.timestamp - o.last_ts)) ELSE 0 END")} + ({SLOTS['last_watch_to_now']}::BIGINT << 48) AS since_fid
    FROM m JOIN catalog c USING (content_id) LEFT JOIN o ON o.event_id = m.event_id AND o.content_id = m.content_id""")
def _(t):
    rows = features.cumwatch_features(examples.discovery(t.daily, t.latest, t.history, 0.5), t.requests, t.catalog)
    slot = lambda n: F.get(F.filter("fids", lambda f: F.shiftright(f, 48) == SLOTS[n]), F.lit(0))
    return rows.select("dw_p_id", "content_id", "language_id", "timestamp", *[F.get("raw", F.lit(i)).alias(f"r{i + 1}") for i in range(4)],
                       F.size("fids").cast("bigint").alias("n_fids"), slot("past_watched_time").alias("past_fid"), slot("last_watch_to_now").alias("since_fid"))


_CUMWATCH = ORACLES["e19_cumwatch_features"]


@query("e16_cumwatch_training", f"""
    WITH f AS ({_CUMWATCH}), w AS (SELECT dw_p_id, content_id, watch_time, date_diff('day', DATE '2024-01-16', CAST(cd AS DATE)) AS d FROM log WHERE event_type = 'purchase'),
    h AS (SELECT unnest([1, 3, 7]) AS horizon), s AS (SELECT dw_p_id, content_id, horizon, sum(watch_time) AS s FROM w, h WHERE d BETWEEN 0 AND horizon - 1 GROUP BY ALL),
    u AS (SELECT dw_p_id, horizon, sum(s) AS a FROM s GROUP BY ALL)
    SELECT f.dw_p_id, f.content_id, f.timestamp, CAST(horizon - 1 AS INTEGER) AS day, f.r1, f.r2, f.n_fids, round(CAST(s / 3600 AS FLOAT)::DOUBLE, 4) AS cum_watch_time, round(CAST(a / 3600 AS FLOAT)::DOUBLE, 4) AS all_watch_time
    FROM f JOIN s USING (dw_p_id, content_id) JOIN u USING (dw_p_id, horizon)""")
def _(t):
    """Cumulative-watch training rows of one discovery day at horizons 1, 3 and 7."""
    rows = features.cumwatch_features(examples.discovery(t.daily, t.latest, t.history, 0.5), t.requests, t.catalog)
    watches = t.between("purchase").select("dw_p_id", "content_id", "watch_time", F.col("cd").cast("date").alias("cd"))
    out = extract.cumwatch_training(rows, watches, "2024-01-16", [1, 3, 7])
    return out.select("dw_p_id", "content_id", "timestamp", "day", F.get("raw", F.lit(0)).alias("r1"), F.get("raw", F.lit(1)).alias("r2"), F.size("fids").cast("bigint").alias("n_fids"),
                      *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("cum_watch_time", "all_watch_time")])


_TW = "SELECT dw_p_id, content_id, watch_len AS watch_time, last_watch AS timestamp FROM kwatch"


@query("e20_target_watches", f"SELECT dw_p_id, content_id, watch_time, timestamp, 'last' AS mode FROM ({_TW}) WHERE watch_time > 600 QUALIFY row_number() OVER (PARTITION BY dw_p_id ORDER BY timestamp DESC, content_id DESC, watch_time DESC) = 1 UNION ALL SELECT *, 'all' FROM ({_TW}) WHERE watch_time > 600")
def _(t):
    rows = t.kwatch.select("dw_p_id", "content_id", F.col("watch_len").alias("watch_time"), F.col("last_watch").alias("timestamp"))
    return examples.target_watches(rows).withColumn("mode", F.lit("last")).unionByName(examples.target_watches(rows, mode="all").withColumn("mode", F.lit("all")))


@query("e21_mix", f"SELECT sampler, dw_p_id, count(*) AS n FROM (SELECT 0 AS sampler, dw_p_id FROM clicks WHERE {draw_sql(['dw_p_id'], 'mix-0')} < 0.7 UNION ALL SELECT 1, dw_p_id FROM daily WHERE {draw_sql(['dw_p_id'], 'mix-1')} < 0.3) GROUP BY ALL")
def _(t):
    return examples.mix([(0.7, t.clicks.select("dw_p_id")), (0.3, t.daily.select("dw_p_id"))]).groupBy("sampler", "dw_p_id").agg(rows_n())


@query("e22_mask_new_titles", f"""
    SELECT event_id, CASE WHEN secs_start_dt <= 10 * 86400 AND {draw_sql(['dw_p_id', 'content_id', 'timestamp'], 'mask')} < 0.5 THEN 0 ELSE (50::BIGINT << 48) + {_h('content_id')} END AS id_fid, (53::BIGINT << 48) + {_h('studio_id')} AS studio_fid
    FROM (SELECT l.*, c.studio_id, l.timestamp - c.start_dt AS secs_start_dt FROM log l JOIN catalog c USING (content_id))""")
def _(t):
    rows = t.log.join(t.catalog, "content_id").select("event_id", "dw_p_id", "content_id", "timestamp", (F.col("timestamp") - F.col("start_dt")).alias("secs_start_dt"),
                                                      F.array(slot_fid(50, F.col("content_id")), slot_fid(53, F.col("studio_id"))).alias("fids"))
    out = examples.mask_new_titles(rows, 50, days=10, rate=0.5)
    return out.select("event_id", F.get("fids", F.lit(0)).alias("id_fid"), F.get("fids", F.lit(1)).alias("studio_fid"))
