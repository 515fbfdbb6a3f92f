"""Ranking-log tables derived from the given tables, as DataFrames and as SQL.

Each domain table is a projection, filter or aggregate of a whole given table; ``Tables`` builds the
Spark form and ``CTES`` holds the same rule as SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CUT = 1705363200  # 2024-01-16 00:00 UTC: history before it, "today" from it
NOW = 1706659200  # 2024-01-31 00:00 UTC
WEEK0 = 1704067200  # 2024-01-01 00:00 UTC
CURVE_DAYS = 85
RECO_EXACT = ["home-picks"]
RECO_PREFIXES = ["home-picks", "reco-picks", "reco-wide"]
POP_VERSIONS = ["2024-01-15", "2024-01-17", "2024-01-18"]

CTES: dict[str, str] = {
    "log": f"""
        SELECT event_id, CAST(user_id AS VARCHAR) AS dw_p_id, k, 1 + k % 10 AS content_id,
               CASE (k // 10) % 4 WHEN 0 THEN 'home-picks' WHEN 1 THEN 'reco-picks-a' WHEN 2 THEN 'reco-wide-b' ELSE 'other' END AS full_tray_id,
               epoch_us(ts) // 1000000 AS timestamp, CAST(round(value * 20) AS BIGINT) AS watch_time, event_type, value,
               CAST(CAST(ts AS DATE) AS VARCHAR) AS cd, CASE WHEN user_id % 4 = 0 THEN 'my' ELSE 'in' END AS country,
               CAST(k % 3 AS INTEGER) AS language
        FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)""",
    "impressions": f"""
        SELECT dw_p_id, full_tray_id, CASE WHEN value < 0.5 THEN 'n/a' ELSE CAST(content_id AS VARCHAR) END AS content_id,
               timestamp, k % 7 AS tile_position
        FROM log WHERE event_type = 'view' AND timestamp >= {CUT}""",
    "clicks": f"SELECT dw_p_id, content_id, timestamp, full_tray_id FROM log WHERE event_type = 'click' AND timestamp >= {CUT}",
    "tray_watches": f"SELECT dw_p_id, full_tray_id AS tray_id, content_id, watch_time FROM log WHERE event_type = 'purchase' AND timestamp >= {CUT}",
    "daily": f"""
        SELECT dw_p_id, content_id, language, watch_time, timestamp AS first_watch_ts, timestamp AS last_watch_ts
        FROM log WHERE event_type = 'purchase' AND timestamp >= {CUT}""",
    "history": f"""
        SELECT dw_p_id, content_id, language, watch_time AS watch_len, timestamp AS first_watch, timestamp AS last_watch
        FROM log WHERE event_type = 'purchase' AND timestamp < {CUT}""",
    "latest": f"SELECT dw_p_id, content_id FROM log WHERE event_type = 'click' AND timestamp < {CUT}",
    "watchlist": "SELECT dw_p_id, CASE WHEN k % 2 = 0 THEN 1 ELSE 2 END AS action, content_id, timestamp FROM log WHERE event_type = 'signup'",
    "paywall": "SELECT dw_p_id, CAST(content_id AS VARCHAR) AS normalized_content_id, timestamp FROM log WHERE event_type = 'error'",
    "ep_map": "SELECT p_partkey AS episode_id, p_partkey - 1 AS show_id FROM part WHERE p_size > 25 AND p_partkey > 1",
    "requests": "SELECT event_id, dw_p_id, country, timestamp, k, value, watch_time, cd FROM log WHERE event_type = 'signup'",
    "catalog": f"""
        SELECT p_partkey AS content_id, CASE WHEN p_partkey % 2 = 0 THEN 'show' ELSE 'movie' END AS kind,
               CASE WHEN p_partkey % 2 = 0 THEN 100 WHEN p_size % 5 = 0 THEN 300 ELSE 200 END AS content_type_id,
               studio_id, studio_id % 7 AS production_house_id, p_size % 4 AS parental_rating,
               CASE WHEN p_retailprice * 10 % 3 < 1 THEN 'premium' ELSE 'free' END AS entitlement, p_size % 3 AS priority, 2024 - p_size % 6 AS year,
               CASE WHEN p_size = 7 THEN CAST([] AS INTEGER[]) ELSE [CAST(p_size AS INTEGER), CAST(50 + p_partkey % 11 AS INTEGER)] END AS genre_ids,
               [CAST(p_partkey % 3 AS INTEGER), CAST(3 + p_partkey % 2 AS INTEGER)] AS language_ids, CAST(p_partkey % 3 AS INTEGER) AS primary_language,
               {CUT}::BIGINT - (p_size - 5) * 86400 AS start_dt, {CUT}::BIGINT - (p_size - 3) * 86400 AS first_broadcast, {CUT}::BIGINT - (p_size - 3) * 43200 AS last_broadcast,
               p_retailprice * 10 % 3 < 1 AS is_premium, studio_id <= 5 AS is_brand, p_size = 50 AS deleted, p_size = 49 AS hidden,
               studio_id % 9 AS channel_id
        FROM (SELECT *, CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS studio_id FROM part)""",
    "videos": """
        SELECT p_partkey AS content_id, CASE WHEN p_partkey % 2 = 0 THEN 'sports' ELSE 'news' END AS section,
               CASE WHEN p_partkey % 2 = 0 THEN CASE p_size % 3 WHEN 0 THEN 301 WHEN 1 THEN 303 ELSE 304 END
                    ELSE CASE p_size % 2 WHEN 0 THEN 401 ELSE 402 END END AS content_type_id,
               p_size * 4 - 20 AS duration, p_size % 4 = 0 AS is_live_news
        FROM part""",
    "ns_watches": """
        SELECT dw_p_id, k AS content_id, language, CAST(floor(value * 5) AS BIGINT) AS watch_len, timestamp AS first_watch, timestamp AS last_watch,
               CASE WHEN k % 3 = 0 THEN 'live' ELSE 'ns' END AS feed
        FROM log WHERE event_type = 'error'""",
    "kwatch": """
        SELECT dw_p_id, k AS content_id, language, watch_time AS watch_len, timestamp AS first_watch, timestamp AS last_watch
        FROM log WHERE event_type = 'purchase'""",
    "rel": """
        SELECT l_partkey AS src, CAST(l_partkey % 3 AS INTEGER) AS src_lang, l_suppkey AS dst, CAST(l_suppkey % 3 AS INTEGER) AS dst_lang,
               CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / (10 + count(*)) AS score
        FROM lineitem GROUP BY ALL""",
    "tokens": "SELECT p_partkey AS content_id, CAST(p_partkey % 3 AS INTEGER) AS language, p_name || '/' || p_brand AS name, p_size / 50.0::DOUBLE AS weight FROM part",
    "token_rel": "SELECT p_name || '/' || p_brand AS name, p_partkey AS dst, CAST(p_partkey % 3 AS INTEGER) AS dst_lang, p_size / 100.0::DOUBLE AS score FROM part",
    "pop": f"""
        SELECT cd AS version, content_id, language AS language_id,
               count(*) FILTER (event_type = 'view') / (10.0::DOUBLE + count(*)) AS dv, count(*) FILTER (event_type = 'click') / (10.0::DOUBLE + count(*)) AS wv
        FROM log WHERE cd IN ('{"', '".join(POP_VERSIONS)}') GROUP BY ALL""",
    "state_pop": f"""
        SELECT cd AS version, country AS state, content_id,
               count(*) FILTER (event_type = 'view') / (20.0::DOUBLE + count(*)) AS dv, count(*) FILTER (event_type = 'click') / (20.0::DOUBLE + count(*)) AS wv
        FROM log WHERE cd IN ('{"', '".join(POP_VERSIONS)}') GROUP BY ALL""",
    "pop_tags": """
        SELECT cd AS day, content_id, language AS language_id,
               CASE event_type WHEN 'view' THEN 'dc' WHEN 'click' THEN 'wc' WHEN 'purchase' THEN 'mc' WHEN 'signup' THEN 'dv' ELSE 'zz' END AS tag, value
        FROM log""",
    "day_pop": """
        SELECT day, content_id, language, percent_rank() OVER (PARTITION BY day ORDER BY n) AS popularity
        FROM (SELECT timestamp // 86400 AS day, k AS content_id, language, count(*) AS n FROM log GROUP BY ALL)""",
    "scored": f"""
        SELECT event_id, dw_p_id, (timestamp - {WEEK0}) // 604800 AS timestamp, k AS content_id, value / 500.0::DOUBLE AS base,
               (event_id * 7) % 97 / 97.0::DOUBLE AS sd, (event_id * 13) % 89 / 89.0::DOUBLE AS mean,
               CAST(event_type IN ('click', 'purchase') AS BIGINT) AS label, CAST(event_type = 'click' AS BIGINT) AS click, CAST(event_type = 'error' AS BIGINT) AS task
        FROM log""",
    "tags": """
        SELECT p_partkey AS content_id, CASE WHEN p_size < 10 THEN 'High' WHEN p_size < 20 THEN 'Medium' ELSE 'Low' END AS popularity_tag
        FROM part WHERE p_size < 35""",
    "tagged": "SELECT s.*, coalesce(t.popularity_tag, 'Unmapped') AS category FROM scored s LEFT JOIN tags t USING (content_id)",
    "curve_watches": """
        SELECT CAST(o_custkey AS VARCHAR) AS dw_p_id, l_partkey % 50 AS content_id, CAST(l_linenumber % 5 AS INTEGER) AS language,
               CAST(l_quantity * 60 AS BIGINT) AS watch_time, day * 86400 + l_orderkey % 86400 AS first_watch_ts, day * 86400 + l_orderkey % 86400 AS last_watch_ts,
               day AS watch_dt, CAST(DATE '1970-01-01' + CAST(day AS INTEGER) AS VARCHAR) AS cd
        FROM (SELECT *, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) // 30 AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "curve_history": "SELECT dw_p_id, content_id, min(first_watch_ts) AS first_watch FROM curve_watches GROUP BY ALL",
    "titles": """
        SELECT CAST(p_partkey AS VARCHAR) AS show_content_id, CAST(DATE '1997-01-01' + CAST(p_size * 10 AS INTEGER) AS VARCHAR) AS fromdate,
               CASE WHEN p_size % 7 = 0 THEN 'CLIP' WHEN p_partkey % 2 = 0 THEN 'movie' ELSE ' Episode ' END AS sub_type,
               CASE WHEN p_size % 9 = 0 THEN '20' ELSE '10' END AS clip_status, CASE WHEN p_size % 11 = 0 THEN ' Test' ELSE p_name END AS title,
               CASE WHEN p_size % 13 = 0 THEN '1' ELSE '0' END AS trailer_flag
        FROM part""",
    "view_log": """
        SELECT CAST(l_partkey AS VARCHAR) AS sub_title_id, CAST(o_custkey AS VARCHAR) AS dw_p_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS cd,
               CASE WHEN l_returnflag = 'R' THEN 'sports' ELSE 'ent' END AS category, l_quantity - 5 AS watch_minutes
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "acts": """
        SELECT vec_id, CAST(vec_id // 10 AS VARCHAR) AS dw_p_id, vec_id // 10 AS timestamp, label AS content_id, vec_id % 40 + 1 AS item, vec_id % 4 AS day,
               CAST(embedding AS DOUBLE[]) AS h, CASE WHEN vec_id % 11 = 0 THEN -1 WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END AS click
        FROM embeddings""",
    "users": "SELECT DISTINCT dw_p_id FROM log",
}


class Tables:
    """Domain tables of one folder. Every attribute is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def between(self, event: str, history: bool | None = None) -> DataFrame:
        df = self.log.filter(F.col("event_type") == event)
        if history is None:
            return df
        return df.filter(F.col("timestamp") < CUT if history else F.col("timestamp") >= CUT)

    @cached_property
    def log(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("bigint")
        seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))")
        tray = F.floor(F.col("k") / 10) % 4
        return self.raw("events").withColumn("k", k).select(
            "event_id", F.col("user_id").cast("string").alias("dw_p_id"), "k", (1 + F.col("k") % 10).alias("content_id"),
            F.when(tray == 0, "home-picks").when(tray == 1, "reco-picks-a").when(tray == 2, "reco-wide-b").otherwise("other").alias("full_tray_id"),
            seconds.alias("timestamp"), F.round(F.col("value") * 20).cast("bigint").alias("watch_time"), "event_type", "value",
            F.to_date("ts").cast("string").alias("cd"), F.when(F.col("user_id") % 4 == 0, "my").otherwise("in").alias("country"),
            (F.col("k") % 3).cast("int").alias("language"))

    @cached_property
    def impressions(self) -> DataFrame:
        ref = F.when(F.col("value") < 0.5, "n/a").otherwise(F.col("content_id").cast("string"))
        return self.between("view", False).select("dw_p_id", "full_tray_id", ref.alias("content_id"), "timestamp", (F.col("k") % 7).alias("tile_position"))

    @cached_property
    def clicks(self) -> DataFrame:
        return self.between("click", False).select("dw_p_id", "content_id", "timestamp", "full_tray_id")

    @cached_property
    def tray_watches(self) -> DataFrame:
        return self.between("purchase", False).select("dw_p_id", F.col("full_tray_id").alias("tray_id"), "content_id", "watch_time")

    @cached_property
    def daily(self) -> DataFrame:
        return self.between("purchase", False).select(
            "dw_p_id", "content_id", "language", "watch_time", F.col("timestamp").alias("first_watch_ts"), F.col("timestamp").alias("last_watch_ts"))

    @cached_property
    def history(self) -> DataFrame:
        return self._watched(self.between("purchase", True), "content_id")

    @staticmethod
    def _watched(df: DataFrame, content: str) -> DataFrame:
        return df.select("dw_p_id", F.col(content).alias("content_id"), "language", F.col("watch_time").alias("watch_len"),
                         F.col("timestamp").alias("first_watch"), F.col("timestamp").alias("last_watch"))

    @cached_property
    def latest(self) -> DataFrame:
        return self.between("click", True).select("dw_p_id", "content_id")

    @cached_property
    def watchlist(self) -> DataFrame:
        return self.between("signup").select("dw_p_id", F.when(F.col("k") % 2 == 0, 1).otherwise(2).alias("action"), "content_id", "timestamp")

    @cached_property
    def paywall(self) -> DataFrame:
        return self.between("error").select("dw_p_id", F.col("content_id").cast("string").alias("normalized_content_id"), "timestamp")

    @cached_property
    def ep_map(self) -> DataFrame:
        return self.raw("part").filter("p_size > 25 and p_partkey > 1").select(F.col("p_partkey").alias("episode_id"), (F.col("p_partkey") - 1).alias("show_id"))

    @cached_property
    def requests(self) -> DataFrame:
        """Request events with a typed payload, one per sign-up row."""
        watch = lambda cid, ago: F.struct(cid.cast("string").alias("content_id"), F.col("watch_time").alias("watch_time"), (F.col("timestamp") - ago).alias("timestamp"))
        utf8 = lambda c: F.encode(c, "UTF-8")
        features = F.create_map(F.lit(5), utf8(F.col("cd")), F.lit(6), utf8(F.col("cd")), F.lit(7), utf8(F.upper("country")))
        return self.between("signup").select(
            "event_id", "dw_p_id", "country", "timestamp", "k", "value", "watch_time", "cd", F.lit(2024).alias("event_year"),
            F.struct(
                F.struct(F.array("k", F.lit(7).cast("bigint") + F.col("k") % 2).alias("fids"), F.array("k").alias("weighted_fids"), F.array("value").alias("fid_weights")).alias("user_feature"),
                F.struct(
                    F.array(watch(F.col("content_id"), 86400), watch(1 + F.floor(F.col("k") / 10), 864000)).alias("ent_watches"),
                    F.array(F.col("value"), F.col("value") / 2).alias("ent_watch_weights"),
                    F.create_map(F.concat(F.lit("l"), F.col("language").cast("string")), F.col("value").cast("float")).alias("lpv"),
                    features.alias("serialized_features")).alias("raw_feature"),
            ).alias("payload"))

    @cached_property
    def catalog(self) -> DataFrame:
        size, key = F.col("p_size"), F.col("p_partkey")
        premium = F.col("p_retailprice") * 10 % 3 < 1
        part = self.raw("part").withColumn("studio_id", F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int"))
        genres = F.when(size == 7, F.array().cast("array<int>")).otherwise(F.array(size.cast("int"), (50 + key % 11).cast("int")))
        return part.select(
            key.alias("content_id"), F.when(key % 2 == 0, "show").otherwise("movie").alias("kind"),
            F.when(key % 2 == 0, 100).when(size % 5 == 0, 300).otherwise(200).alias("content_type_id"),
            "studio_id", (F.col("studio_id") % 7).alias("production_house_id"), (size % 4).alias("parental_rating"),
            F.when(premium, "premium").otherwise("free").alias("entitlement"), (size % 3).alias("priority"), (2024 - size % 6).alias("year"),
            genres.alias("genre_ids"), F.array((key % 3).cast("int"), (3 + key % 2).cast("int")).alias("language_ids"), (key % 3).cast("int").alias("primary_language"),
            (F.lit(CUT).cast("bigint") - (size - 5) * 86400).alias("start_dt"), (F.lit(CUT).cast("bigint") - (size - 3) * 86400).alias("first_broadcast"),
            (F.lit(CUT).cast("bigint") - (size - 3) * 43200).alias("last_broadcast"), premium.alias("is_premium"), (F.col("studio_id") <= 5).alias("is_brand"),
            (size == 50).alias("deleted"), (size == 49).alias("hidden"), (F.col("studio_id") % 9).alias("channel_id"))

    @cached_property
    def videos(self) -> DataFrame:
        size, key = F.col("p_size"), F.col("p_partkey")
        sports = F.when(size % 3 == 0, 301).when(size % 3 == 1, 303).otherwise(304)
        return self.raw("part").select(
            key.alias("content_id"), F.when(key % 2 == 0, "sports").otherwise("news").alias("section"),
            F.when(key % 2 == 0, sports).otherwise(F.when(size % 2 == 0, 401).otherwise(402)).alias("content_type_id"),
            (size * 4 - 20).alias("duration"), (size % 4 == 0).alias("is_live_news"))

    @cached_property
    def ns_watches(self) -> DataFrame:
        return self.between("error").select(
            "dw_p_id", F.col("k").alias("content_id"), "language", F.floor(F.col("value") * 5).cast("bigint").alias("watch_len"),
            F.col("timestamp").alias("first_watch"), F.col("timestamp").alias("last_watch"), F.when(F.col("k") % 3 == 0, "live").otherwise("ns").alias("feed"))

    @cached_property
    def kwatch(self) -> DataFrame:
        return self._watched(self.between("purchase"), "k")

    @cached_property
    def rel(self) -> DataFrame:
        src = F.col("l_partkey")
        return self.raw("lineitem").groupBy(
            src.alias("src"), (src % 3).cast("int").alias("src_lang"), F.col("l_suppkey").alias("dst"), (F.col("l_suppkey") % 3).cast("int").alias("dst_lang"),
        ).agg((F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).cast("double") / (10 + F.count(F.lit(1)))).alias("score"))

    @cached_property
    def tokens(self) -> DataFrame:
        return self.raw("part").select(F.col("p_partkey").alias("content_id"), (F.col("p_partkey") % 3).cast("int").alias("language"),
                                       F.concat_ws("/", "p_name", "p_brand").alias("name"), (F.col("p_size") / 50.0).alias("weight"))

    @cached_property
    def token_rel(self) -> DataFrame:
        return self.raw("part").select(F.concat_ws("/", "p_name", "p_brand").alias("name"), F.col("p_partkey").alias("dst"), (F.col("p_partkey") % 3).cast("int").alias("dst_lang"),
                                       (F.col("p_size") / 100.0).alias("score"))

    def _shares(self, keys: list, base: float) -> DataFrame:
        part = lambda e: F.count_if(F.col("event_type") == e) / (F.lit(base) + F.count(F.lit(1)))
        return self.log.filter(F.col("cd").isin(POP_VERSIONS)).groupBy(*keys).agg(part("view").alias("dv"), part("click").alias("wv"))

    @cached_property
    def pop(self) -> DataFrame:
        return self._shares([F.col("cd").alias("version"), "content_id", F.col("language").alias("language_id")], 10.0)

    @cached_property
    def state_pop(self) -> DataFrame:
        return self._shares([F.col("cd").alias("version"), F.col("country").alias("state"), "content_id"], 20.0)

    @cached_property
    def pop_tags(self) -> DataFrame:
        e = F.col("event_type")
        tag = F.when(e == "view", "dc").when(e == "click", "wc").when(e == "purchase", "mc").when(e == "signup", "dv").otherwise("zz")
        return self.log.select(F.col("cd").alias("day"), "content_id", F.col("language").alias("language_id"), tag.alias("tag"), "value")

    @cached_property
    def day_pop(self) -> DataFrame:
        counts = self.log.groupBy(F.floor(F.col("timestamp") / 86400).cast("bigint").alias("day"), F.col("k").alias("content_id"), "language").agg(F.count(F.lit(1)).alias("n"))
        return counts.select("day", "content_id", "language", F.percent_rank().over(Window.partitionBy("day").orderBy("n")).alias("popularity"))

    @cached_property
    def scored(self) -> DataFrame:
        e = F.col("event_type")
        return self.log.select(
            "event_id", "dw_p_id", F.floor((F.col("timestamp") - WEEK0) / 604800).cast("bigint").alias("timestamp"), F.col("k").alias("content_id"),
            (F.col("value") / 500.0).alias("base"), ((F.col("event_id") * 7) % 97 / 97.0).alias("sd"), ((F.col("event_id") * 13) % 89 / 89.0).alias("mean"),
            e.isin("click", "purchase").cast("bigint").alias("label"), (e == "click").cast("bigint").alias("click"), (e == "error").cast("bigint").alias("task"))

    @cached_property
    def tags(self) -> DataFrame:
        tag = F.when(F.col("p_size") < 10, "High").when(F.col("p_size") < 20, "Medium").otherwise("Low")
        return self.raw("part").filter("p_size < 35").select(F.col("p_partkey").alias("content_id"), tag.alias("popularity_tag"))

    @cached_property
    def tagged(self) -> DataFrame:
        return self.scored.join(self.tags, "content_id", "left").withColumn("category", F.coalesce("popularity_tag", F.lit("Unmapped"))).drop("popularity_tag")

    def _orders(self) -> DataFrame:
        return self.raw("lineitem").join(self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))

    @cached_property
    def curve_watches(self) -> DataFrame:
        day = F.floor(F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")) / 30).cast("bigint")
        at = (F.col("day") * 86400 + F.col("l_orderkey") % 86400)
        return self._orders().withColumn("day", day).select(
            F.col("o_custkey").cast("string").alias("dw_p_id"), (F.col("l_partkey") % 50).alias("content_id"), (F.col("l_linenumber") % 5).cast("int").alias("language"),
            (F.col("l_quantity") * 60).cast("bigint").alias("watch_time"), at.alias("first_watch_ts"), at.alias("last_watch_ts"), F.col("day").alias("watch_dt"),
            F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int")).cast("string").alias("cd"))

    @cached_property
    def curve_history(self) -> DataFrame:
        return self.curve_watches.groupBy("dw_p_id", "content_id").agg(F.min("first_watch_ts").alias("first_watch"))

    @cached_property
    def titles(self) -> DataFrame:
        size, key = F.col("p_size"), F.col("p_partkey")
        return self.raw("part").select(
            key.cast("string").alias("show_content_id"), F.date_add(F.lit("1997-01-01").cast("date"), size * 10).alias("fromdate"),
            F.when(size % 7 == 0, "CLIP").when(key % 2 == 0, "movie").otherwise(" Episode ").alias("sub_type"),
            F.when(size % 9 == 0, "20").otherwise("10").alias("clip_status"), F.when(size % 11 == 0, " Test").otherwise(F.col("p_name")).alias("title"),
            F.when(size % 13 == 0, "1").otherwise("0").alias("trailer_flag"))

    @cached_property
    def view_log(self) -> DataFrame:
        return self._orders().select(
            F.col("l_partkey").cast("string").alias("sub_title_id"), F.col("o_custkey").cast("string").alias("dw_p_id"), F.to_date("o_orderdate").alias("cd"),
            F.when(F.col("l_returnflag") == "R", "sports").otherwise("ent").alias("category"), (F.col("l_quantity") - 5).alias("watch_minutes"))

    @cached_property
    def acts(self) -> DataFrame:
        vec = F.col("vec_id")
        tens = F.floor(vec / 10).cast("bigint")
        return self.raw("embeddings").select(
            "vec_id", tens.cast("string").alias("dw_p_id"), tens.alias("timestamp"), F.col("label").alias("content_id"), (vec % 40 + 1).alias("item"), (vec % 4).alias("day"),
            F.col("embedding").cast("array<double>").alias("h"), F.when(vec % 11 == 0, -1).when(vec % 3 == 0, 1).otherwise(0).alias("click"))

    @cached_property
    def users(self) -> DataFrame:
        return self.log.select("dw_p_id").distinct()


_CACHE: dict[tuple[int, str], Tables] = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Tables of a folder, built once per session."""
    key = (id(spark), sf_dir)
    if key not in _CACHE or _CACHE[key].spark is not spark:
        _CACHE[key] = Tables(spark, sf_dir)
    return _CACHE[key]
