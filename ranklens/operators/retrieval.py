"""Candidate retrieval and re-ranking for all users at once.

Scores are joins and grouped sums. List steps run after the per-user cut of ``quota_topk``, so the
windows over one user's list are bounded by the list length. Popularity, burst, new-title and sports
lists reach users as one map by language, so users are not dealt by their few languages.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranklens.functions.hashing import hash_uniform
from ranklens.functions.scalars import recency
from ranklens.operators.joins import dealt_by_target, watch_relevance, without_seen
from ranklens.operators.keyed import SLICE_ROWS, pick_one, places, small_value, top_n

HALF_LIFE = 14 * 86400
# Relevance of a sports or news watch by content type.
NS_TYPE_WEIGHTS = {100: 1.0, 102: 1.0, 105: 1.0, 200: 1.0, 300: 0.1, 301: 1.0, 303: 1.0, 304: 0.1, 401: 0.1}
ANY_LANGUAGE = -1
#: Users, and titles, that meet in one row of a join of both.
USER_TILE, TITLE_TILE = 16_384, 4096
#: Users of a tile whose rows are made together.
AT_ONCE = 8
#: Parts of a join whose small rows make very many: adaptive execution, which goes by bytes, would use too few.
PARTS = 256
#: Titles of one list of names and relevances that travel together, and parts that each user list is dealt to.
LIST_TITLES, LIST_PARTS = 256, 4


def _meet(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Merge join of rows dealt by their keys to a fixed number of parts; no side passes through the driver."""
    return left.repartition(PARTS, *keys).join(right.repartition(PARTS, *keys).hint("merge"), keys, how)


def quota_topk(df: DataFrame, by: list[str], order: list[Column], n: int, kind_min: int, kind: str = "kind",
               flag: str | None = None) -> DataFrame:
    """First n rows per group, plus enough of each kind (and of flagged rows) to fill ``kind_min``.

    A row that survives is among the first max(n, kind_min) of its (group, kind, flag) cell, so the
    cells are cut first, before the shuffle; the exact rule then sees a bounded list per group.
    """
    cell = [*by, kind, *([flag] if flag else [])]
    cut = top_n(df, cell, order, max(n, kind_min))
    rn = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    rows = cut.withColumn("__rn", rn(*by)).withColumn("__rk", rn(*by, kind))
    keep = (F.col("__rn") <= n) | (F.col("__rk") <= kind_min)
    if flag:
        rows = rows.withColumn("__rf", rn(*by, flag))
        keep = keep | (F.col(flag) & (F.col("__rf") <= kind_min))
    return rows.filter(keep).drop("__rn", "__rk", "__rf")


def item_scores(watches: DataFrame, relevances: DataFrame, now: int, thr: int = 600, half_life: float = HALF_LIFE) -> DataFrame:
    """Sum of relevance x recency per (user, target), from watches of at least ``thr`` seconds.

    A user none of whose long watches leads anywhere is scored from all watches. Targets among the
    watches used are dropped. Both passes come from one join: long and total sums side by side. The
    window over a user sees one row per target, so its size is bounded by the catalogue.
    """
    long, decay = F.col("watch_len") >= thr, recency(F.col("last_watch"), now, half_life)
    per_title = watches.groupBy("dw_p_id", "content_id", "language").agg(
        F.sum(F.when(long, decay)).alias("__long"), F.sum(decay).alias("__any"))
    joined = dealt_by_target(watch_relevance(per_title, relevances))
    sums = joined.groupBy("dw_p_id", "dst", "dst_lang").agg(
        F.sum(F.col("relevance") * F.col("__long")).alias("long_score"), F.sum(F.col("relevance") * F.col("__any")).alias("any_score"))
    n_long = F.count("long_score").over(Window.partitionBy("dw_p_id"))
    scored = sums.withColumn("__pass", F.when(n_long > 0, "long").otherwise("any"))
    scored = scored.withColumn("score", F.when(F.col("__pass") == "long", F.col("long_score")).otherwise(F.col("any_score"))).filter("score is not null")
    used = watches.groupBy("dw_p_id", F.col("content_id").alias("dst")).agg(F.max(long).alias("__used_long"))
    left = scored.join(used, ["dw_p_id", "dst"], "left")
    hidden = F.when(F.col("__pass") == "long", F.col("__used_long")).otherwise(F.col("__used_long").isNotNull())
    return left.filter(~F.coalesce(hidden, F.lit(False))).select("dw_p_id", "dst", "dst_lang", "score")


def retrieve(watches: DataFrame, relevances: DataFrame, catalog: DataFrame, now: int, n: int = 200, kind_min: int = 50, thr: int = 600) -> DataFrame:
    """Item-to-item candidates: scores cut to n with quotas per kind and for the brand flag."""
    info = catalog.select(F.col("content_id").alias("dst"), (F.col("kind") == "show").alias("is_show"), F.col("is_brand"))
    rows = item_scores(watches, relevances, now, thr).join(info, "dst", "left")
    rows = rows.withColumns({"is_show": F.coalesce("is_show", F.lit(False)), "is_brand": F.coalesce("is_brand", F.lit(False))})
    return quota_topk(rows, ["dw_p_id"], [F.col("score").desc(), F.col("dst"), F.col("dst_lang")], n, kind_min, "is_show", "is_brand")


def used_watches(watches: DataFrame, relevances: DataFrame, thr: int = 600) -> DataFrame:
    """Watches of the pass that scored the user, as in ``item_scores``.

    Those of at least ``thr`` seconds; all of them for a user none of whose long watches leads anywhere.
    """
    sources = relevances.select(F.col("src").alias("content_id"), F.col("src_lang").alias("language"))
    long = watches.filter(F.col("watch_len") >= thr)
    by_long = long.select("dw_p_id", "content_id", "language").distinct().join(sources, ["content_id", "language"], "left_semi")
    rows = watches.join(by_long.select("dw_p_id", F.lit(True).alias("__long")).distinct(), "dw_p_id", "left")
    return rows.filter(F.col("__long").isNull() | (F.col("watch_len") >= thr)).drop("__long")


def evidence(used: DataFrame, relevances: DataFrame) -> DataFrame:
    """Which used watch led to which target: (user, src, src_lang, dst, dst_lang, relevance)."""
    pairs = used.select("dw_p_id", "content_id", "language").distinct()
    return watch_relevance(pairs, relevances).withColumnsRenamed({"content_id": "src", "language": "src_lang"})


def watch_weights(used: DataFrame, now: int, half_life: float = HALF_LIFE) -> DataFrame:
    """Recency weight of each title among the used watches, from its newest watch."""
    return used.groupBy("dw_p_id", F.col("content_id").alias("src"), F.col("language").alias("src_lang")).agg(
        recency(F.max("last_watch"), now, half_life).alias("weight"))


def language_gate(results: DataFrame, watches: DataFrame, min_len: int = 600) -> DataFrame:
    """Results in the user's languages first; others follow at min - 1 + 1 / (position).

    A language is valid from ``min_len`` watched seconds; without any, every result passes.
    """
    langs = watches.groupBy("dw_p_id", "language").agg(F.sum("watch_len").alias("s")).filter(F.col("s") >= min_len)
    valid = langs.select("dw_p_id", F.col("language").alias("dst_lang"), F.lit(True).alias("__ok"))
    any_valid = langs.select("dw_p_id").distinct().withColumn("__any", F.lit(True))
    rows = results.join(valid, ["dw_p_id", "dst_lang"], "left").join(any_valid, "dw_p_id", "left")
    passes = F.col("__ok").isNotNull() | F.col("__any").isNull()
    rows = rows.withColumn("__pass", passes).withColumn("__min", F.min("score").over(Window.partitionBy("dw_p_id")))
    pos = F.row_number().over(Window.partitionBy("dw_p_id", "__pass").orderBy(F.col("score").desc(), "dst", "dst_lang"))
    score = F.when(F.col("__pass"), F.col("score")).otherwise(F.col("__min") - 1 + F.lit(1.0) / pos)
    return rows.withColumn("score", score).select(*results.columns)


def filter_results(results: DataFrame, watches: DataFrame, catalog: DataFrame) -> DataFrame:
    """Best entry per (user, title), without watched titles, shows and type-200 movies only."""
    kinds = catalog.filter((F.col("kind") == "show") | (F.col("content_type_id") == 200)).select(F.col("content_id").alias("dst"))
    best = pick_one(results.select("dw_p_id", "dst", "score", F.expr("-dst_lang").alias("__l")), ["dw_p_id", "dst"], ["score", "__l"])
    seen = watches.select("dw_p_id", F.col("content_id").alias("dst"))
    return best.select("dw_p_id", "dst", "score").join(seen, ["dw_p_id", "dst"], "left_anti").join(kinds, "dst", "left_semi")


def finalize(results: DataFrame, catalog: DataFrame, n: int = 40, min_pay_ratio: float = 0.0) -> DataFrame:
    """First n results per user with their position.

    With a ratio, the best ceil(n * ratio) paid titles are sure of a place; the rest goes by score.
    """
    order = [F.col("score").desc(), F.col("dst")]
    rows = results
    if min_pay_ratio > 0:
        paid = catalog.select(F.col("content_id").alias("dst"), F.col("is_premium").alias("__paid"))
        rows = results.join(paid, "dst", "left").withColumn("__paid", F.coalesce("__paid", F.lit(False)))
        rows = top_n(rows, ["dw_p_id", "__paid"], order, n)
        rank = F.row_number().over(Window.partitionBy("dw_p_id", "__paid").orderBy(*order))
        forced = F.when(F.col("__paid") & (rank <= F.ceil(F.lit(n * min_pay_ratio))), 0).otherwise(1)
        rows = top_n(rows.withColumn("__forced", forced), ["dw_p_id"], [F.col("__forced"), *order], n)
    rows = top_n(rows.select(*results.columns), ["dw_p_id"], order, n, "position")
    return rows


def popular_by_language(pop: DataFrame, catalog: DataFrame, n: int = 40, kind_min: int = 20) -> DataFrame:
    """Popular titles per language with quotas: (language, content_id, position from 0)."""
    info = catalog.select("content_id", (F.col("kind") == "show").alias("is_show"), "is_brand")
    order = [F.col("popularity").desc(), F.col("content_id")]
    kept = quota_topk(pop.join(info, "content_id"), ["language"], order, n, kind_min, "is_show", "is_brand")
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("language").orderBy(*order)) - 1).select(
        "language", "content_id", "position")


def top_languages(watches: DataFrame, users: DataFrame | None = None, default: dict[int, float] | None = None, n: int = 2) -> DataFrame:
    """Up to n languages per user by watched seconds; defaults for users without any."""
    own = watches.filter(F.col("watch_len") > 0).groupBy("dw_p_id", "language").agg(F.sum("watch_len").cast("double").alias("weight"))
    if users is not None and default:
        rows = F.array(*[F.struct(F.lit(k).cast("int").alias("language"), F.lit(float(v)).alias("weight")) for k, v in default.items()])
        none = users.select("dw_p_id").distinct().join(own.select("dw_p_id"), "dw_p_id", "left_anti")
        own = own.withColumn("language", F.col("language").cast("int")).unionByName(none.select("dw_p_id", F.inline(rows)))
    return top_n(own, ["dw_p_id"], [F.col("weight").desc(), F.col("language")], n)


def _inline_lists(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """Rows with the entries of their language's list, as in a join on ``language``.

    The lists (titles, not users) are read as one map, a scalar subquery.
    """
    entries = F.struct(*[c for c in lists.columns if c != "language"])
    each = lists.groupBy(F.col("language").cast("int").alias("language")).agg(F.collect_list(entries).alias("entries"))
    by_language = each.agg(F.map_from_entries(F.collect_list(F.struct("language", "entries")))).scalar()
    found = rows.withColumn("__lists", by_language)
    return found.select(*rows.columns, F.inline(F.try_element_at("__lists", F.col("language").cast("int"))))


def popular_for_user(languages: DataFrame, popular: DataFrame, limit: int | None = None) -> DataFrame:
    """Popular lists of a user's languages merged by (position + 0.5) / weight.

    The whole merged list comes back unless ``limit`` is given.
    """
    rows = _inline_lists(languages, popular).withColumn("rank_score", (F.col("position") + 0.5) / F.col("weight"))
    rows = rows.select("dw_p_id", "language", "content_id", "rank_score")
    return rows if limit is None else top_n(rows, ["dw_p_id"], [F.col("rank_score"), F.col("language"), F.col("content_id")], limit)


def bursts(pop: DataFrame, now: int, popular: float = 0.7, rise: float = 0.2, back: int = 7) -> DataFrame:
    """(content_id, language, popularity) above ``popular`` yesterday and up by ``rise`` in ``back`` days."""
    end = now // 86400 - 1
    both = pop.filter(F.col("day").isin(end, end - back)).groupBy("content_id", "language").agg(
        F.max(F.when(F.col("day") == end, F.col("popularity"))).alias("popularity"),
        F.coalesce(F.max(F.when(F.col("day") == end - back, F.col("popularity"))), F.lit(0.0)).alias("earlier"))
    return both.filter((F.col("popularity") > popular) & (F.col("popularity") - F.col("earlier") > rise)).select("content_id", "language", "popularity")


def _strong_languages(users: DataFrame, watches: DataFrame, seconds: int = 3600) -> DataFrame:
    """Languages above ``seconds`` per user; a user without any gets the marker language."""
    own = watches.groupBy("dw_p_id", "language").agg(F.sum("watch_len").alias("seconds")).filter(F.col("seconds") > seconds)
    own = own.select("dw_p_id", F.col("language").cast("int").alias("language"), "seconds")
    none = users.select("dw_p_id").distinct().join(own.select("dw_p_id"), "dw_p_id", "left_anti")
    return own.unionByName(none.select("dw_p_id", F.lit(ANY_LANGUAGE).alias("language"), F.lit(0).cast("bigint").alias("seconds")))


def _dealt(key: str, tiles: Column) -> Column:
    """Which of ``tiles`` a row belongs to, by a hash of its key."""
    return F.pmod(F.xxhash64(key), tiles)


def _tiles(rows: DataFrame, most: int) -> Column:
    """How many tiles of about ``most`` rows a table makes, at least one."""
    return small_value(rows.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / most)).cast("long")))


def _by_user_language(users: DataFrame, watches: DataFrame, titles: DataFrame, defaults: DataFrame,
                      user_tile: int = USER_TILE, title_tile: int = TITLE_TILE) -> DataFrame:
    """Each title in the language the user watches most, or its default for users without languages.

    Users of one order of languages get one list, so they meet a tile of titles together: the languages are
    compared once for all of them, and what is left per (user, title) row is to write it. These rows, many
    more than users and titles, are never shuffled. Tiles only spread the work.
    """
    known = titles.select("content_id", F.col("language").cast("int").alias("language")).filter("language is not null").distinct()
    known = known.withColumn("pick", F.col("language")).unionByName(
        defaults.groupBy("content_id").agg(F.min(F.col("language").cast("int")).alias("pick")).withColumn("language", F.lit(ANY_LANGUAGE)))
    entries = known.groupBy("content_id").agg(F.collect_list(F.struct("language", "pick")).alias("all"))
    # seconds decide, then the smaller language; the marker has no seconds
    spoken = F.collect_list(F.struct("seconds", (-F.col("language")).alias("neg"), "language"))
    own = _strong_languages(users, watches).groupBy("dw_p_id").agg(F.sort_array(spoken, asc=False).alias("own"))

    parts, tiles = _tiles(own, user_tile), _tiles(entries, title_tile)
    groups = own.groupBy(F.col("own.language").alias("order"), _dealt("dw_p_id", parts).alias("__part")).agg(F.collect_list(F.struct("dw_p_id")).alias("users"))
    groups = groups.withColumn("__tile", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)))
    lists = entries.groupBy(_dealt("content_id", tiles).alias("__tile")).agg(
        F.collect_list(F.struct("content_id", F.col("all.language").alias("languages"), F.col("all.pick").alias("picks"))).alias("titles"))
    lists = lists.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    met = _meet(groups, lists, ["__part", "__tile"])

    def picked(t):
        first = F.get(F.array_intersect("order", t["languages"]), F.lit(0))
        return F.struct(t["content_id"], F.get(t["picks"], (F.array_position(t["languages"], first) - 1).cast("int")).alias("language"))

    reached = F.filter("titles", lambda t: F.arrays_overlap("order", t["languages"]))
    listed = met.select("users", F.transform(reached, picked).alias("list"))
    # all rows made of one row are held at once, so a few users at a time meet the list
    few = F.transform(F.sequence(F.lit(1), F.size("users"), F.lit(AT_ONCE)), lambda i: F.struct(F.slice("users", i, AT_ONCE).alias("users"), "list"))
    each = listed.select(F.explode(few).alias("met")).select(F.inline("met.users"), F.col("met.list").alias("list"))
    return each.select("dw_p_id", F.inline("list"))


def burst_for_user(users: DataFrame, watches: DataFrame, burst: DataFrame) -> DataFrame:
    """Burst titles in the user's strongest language; by popularity for users without one."""
    best = burst.groupBy("content_id").agg(F.max_by("language", F.struct("popularity", -F.col("language"))).alias("language"))
    return _by_user_language(users, watches, burst, best)


def new_for_user(users: DataFrame, watches: DataFrame, new_titles: DataFrame) -> DataFrame:
    """New titles in the user's strongest language; in their primary one for users without one."""
    langs = new_titles.select("content_id", F.explode("language_ids").alias("language"))
    return _by_user_language(users, watches, langs, new_titles.select("content_id", F.col("primary_language").alias("language")))


def sports_for_user(languages: DataFrame, sports: DataFrame, n: int = 20) -> DataFrame:
    """First n sports titles by (position + 0.5) / weight over the user's languages, movies listed first."""
    order = [F.when(F.col("kind") == "movie", 0).otherwise(1), F.col("content_id")]
    listed = top_n(sports.withColumnRenamed("language_id", "language"), ["language"], order, n, "pos")
    rows = _inline_lists(languages, listed.select("language", "content_id", "pos")).withColumn("rank_score", (F.col("pos") - 0.5) / F.col("weight"))
    return top_n(rows, ["dw_p_id"], [F.col("rank_score"), F.col("language"), F.col("content_id")], n).select("dw_p_id", "language", "content_id", "rank_score")


class TokenQuota(NamedTuple):
    """The cut that follows token scores: ``token_retrieve(scores, catalog, n, kind_min)`` on scores rounded to ``digits``."""

    catalog: DataFrame
    n: int = 200
    kind_min: int = 100
    digits: int | None = None


def _named_titles(token_rel: DataFrame) -> DataFrame:
    """One row per target: ``names`` it is reached by, sorted, and their relevances ``rels``, side by side."""
    each = token_rel.filter("name is not null").groupBy("name", "dst", "dst_lang").agg(F.sum("score").alias("rel"))
    titles = each.groupBy("dst", "dst_lang").agg(F.sort_array(F.collect_list(F.struct("name", "rel"))).alias("all"))
    return titles.select("dst", "dst_lang", F.col("all.name").alias("names"), F.col("all.rel").alias("rels"))


def _least_scores(reached: DataFrame, titles: DataFrame, most: int) -> DataFrame:
    """(user, is_show, least): a score that at least ``most`` unwatched targets of the cell reach.

    The relevance at the ranks 1, 2, 4, ... of a name's targets says how many have at least that much.
    Only targets of a single name and positive finite weights count, so that relevance orders the scores.
    """
    order = [F.col("rel").desc(), F.col("dst"), F.col("dst_lang")]
    single = titles.filter((F.size("names") == 1) & F.col("is_show").isNotNull()).select("names", "is_show", "dst", "dst_lang", F.get("rels", F.lit(0)).alias("rel"))
    ranked = top_n(single, ["names", "is_show"], order, 4 * most, "place")
    knots = ranked.filter(F.col("place").isin([1 << i for i in range((4 * most).bit_length())]) & F.col("rel").isNotNull())
    knots = knots.select("names", "is_show", "rel", F.greatest(F.lit(1), F.floor(F.col("place") / 2)).cast("long").alias("__more"))
    weight = F.get("weights", F.lit(0))
    rows = reached.filter((F.size("names") == 1) & (weight > 0) & (weight < float("inf"))).select("dw_p_id", "names", weight.alias("__w"), "__hidden")
    scored = rows.join(knots.hint("merge"), "names").select("dw_p_id", "is_show", "__hidden", (F.col("rel") * F.col("__w")).alias("__s"), "__more")
    upto = F.sum("__more").over(Window.partitionBy("dw_p_id", "is_show").orderBy(F.col("__s").desc()))
    enough = scored.withColumn("__upto", upto).filter(F.col("__upto") >= F.lit(most) + F.col("__hidden"))
    return enough.groupBy(F.col("dw_p_id").alias("__u"), F.col("is_show").alias("__show")).agg(F.max("__s").alias("__least"))


def token_scores(ns_watches: DataFrame, videos: DataFrame, tokens: DataFrame, token_rel: DataFrame, ent_watches: DataFrame,
                 now: int, last_n: int = 20, half_life: float = HALF_LIFE, quota: TokenQuota | None = None, digits: int | None = None) -> DataFrame:
    """Scores from a user's last sports and news watches through name tokens.

    Weight: type weight x recency, x 0.1 up to 600 s, x 0.1 for short clips (under 30 s and under half
    the running time) or live watches under 600 s. Titles in ``ent_watches`` are dropped.

    Weights are summed per user and list of names; the targets with that list meet them in the last join, so
    (user, target) rows are not shuffled. Targets of the same names and relevances score the same, so they
    travel as one list, scored (and rounded to ``digits``) once per user. No table passes through the driver:
    the joins are merge joins, since a file's size says little about its rows.

    With ``quota``, rows that its cut cannot keep are left out there: those below a score that enough of the
    user's targets reach, and those behind enough targets of the same list. ``__shows`` says, for each of the
    catalogue's rows of a title, whether it is a show; ``token_retrieve`` reads it.
    """
    last = top_n(ns_watches, ["dw_p_id"], [F.col("last_watch").desc(), F.col("content_id"), F.col("language"), F.col("watch_len")], last_n)
    rows = last.join(videos.select("content_id", "content_type_id", "duration").hint("merge"), "content_id")
    types = F.create_map(*[F.lit(x) for kv in NS_TYPE_WEIGHTS.items() for x in kv])
    length, duration = F.col("watch_len"), F.col("duration")
    half = (duration <= 0) | (length / F.when(duration > 0, duration) < 0.5)
    short = F.when(F.col("content_type_id") == 301, length < 600).otherwise((length < 30) & half)
    weight = (F.coalesce(F.try_element_at(types, F.col("content_type_id")), F.lit(0.0)) * recency(F.col("last_watch"), now, half_life)
              * F.when(length <= 600, 0.1).otherwise(1.0) * F.when(short, 0.1).otherwise(1.0))
    named = rows.withColumn("__w", weight).join(tokens.withColumnRenamed("weight", "token_weight").hint("merge"), ["content_id", "language"])
    named = named.groupBy("dw_p_id", "name").agg(F.sum(F.col("__w") * F.col("token_weight")).alias("__w"))

    titles = _named_titles(token_rel)
    by_name = titles.select("names").distinct().select(F.explode("names").alias("name"), "names")
    found = named.join(by_name.hint("merge"), "name").groupBy("dw_p_id", "names").agg(F.map_from_entries(F.collect_list(F.struct("name", "__w"))).alias("__of"))
    weights = F.transform("names", lambda n: F.try_element_at("__of", n))
    seen = ent_watches.select(F.col("dw_p_id").alias("__u"), F.col("content_id").alias("dst")).distinct().join(titles.select("dst", "names").hint("merge"), "dst")
    seen = seen.groupBy("__u", F.col("names").alias("__n")).agg(F.collect_set("dst").alias("__seen"), F.count(F.lit(1)).alias("__gone"))
    reached = found.join(seen.hint("merge"), (F.col("dw_p_id") == F.col("__u")) & (F.col("names") == F.col("__n")), "left")
    reached = reached.select("dw_p_id", "names", weights.alias("weights"), "__seen", F.coalesce("__gone", F.lit(0)).alias("__gone"))
    like = ["names", "rels"]
    if quota is not None:
        most = max(quota.n, quota.kind_min)
        show = F.coalesce(F.col("kind") == "show", F.lit(False))
        kinds = quota.catalog.groupBy(F.col("content_id").alias("dst")).agg(F.sort_array(F.collect_list(show)).alias("__shows"))
        titles = titles.join(kinds.hint("merge"), "dst", "left").withColumn("__shows", F.coalesce("__shows", F.array(F.lit(False))))
        # a title that the catalogue lists as both kinds has none here, and only its own like push it out
        titles = titles.withColumn("is_show", F.when(F.array_min("__shows") == F.array_max("__shows"), F.array_min("__shows")))
        like += ["__shows", "is_show"]
        reached = reached.withColumn("__hidden", F.sum("__gone").over(Window.partitionBy("dw_p_id")))
        least = _least_scores(reached, titles, most).groupBy("__u").agg(
            F.map_from_entries(F.collect_list(F.struct("__show", "__least"))).alias("__least"))
        reached = reached.join(least.hint("merge"), F.col("dw_p_id").eqNullSafe(F.col("__u")), "left").drop("__u")

    place = F.row_number().over(Window.partitionBy(*like).orderBy("dst", "dst_lang"))
    lists = titles.withColumn("__place", place).groupBy(*like, F.floor((F.col("__place") - 1) / LIST_TITLES).alias("__list")).agg(
        F.collect_list(F.struct("dst", "dst_lang", "__place")).alias("__titles"))
    # the users of a much read list of names are dealt to several parts
    lists = lists.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LIST_PARTS - 1).cast("long"))))
    met = _meet(reached.withColumn("__part", _dealt("dw_p_id", F.lit(LIST_PARTS))), lists, ["names", "__part"])

    first = F.get("rels", F.lit(0)) * F.get("weights", F.lit(0))
    terms = F.zip_with("rels", "weights", lambda r, w: r * w)
    whole = F.aggregate(terms, F.lit(None).cast("double"), lambda s, v: F.coalesce(s + v, s, v))
    score = F.when(F.size("names") == 1, first).otherwise(whole)
    scored = met.withColumn("score", score if digits is None else F.round(score, digits))
    out = ["dw_p_id", "dst", "dst_lang", "score"]
    hidden = F.coalesce(F.array_contains("__seen", F.col("dst")), F.lit(False))
    if quota is None:
        return scored.select("dw_p_id", "score", "__seen", F.inline("__titles")).filter(~hidden).select(*out)
    cut = (lambda c: c) if quota.digits is None else (lambda c: F.round(c, quota.digits))
    bound = F.try_element_at("__least", F.col("is_show"))
    ahead = F.lit(most) + F.col("__gone")
    scored = scored.filter((F.col("__list") * LIST_TITLES < ahead) & (bound.isNull() | (cut(F.col("score")) >= cut(bound))))
    each = scored.select("dw_p_id", "score", "__shows", "__seen", "__gone", F.inline("__titles"))
    return each.filter((F.col("__place") <= ahead) & ~hidden).select(*out, "__shows")


def token_retrieve(scores: DataFrame, catalog: DataFrame, n: int = 200, kind_min: int = 100) -> DataFrame:
    """Token scores cut to n per user, with at least ``kind_min`` shows and as many other titles.

    Scores made for a quota have met the catalogue as titles; others meet it here.
    """
    if "__shows" in scores.columns:
        rows = scores.withColumn("is_show", F.explode("__shows")).drop("__shows")
    else:
        info = catalog.select(F.col("content_id").alias("dst"), (F.col("kind") == "show").alias("is_show"))
        rows = scores.join(info.hint("merge"), "dst", "left").withColumn("is_show", F.coalesce("is_show", F.lit(False)))
    kept = quota_topk(rows, ["dw_p_id"], [F.col("score").desc(), F.col("dst"), F.col("dst_lang")], n, kind_min, "is_show")
    return kept.select(*[c for c in scores.columns if c != "__shows"])


def tagged_union(sources: dict[str, DataFrame], catalog: DataFrame) -> DataFrame:
    """Known titles of all sources with the sorted list of sources per (user, title)."""
    out = None
    for name, df in sources.items():
        part = df.select("dw_p_id", "content_id").withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part)
    known = out.join(catalog.select("content_id"), "content_id", "left_semi")
    return known.groupBy("dw_p_id", "content_id").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def top_sources(weights: DataFrame, limit: int = 20) -> DataFrame:
    """A user's heaviest watched titles with their position from 1."""
    return top_n(weights, ["dw_p_id"], [F.col("weight").desc(), F.col("src"), F.col("src_lang")], limit, "src_pos")


def source_evidence(sources: DataFrame, relevances: DataFrame) -> DataFrame:
    """Evidence of the chosen sources only, so the join does not expand a user's whole history."""
    return evidence(sources.select("dw_p_id", F.col("src").alias("content_id"), F.col("src_lang").alias("language")), relevances)


def diversify(results: DataFrame, evidences: DataFrame, weights: DataFrame, limit: int = 20) -> DataFrame:
    """Scores x capacity of the item's best source / (1 + earlier items of that source).

    Sources are a user's ``limit`` heaviest watches of the pass that scored the user. An item without evidence scores 0 and counts
    against the heaviest source.
    """
    sources = top_sources(weights, limit)
    known = evidences.join(sources, ["dw_p_id", "src", "src_lang"])
    best = known.groupBy("dw_p_id", "dst", "dst_lang").agg(
        F.max_by(F.struct("src_pos", "weight", "relevance"), F.struct("relevance", -F.col("src_pos"))).alias("b"))
    users = sources.select("dw_p_id").distinct()
    rows = results.join(users, "dw_p_id", "left_semi").join(best, ["dw_p_id", "dst", "dst_lang"], "left")
    hit = F.coalesce(F.col("b.relevance") > 0, F.lit(False))
    rows = rows.withColumn("__hit", hit).withColumn("__src", F.when(hit, F.col("b.src_pos")).otherwise(1))
    earlier = F.row_number().over(Window.partitionBy("dw_p_id", "__src").orderBy(F.col("score").desc(), "dst", "dst_lang"))
    score = F.when(F.col("__hit"), F.col("score") * F.col("b.weight") / earlier).otherwise(0.0)
    return rows.withColumn("score", score).select(*results.columns)


def impression_discount(results: DataFrame, counts: DataFrame, date: str, salt: str = "home", start: int = 2, most: int = 10) -> DataFrame:
    """Scores of often shown titles move toward a random point above the user's lowest score.

    ``counts``: (dw_p_id, dst, impressions). The pull grows from 0 above ``start`` to 1 at ``most``.
    """
    rows = results.join(counts, ["dw_p_id", "dst"], "left").withColumn("__min", F.min("score").over(Window.partitionBy("dw_p_id")))
    pull = F.least((F.col("impressions") - start) / F.lit(float(most - start)), F.lit(1.0))
    draw = hash_uniform(["dw_p_id", F.lit(date), "dst"], salt)
    moved = (F.col("score") - F.col("__min")) * (pull * draw + (F.lit(1.0) - pull)) + F.col("__min")
    return rows.withColumn("score", F.when(F.col("impressions") > start, moved).otherwise(F.col("score"))).select(*results.columns)


def jitter(results: DataFrame, date: str, lo: float = 0.5, hi: float = 1.0, salt: str = "home") -> DataFrame:
    """Positive scores times a draw from [lo, hi), fixed per (user, date, title)."""
    draw = hash_uniform(["dw_p_id", F.lit(date), "dst"], salt)
    return results.withColumn("score", F.when(F.col("score") > 0, F.col("score") * (draw * (hi - lo) + lo)).otherwise(F.col("score")))


def blend_lists(first: DataFrame, second: DataFrame, weight: float, decay: float = 0.8, whole_logs: bool = False, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Scores of the first list plus weight x decay ** i times the i-th entry of the second.

    Entries stand by score, best first, then by id. Retrieved lists are short and ordered in one window per
    user; ``whole_logs`` is for second lists of any length, whose order is cut into slices of a user's own
    range. Entries without a score come last and add nothing.
    """
    cols = ["dw_p_id", "dst", "score"]
    share = F.col("score") * F.lit(float(weight))
    if whole_logs:
        scored = places(second.filter(F.col("score").isNotNull()), ["dw_p_id"], "score", "dst", slice_rows)
        # n equal entries at places p, p + 1, ... add decay ** p + decay ** (p + 1) + ...
        run = F.col("n") if decay == 1 else (1 - F.pow(F.lit(float(decay)), "n")) / (1 - F.lit(float(decay)))
        added = scored.withColumn("score", share * F.pow(F.lit(float(decay)), "place") * run)
        added = added.select(*cols).unionByName(second.filter(F.col("score").isNull()).select(*cols))
    else:
        pos = F.row_number().over(Window.partitionBy("dw_p_id").orderBy(F.col("score").desc(), "dst")) - 1
        added = second.withColumn("score", share * F.pow(F.lit(float(decay)), pos))
    return first.select(*cols).unionByName(added.select(*cols)).groupBy("dw_p_id", "dst").agg(F.sum("score").alias("score"))


def premium_decay(results: DataFrame, watches: DataFrame, catalog: DataFrame, step: int = 4) -> DataFrame:
    """Premium titles halve for every ``step`` premium titles ranked above them, unless the user watches premium."""
    premium = catalog.filter("is_premium").select("content_id")
    payers = watches.join(premium, "content_id", "left_semi").select("dw_p_id").distinct().withColumn("__payer", F.lit(True))
    rows = results.join(premium.select(F.col("content_id").alias("dst"), F.lit(True).alias("__p")), "dst", "left").join(payers, "dw_p_id", "left")
    before = F.row_number().over(Window.partitionBy("dw_p_id", "__p").orderBy(F.col("score").desc(), "dst")) - 1
    decays = F.col("__p").isNotNull() & F.col("__payer").isNull()
    score = F.when(decays, F.col("score") * F.pow(F.lit(0.5), F.floor(before / step))).otherwise(F.col("score"))
    return rows.withColumn("score", score).select(*results.columns)


def export_unseen(pred: DataFrame, latest: DataFrame) -> DataFrame:
    """Predicted id lists without the ids a user watched lately; ``latest`` holds (dw_p_id, latest_ids)."""
    return pred.join(latest, "dw_p_id", "left").withColumn(
        "items", F.when(F.size("latest_ids") > 0, without_seen(F.col("items"), F.col("latest_ids"))).otherwise(F.col("items"))).drop("latest_ids")


def predict(watches: DataFrame, relevances: DataFrame, catalog: DataFrame, now: int, n: int = 40, min_pay_ratio: float = 0.0) -> DataFrame:
    """Candidates for all users end to end: retrieve, language gate, filter, final list."""
    found = retrieve(watches, relevances, catalog, now).select("dw_p_id", "dst", "dst_lang", "score")
    return finalize(filter_results(language_gate(found, watches), watches, catalog), catalog, n, min_pay_ratio)
