"""Hand-computed edge rules."""

import pytest
from pyspark.sql import functions as F

from ranklens.functions import scalars
from ranklens.operators import aggregates, curves, examples, filters, joins, metrics, retrieval


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


IMP = "dw_p_id string, full_tray_id string, content_id string, timestamp long"
TW = "dw_p_id string, tray_id string, content_id long, watch_time long"
HIST = "dw_p_id string, content_id long, watch_len long"


def test_watch_of_exactly_the_threshold_is_neither_class(spark):
    imp = spark.createDataFrame([("u", "t", str(i), 10 + i) for i in (1, 2, 3, 4)] + [("u", "dry", "9", 5)], IMP)
    tw = spark.createDataFrame([("u", "t", 1, 601), ("u", "t", 2, 600)], TW)
    hist = spark.createDataFrame([("u", 4, 50)], HIST)
    got = rows(examples.impression_examples(imp, tw, hist), "tray_id", "content_id", "label")
    assert got == [("t", 1, 1), ("t", 3, 0)]  # 2 in the gap, 4 in the history, tray "dry" unwatched


def test_ids_that_do_not_parse_are_ignored(spark):
    imp = spark.createDataFrame([("u", "t", c, 7) for c in ("x", "0", " 12 ", "12.0", "", None)], IMP)
    assert rows(examples.first_impressions(imp), "content_id") == [(12,)]


def test_inter_tray_negatives_need_a_positive(spark):
    schema = "dw_p_id string, tray_id string, content_id long, timestamp long, label long, watch_time long, is_inter_tray boolean"
    ex = spark.createDataFrame([("u", "a", 1, 1, 1, 700, False)] + [("u", "b", i, 1, 0, 0, False) for i in range(2, 9)] + [("v", "b", i, 1, 0, 0, False) for i in range(3)], schema)
    got = examples.inter_tray_negatives(ex)
    assert got.count() == 1 and got.first()["dw_p_id"] == "u" and got.first()["is_inter_tray"]


def test_cap_keeps_the_smallest_draws_whatever_the_slices(spark):
    schema = "dw_p_id string, tray_id string, content_id long, timestamp long, label long, watch_time long, is_inter_tray boolean"
    ex = spark.createDataFrame([("u", "a", 0, 1, 1, 700, False)] + [("u", "a", i, 1, 0, 0, False) for i in range(1, 301)], schema)
    got = {r["content_id"] for r in examples.cap_negatives(ex, 5).filter("label = 0").collect()}
    draws = examples._draw(ex.filter("label = 0"), "cap").collect()
    assert got == {r["content_id"] for r in sorted(draws, key=lambda r: r["__u"])[:5]}


def _mtl(spark, clicks, paywall=(), watchlist=(), daily=()):
    imp = spark.createDataFrame([("u", "home", "1", 100), ("u", "home", "1", 90), ("u", "side", "2", 100), ("u", "home", "3", 100)], IMP)
    cl = spark.createDataFrame(clicks, "dw_p_id string, content_id long, timestamp long, full_tray_id string")
    d = spark.createDataFrame(list(daily), "dw_p_id string, content_id long, watch_time long")
    p = spark.createDataFrame(list(paywall), "dw_p_id string, normalized_content_id string, timestamp long")
    w = spark.createDataFrame(list(watchlist), "dw_p_id string, action int, content_id long, timestamp long")
    ep = spark.createDataFrame([(77, 1)], "episode_id long, show_id long")
    reco = filters.is_reco_tray(F.col("full_tray_id"), [], ["home", "side"])
    return examples.mtl_positives(imp, cl, d, p, w, ep, reco), examples.mtl_negatives(imp, cl, d, reco)


def test_click_needs_an_impression_in_the_same_tray(spark):
    pos, neg = _mtl(spark, [("u", 2, 150, "home"), ("u", 1, 160, "home"), ("u", 1, 155, "home")])
    assert rows(pos, "content_id", "tray_id", "timestamp") == [(1, "home", 90)]
    assert rows(neg, "content_id") == [(3,)]  # 2 was clicked somewhere


def test_post_click_events_must_follow_the_click(spark):
    pos, _ = _mtl(spark, [("u", 1, 150, "home")], paywall=[("u", "77", 149), ("u", "77", 151)], watchlist=[("u", 1, 1, 150), ("u", 2, 1, 999)], daily=[("u", 1, 600)])
    assert rows(pos, "paywall_view", "add_watchlist", "watch", "watch_time") == [(1, 0, 0, 600)]


ASOF_L = "dw_p_id string, ts long, x int"
ASOF_R = "dw_p_id string, ets long, ev int"


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_asof_is_strict_and_independent_of_the_slice_width(spark, width):
    left = spark.createDataFrame([("u", 10, 1), ("u", 11, 2), ("u", 5, 3), ("u", 500, 4), ("v", 9, 5)], ASOF_L)
    right = spark.createDataFrame([("u", 10, 100), ("u", 5, 50), ("u", 10, 101), ("w", 1, 1)], ASOF_R)
    got = rows(joins.asof_strict(left, right, ["dw_p_id"], "ts", "ets", tie=["ev"], width=width), "x", "ets", "ev")
    assert got == [(1, 5, 50), (2, 10, 101), (4, 10, 101)]
    kept = joins.asof_strict(left, right, ["dw_p_id"], "ts", "ets", tie=["ev"], keep_unmatched=True, width=width)
    assert kept.filter("ev is null").count() == 2


def test_asof_random_against_brute_force(spark):
    import random

    rnd = random.Random(3)
    ls = [(f"u{rnd.randint(0, 2)}", rnd.randint(0, 400), i) for i in range(300)]
    rs = [(f"u{rnd.randint(0, 2)}", rnd.randint(0, 400), i) for i in range(120)]
    got = rows(joins.asof_strict(spark.createDataFrame(ls, ASOF_L), spark.createDataFrame(rs, ASOF_R), ["dw_p_id"], "ts", "ets", tie=["ev"], width=25), "x", "ev")
    want = []
    for u, t, x in ls:
        before = [(e, i) for v, e, i in rs if v == u and e < t]
        if before:
            want.append((x, max(before)[1]))
    assert got == sorted(want)


DIM = "version string, k int, v int"


def test_version_is_clamped_and_a_gap_is_an_error(spark):
    dim = spark.createDataFrame([("2", 1, 20), ("4", 1, 40)], DIM)
    df = lambda v: spark.createDataFrame([(v, 1)], "version string, k int")
    for asked, want in (("1", 20), ("2", 20), ("4", 40), ("9", 40)):
        assert joins.join_version(df(asked), dim, ["k"]).first()["v"] == want
    with pytest.raises(Exception, match="no matched version"):
        joins.join_version(df("3"), dim, ["k"]).collect()
    assert joins.join_version(df("3"), dim, ["k"], on_gap="null").first()["v"] is None
    assert joins.join_version(df("3"), spark.createDataFrame([], DIM), ["k"]).first()["v"] is None


def test_bins_at_and_beyond_edges(spark):
    df = spark.createDataFrame([(0, [0, 60, 120]), (60, [0, 60, 120]), (61, [0, 60, 120]), (999, [0, 60, 120]), (5, None)], "x int, e array<int>")
    assert [r[0] for r in df.select(joins.assign_bin(F.col("x"), F.col("e"))).collect()] == [0, 1, 2, 2, 0]


def test_step_value_wraps_below_the_first_threshold(spark):
    df = spark.createDataFrame([(59, [1.0, 2.0], [0.5, 0.9]), (60, [1.0, 2.0], [0.5, 0.9]), (600, [1.0, 2.0], [0.5, 0.9]), (5, None, None)], "s int, t array<double>, v array<double>")
    get = lambda wrap: [r[0] for r in df.select(scalars.step_value(F.col("s"), F.col("t"), F.col("v"), wrap)).collect()]
    assert get(True) == [0.9, 0.5, 0.9, 1.0] and get(False) == [0.5, 0.5, 0.9, 1.0]


def test_past_watch_sentinels(spark):
    w = spark.createDataFrame([("u", i) for i in (1, 2, 3, 4)], "dw_p_id string, content_id long")
    latest = spark.createDataFrame([("u", 2), ("u", 3)], "dw_p_id string, content_id long")
    hist = spark.createDataFrame([("u", 3, 30), ("u", 3, 12), ("u", 4, 0)], HIST)
    assert rows(joins.past_watch(w, latest, hist), "content_id", "past_wt") == [(1, 0), (2, -1), (3, 42), (4, -1)]
    assert rows(joins.is_new_watch(w, latest, hist), "content_id") == [(1,)]


SC = "dw_p_id string, timestamp long, content_id long, s double, label long"


def test_ndcg_rules(spark):
    def one(labels, scores):
        df = spark.createDataFrame([("u", 1, i, float(s), y) for i, (y, s) in enumerate(zip(labels, scores))], SC)
        return [tuple(r)[2:] for r in metrics.request_ndcg(df, ["dw_p_id", "timestamp"], "s", "label").collect()]

    assert one([1, 0, 1, 0], [4, 3, 2, 1]) == []  # four rows
    assert one([1] * 5, [5, 4, 3, 2, 1]) == [(0.0, 0.0, 0.0)]  # one label value
    tied = one([1, 0, 0, 0, 0], [1] * 5)[0]
    assert tied[0] == pytest.approx(0.2)  # mean gain over ties
    assert one([1, 0, 0, 0, 0], [5, 4, 3, 2, 1])[0] == pytest.approx((1, 1, 1))


def test_ranks_that_straddle_k(spark):
    df = spark.createDataFrame([("u", 1, i, s, 0) for i, s in enumerate([3.0, 2.0, 2.0, 1.0])], SC)
    by = ["dw_p_id", "timestamp"]
    assert rows(metrics.avg_rank(df, by, "s"), "content_id", "rank") == [(0, 1.0), (1, 2.5), (2, 2.5), (3, 4.0)]
    assert rows(metrics.at_k(df, by, "s", 2), "content_id") == [(0,)]
    assert rows(metrics.at_k(df, by, "s", 3), "content_id") == [(0,), (1,), (2,)]
    assert metrics.at_k(df, by, "s", 2, "eq").count() == 0


def test_metrics_on_nothing(spark):
    none = spark.createDataFrame([], SC)
    assert metrics.log_loss(none, "label", "s").first()[0] == 0.0
    one_class = spark.createDataFrame([("u", 1, 1, 0.5, 1)], SC)
    assert metrics.pooled_auc(one_class, "s", "label").first()["auc"] is None


def test_curve_with_few_users(spark):
    curve = spark.createDataFrame([(1, 0, 3000, 10), (1, 1, 900, 9), (1, 2, 4000, 40)], "content_id long, day long, watch long, users long")
    kinds = spark.createDataFrame([("movie", 0, 200.0), ("movie", 1, 50.0), ("movie", 2, 10.0)], "kind string, day long, per_user double")
    cat = spark.createDataFrame([(1, 200)], "content_id long, content_type_id int")
    got = [r["per_user"] for r in curves.smooth_curve(curve, kinds, cat).orderBy("day").collect()]
    day0 = 10 / 30 * 300 + 20 / 30 * 200
    assert got == pytest.approx([day0, day0 * 50 / 200, 100.0])


def test_curve_where_the_kind_curve_is_zero(spark):
    curve = spark.createDataFrame([(1, 0, 0, 0), (1, 1, 5, 1)], "content_id long, day long, watch long, users long")
    kinds = spark.createDataFrame([("movie", 0, 0.0), ("movie", 1, 0.0)], "kind string, day long, per_user double")
    cat = spark.createDataFrame([(1, 300)], "content_id long, content_type_id int")
    assert [r["per_user"] for r in curves.smooth_curve(curve, kinds, cat).collect()] == [0.0, 0.0]


def test_exposure_counts_complete_days_only(spark):
    day = 86400
    watches = spark.createDataFrame([("a", 1, 700, 10 * day, 10 * day), ("b", 1, 700, 9 * day, 9 * day), ("c", 1, 700, 0, 0), ("c", 1, 50, 0, 9 * day)],
                                    "dw_p_id string, content_id long, watch_time long, first_watch_ts long, last_watch_ts long")
    hist = watches.groupBy("dw_p_id", "content_id").agg(F.min("first_watch_ts").alias("first_watch"))
    matrix = curves.discovery_matrix(watches, hist, 10 * day, 3)
    # "a" was first watched today: no complete day; the late watch of "c" is beyond the range
    assert rows(matrix, "dw_p_id", "complete", "day", "wt") == [("b", 1, 0, 700), ("c", 4, 0, 700)]
    assert rows(curves.title_curve(matrix, 3), "day", "watch", "users") == [(0, 1400, 2), (1, 0, 1), (2, 0, 1), (3, 0, 1)]


def test_greedy_bins(spark):
    hist = spark.createDataFrame([(1, m, n) for m, n in ((1, 3), (2, 5), (3, 1), (9, 20))] + [(2, 4, 1)], "k long, minute long, n long")
    got = {r["k"]: r["edges"] for r in aggregates.freq_bins(hist, "k", 4, 3).collect()}
    assert got == {1: [0, 60, 540], 2: [0, 240]}  # total 29, 3 bins of 9: minute 1 closes early


def test_zero_sum_profile_is_empty(spark):
    w = spark.createDataFrame([("u", 1, 0.0), ("v", 1, 2.0)], "dw_p_id string, content_id long, weight double")
    cat = spark.createDataFrame([(1, 5, [])], "content_id long, studio_id int, genre_ids array<int>")
    assert rows(aggregates.profile(w, cat, ["dw_p_id"]), "dw_p_id", "attr", "value", "share") == [("v", "studio_id", "5", 1.0)]


W = "dw_p_id string, content_id long, language int, watch_len long, last_watch long"
REL = "src long, src_lang int, dst long, dst_lang int, score double"


def test_short_watches_count_only_when_long_ones_lead_nowhere(spark):
    watches = spark.createDataFrame([("u", 1, 0, 700, 0), ("u", 2, 0, 10, 0), ("v", 2, 0, 10, 0), ("v", 3, 0, 5, 0)], W)
    rel = spark.createDataFrame([(1, 0, 8, 0, 0.5), (2, 0, 8, 0, 0.25), (2, 0, 3, 0, 0.9), (1, 0, 2, 0, 0.1)], REL)
    got = rows(retrieval.item_scores(watches, rel, 0), "dw_p_id", "dst", "score")
    assert got == [("u", 2, 0.1), ("u", 8, 0.5), ("v", 8, 0.25)]  # v's target 3 is a watch of the pass


def test_titles_by_language_are_listed_without_a_shuffle_of_users_times_titles(spark):
    watches = spark.createDataFrame([("u", 9, 0, 5000, 0), ("u", 9, 3, 7000, 0), ("u", 9, 5, 10, 0), ("t", 9, 1, 4000, 0), ("t", 9, 3, 4000, 0),
                                     (None, 9, 0, 5000, 0), ("n", 9, None, 9000, 0)], W)
    users = spark.createDataFrame([("u",), ("t",), ("v",), (None,), ("v",), ("n",)], "dw_p_id string")
    new = spark.createDataFrame([(1, [0, 3, None], 1), (1, [3], 0), (2, [1, 3], 1), (3, [4], 4), (None, [0], None)], "content_id long, language_ids array<int>, primary_language int")
    out = retrieval.new_for_user(users, watches, new)
    got = sorted((tuple(r) for r in out.collect()), key=str)
    plain = [(1, 0), (2, 1), (3, 4), (None, None)]  # primary languages, the smallest of a repeated title
    want = [("u", 1, 3), ("u", 2, 3), ("u", None, 0), ("t", 1, 3), ("t", 2, 1), (None, 1, 0), (None, 2, 1), (None, 3, 4), (None, None, 0)]
    want += [("v", *p) for p in plain]
    assert got == sorted(want, key=str)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate inline" in plan and "Aggregate" not in plan[: plan.index("Generate inline")]


def test_users_of_one_order_of_languages_choose_once_for_all(spark):
    watches = spark.createDataFrame([(f"u{i}", 9, i % 4, 4000 + i % 3, 0) for i in range(60)] + [(f"u{i}", 9, i % 3, 4001, 0) for i in range(30)], W)
    users = spark.createDataFrame([(f"u{i}",) for i in range(70)], "dw_p_id string")
    new = spark.createDataFrame([(i, [i % 3, 3 + i % 2], i % 5) for i in range(40)], "content_id long, language_ids array<int>, primary_language int")
    whole = retrieval.new_for_user(users, watches, new)
    langs = new.select("content_id", F.explode("language_ids").alias("language"))
    primary = new.select("content_id", F.col("primary_language").alias("language"))
    tiled = retrieval._by_user_language(users, watches, langs, primary, user_tile=3, title_tile=2)
    seconds = {}
    for u, _, lang, n, _ in watches.collect():
        seconds[u, lang] = seconds.get((u, lang), 0) + n
    own = {}
    for (u, lang), n in seconds.items():
        own.setdefault(u, []).append((-n, lang))
    want = [(f"u{i}", i_, p) for i in range(60, 70) for i_, _, p in new.collect()]
    for u, order in own.items():
        for c, spoken, _ in new.collect():
            want += [(u, c, min(o for o in order if o[1] in spoken)[1])] if any(o[1] in spoken for o in order) else []
    assert sorted(map(tuple, whole.collect())) == sorted(want) == sorted(map(tuple, tiled.collect()))
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan[: plan.index("Generate inline")]  # nothing is decided per (user, title) row


def _token_tables(spark):
    """Users, tokens and targets with repeats, nulls, several names a target, negative weights and equal scores."""
    import random

    rnd = random.Random(5)
    names = [f"n{i}" for i in range(6)]
    ns = [(rnd.choice(["u", "v", "x", None]), rnd.randint(0, 9), 0, rnd.choice([10, 700, 5000]), rnd.randint(0, 5000)) for _ in range(60)]
    videos = [(i, rnd.choice([100, 300, 301, 402]), 50) for i in range(10)]
    tokens = [(i, 0, rnd.choice([*names, None]), rnd.choice([1e-6, 0.2, 1.0, -0.5, None])) for i in range(10) for _ in range(2)]
    rel = [(names[i % 4], i, i % 2, rnd.choice([0.1, 0.2, 0.3, 0.5, None])) for i in range(300)]
    rel += [(rnd.choice(names), i, i % 2, 0.25) for i in range(0, 300, 3)] + [(None, 7, 0, 9.0), ("n5", None, 0, 0.4)]
    seen = [(u, d, 0, 5, 0) for u in ("u", "v", None) for d in range(0, 300, 7)]
    catalog = [(i, rnd.choice(["show", "movie"])) for i in range(250)] + [(i, "show") for i in range(0, 250, 11)]
    return (spark.createDataFrame(ns, W), spark.createDataFrame(videos, "content_id long, content_type_id int, duration long"),
            spark.createDataFrame(tokens, "content_id long, language int, name string, weight double"),
            spark.createDataFrame(rel, "name string, dst long, dst_lang int, score double"), spark.createDataFrame(seen, W),
            spark.createDataFrame(catalog, "content_id long, kind string"))


def test_token_scores_against_one_join_and_sum(spark):
    ns, videos, tokens, rel, seen, catalog = _token_tables(spark)
    got = retrieval.token_scores(ns, videos, tokens, rel, seen, 5000).withColumn("score", F.round("score", 9))
    one = tokens.select("content_id", "language", F.lit("only").alias("name"), F.lit(1.0).alias("weight")).distinct()
    each = videos.select(F.lit("only").alias("name"), F.lit(0).alias("dst"), F.lit(0).alias("dst_lang"), F.lit(1.0).alias("score")).distinct()
    weights = []
    for c in range(10):  # one title's weight per user, through one token
        own = retrieval.token_scores(ns, videos, one.filter(F.col("content_id") == c), each, seen.filter("false"), 5000)
        weights += [(r["dw_p_id"], c, r["score"]) for r in own.collect()]
    by = spark.createDataFrame(weights, "dw_p_id string, content_id long, w double")
    want = by.join(tokens, "content_id").join(rel, "name").groupBy("dw_p_id", "dst", "dst_lang").agg(F.sum(F.col("w") * F.col("weight") * F.col("score")).alias("score"))
    want = want.join(seen.select("dw_p_id", F.col("content_id").alias("dst")), ["dw_p_id", "dst"], "left_anti").withColumn("score", F.round("score", 9))
    pick = lambda df: sorted((tuple(r) for r in df.select("dw_p_id", "dst", "dst_lang", "score").collect()), key=str)
    assert len(pick(got)) > 500 and pick(got) == pick(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]  # rows of (user, target) are not grouped after the last join


@pytest.mark.parametrize("n, kind_min, digits", [(3, 2, 6), (3, 5, None), (40, 10, 2), (200, 100, 6)])
def test_token_quota_leaves_out_only_rows_that_the_cut_drops(spark, n, kind_min, digits):
    ns, videos, tokens, rel, seen, catalog = _token_tables(spark)
    cut = lambda df: df if digits is None else df.withColumn("score", F.round("score", digits))
    pick = lambda df: sorted((tuple(r) for r in retrieval.token_retrieve(cut(df), catalog, n, kind_min).collect()), key=str)
    every = retrieval.token_scores(ns, videos, tokens, rel, seen, 5000)
    some = retrieval.token_scores(ns, videos, tokens, rel, seen, 5000, quota=retrieval.TokenQuota(catalog, n, kind_min, digits))
    assert pick(some) == pick(every)
    assert n > 3 or some.count() < every.count() / 2


def test_token_scores_leave_every_table_out_of_the_driver(spark):
    ns, videos, tokens, rel, seen, catalog = _token_tables(spark)
    quota = retrieval.TokenQuota(catalog, 10, 8, 6)
    plain = retrieval.token_scores(ns, videos, tokens, rel, seen, 5000, digits=6)
    for df in (plain, retrieval.token_retrieve(plain, catalog, 10, 8),
               retrieval.token_retrieve(retrieval.token_scores(ns, videos, tokens, rel, seen, 5000, quota=quota), catalog, 10, 8)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_titles_of_the_same_names_and_relevances_are_scored_as_one_list(spark):
    ns, videos, tokens, rel, seen, catalog = _token_tables(spark)
    plain = retrieval.token_scores(ns, videos, tokens, rel, seen, 5000, digits=3)
    plan = plain._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan[: plan.index("Generate inline")] and "round(" in plan
    whole = retrieval.token_scores(ns, videos, tokens, rel, seen, 5000).withColumn("score", F.round("score", 3))
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)


def test_relevances_are_summed_where_their_targets_are_dealt(spark):
    watches = spark.createDataFrame([("u", 1, 0, 700, 0)] * 3 + [(None, 1, 0, 700, 0), ("v", 2, 0, 700, 0)], W)
    rel = spark.createDataFrame([(1, 0, 8, 0, 0.5), (1, 0, None, None, 0.25), (3, 0, 8, 0, 1.0)], REL)
    out = joins.dealt_by_target(joins.watch_relevance(watches, rel), 7).groupBy("dw_p_id", "dst", "dst_lang").agg(F.sum("relevance").alias("score"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("u", 8, 0, 1.5), ("u", None, None, 0.75), (None, 8, 0, 0.5), (None, None, None, 0.25)], key=str)
    plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
    dealt = next(i for i, line in enumerate(plan) if "REPARTITION_BY_NUM" in line)
    join = next(i for i, line in enumerate(plan) if "Join" in line)
    assert dealt < join and not any("Exchange" in line for line in plan[:dealt]) and not any("HashAggregate" in line for line in plan[dealt:join])
    plan = retrieval.item_scores(watches, rel, 0)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_a_daily_job_broadcasts_no_log(spark):
    schema = "dw_p_id string, tray_id string, content_id long, timestamp long, label long, watch_time long, is_inter_tray boolean"
    ex = spark.createDataFrame([("u", "a", 1, 1, 1, 700, False), ("u", "b", 2, 1, 0, 0, False)], schema)
    hist = spark.createDataFrame([("u", 4, 50)], HIST)
    cat = spark.createDataFrame([(1, 0), (2, 0)], "content_id long, start_dt long")
    for df in (examples.sampled_examples(ex), examples.require_both_classes(ex, ["dw_p_id"]),
               joins.asof_strict(ex.select("dw_p_id", "timestamp"), ex.select("dw_p_id", F.col("timestamp").alias("at")), ["dw_p_id"], "timestamp", "at")):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    plan = examples.random_negatives(ex, cat, hist, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 3


def test_language_gate(spark):
    res = spark.createDataFrame([("u", 1, 0, 5.0), ("u", 2, 1, 9.0), ("u", 3, 1, 2.0), ("v", 1, 7, 1.0)], "dw_p_id string, dst long, dst_lang int, score double")
    watches = spark.createDataFrame([("u", 9, 0, 600, 0), ("v", 9, 0, 599, 0)], W)
    assert rows(retrieval.language_gate(res, watches), "dw_p_id", "dst", "score") == [("u", 1, 5.0), ("u", 2, 2.0), ("u", 3, 1.5), ("v", 1, 1.0)]


def test_quota_against_the_loop(spark):
    import random

    rnd = random.Random(11)
    data = [(f"g{g}", i, rnd.random() < 0.2, rnd.random() < 0.1, float(rnd.randint(0, 50))) for g in range(20) for i in range(60)]
    df = spark.createDataFrame(data, "g string, i int, show boolean, brand boolean, s double")
    got = {(r["g"], r["i"]) for r in retrieval.quota_topk(df, ["g"], [F.col("s").desc(), F.col("i")], 10, 4, "show", "brand").collect()}
    want = set()
    for g in {d[0] for d in data}:
        count, kept = {"s": 0, "m": 0, "b": 0}, 0
        for _, i, show, brand, s in sorted((d for d in data if d[0] == g), key=lambda d: (-d[4], d[1])):
            kind = "s" if show else "m"
            if kept < 10 or count[kind] < 4 or (brand and count["b"] < 4):
                want.add((g, i))
                kept += 1
                count[kind] += 1
                count["b"] += brand
    assert got == want


def test_diversify_item_without_evidence_uses_the_heaviest_source(spark):
    res = spark.createDataFrame([("u", i, 0, float(10 - i)) for i in range(4)], "dw_p_id string, dst long, dst_lang int, score double")
    ev = spark.createDataFrame([("u", 100, 0, 0, 0, 0.5), ("u", 100, 0, 2, 0, 0.5), ("u", 200, 0, 3, 0, 0.4)], "dw_p_id string, src long, src_lang int, dst long, dst_lang int, relevance double")
    wt = spark.createDataFrame([("u", 100, 0, 0.8), ("u", 200, 0, 0.5)], "dw_p_id string, src long, src_lang int, weight double")
    got = rows(retrieval.diversify(res, ev, wt), "dst", "score")
    assert got == [(0, pytest.approx(8.0)), (1, 0.0), (2, pytest.approx(8 * 0.8 / 3)), (3, pytest.approx(3.5))]


def test_geo_default_and_suffix(spark):
    df = spark.createDataFrame([("KA", None), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(scalars.geo_key(F.col("b"), F.col("a"))).collect()] == ["ka", "mh"]
    assert [scalars.variant_suffix(v) for v in ("x", "-x", "", None)] == ["-x", "-x", "", None]


def test_nest_is_one_list_per_day_in_time_order(spark):
    df = spark.createDataFrame([("u", (i * 37) % 100 * 2000) for i in range(100)] + [("v", 1)], "dw_p_id string, timestamp long")
    n = aggregates.nest(df, "dw_p_id", ["timestamp"], "xs")
    assert n.filter("dw_p_id = 'v'").count() == 1
    lists = [[e.timestamp for e in r.xs] for r in n.filter("dw_p_id = 'u'").orderBy("day").collect()]
    assert [len(x) for x in lists] == [44, 43, 13] and sum(lists, []) == [i * 2000 for i in range(100)]


def test_blocked_titles_with_capitals(spark):
    upper = next(b for b in filters.BLOCKED_TITLES if b != b.lower())
    df = spark.createDataFrame([("1", "movie", "10", upper, "0"), ("2", "movie", "10", "fine", "0")], "show_content_id string, sub_type string, clip_status string, title string, trailer_flag string")
    assert [r[0] for r in filters.clean_titles(df).select("show_content_id").collect()] == ["1", "2"]
    assert [r[0] for r in filters.clean_titles(df, ignore_case=True).select("show_content_id").collect()] == ["2"]


def test_feature_rows_gap_can_fail(spark):
    df = spark.createDataFrame([("2024-01-05",)], "version string")
    dim = spark.createDataFrame([("2024-01-01", 1), ("2024-01-09", 1)], "version string, content_id int")
    with pytest.raises(Exception, match="no matched version"):
        joins.resolve_version(df, dim).collect()
    assert joins.resolve_version(df, dim, on_gap="null").first()["resolved"] is None
