"""Hot users, equal rows, singular arms and sets of viewers kept per day."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ranklens.operators import aggregates, bandit, keyed, popularity, retrieval


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("slice_rows", [1, 7, 10_000])
def test_places_equal_one_window_with_ties_and_repeats(spark, slice_rows):
    df = spark.range(400).select(
        F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 5 == 1, None).otherwise((F.col("id") % 7).cast("string")).alias("u"),
        F.when(F.col("id") % 3 == 0, 1.5).otherwise((F.col("id") % 11) / 2.0).alias("score"), (F.col("id") % 90).alias("dst"))
    order = Window.partitionBy("u").orderBy(F.col("score").desc(), "dst")
    want = df.withColumn("place", F.row_number().over(order) - 1).groupBy("u", "score", "dst").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place"))
    assert _rows(keyed.places(df, ["u"], "score", "dst", slice_rows)) == _rows(want)


@pytest.mark.parametrize("decay", [0.8, 1.0])
def test_whole_logs_blend_like_short_lists(spark, decay):
    half = spark.range(300).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise((F.col("id") % 9).cast("string")).alias("dw_p_id"), (F.col("id") % 60).alias("dst"),
        F.when(F.col("id") % 50 == 3, None).when(F.col("id") < 100, 2.0).otherwise(F.col("id") / 7.0).alias("score"))
    first = half.filter("dst < 5")
    run = lambda **how: {(r[0], r[1]): r[2] for r in retrieval.blend_lists(first, half, 0.5, decay, **how).collect()}
    got, want = run(whole_logs=True, slice_rows=10), run()
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == (None if want[k] is None else pytest.approx(want[k], rel=1e-9))


def test_a_hot_users_log_is_ordered_in_bounded_parts(spark):
    """No window of the plan gets more of the user's rows than a slice may hold."""
    n = 20_000
    rows = spark.range(n).select(F.lit("hot").alias("u"), (F.col("id") % 5000 / 3.0).alias("score"), F.col("id").alias("dst"))
    x = F.col("dst").cast("double")
    placed = keyed.places(rows, ["u"], "score", "dst", 100)
    assert placed.agg(F.max("place")).first()[0] == n - 1 and placed.select("place").distinct().count() == n
    bounds = keyed._slice(x, F.lit(0.0), F.lit(float(n - 1)))
    assert rows.groupBy(bounds.alias("s")).count().agg(F.max("count")).first()[0] <= 100


def _act(spark, rows):
    return spark.createDataFrame(rows, "id long, content_id long, h array<double>, click int")


def test_rows_are_dealt_alike_in_any_order(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(i % 3 > 0), [float(x) for x in rng.normal(size=4)], int(i % 2)) for i in range(200)]
    a, b = _act(spark, rows), _act(spark, rows[::-1]).repartition(7)
    deal = lambda df: {r[0]: r[1] for r in df.select("id", F.pmod(bandit._draw(df, None), F.lit(16))).collect()}
    assert deal(a) == deal(b) and len(set(deal(a).values())) > 8
    cells = lambda df: {r[:3]: r[3] for r in _rows(bandit.gram_by_arm(df).select("arm", "i", "j", "a"))}
    one, two = cells(a), cells(b)
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], abs=1e-9) for k in one)
    solved = bandit.solve_state(bandit.gram_by_arm(a), "arm")
    scores = [{r["id"]: (r["mean"], r["sd"]) for r in bandit.score_by_arm(df, solved, rows_per_part=9).collect()} for df in (a, b)]
    assert len(scores[0]) == 200 and scores[0].keys() == scores[1].keys()
    assert all(scores[0][k] == pytest.approx(scores[1][k], abs=1e-9) for k in scores[0])


def test_equal_rows_are_each_scored_and_may_be_told_apart(spark):
    act = _act(spark, [(i, 1, [1.0, 0.0], 1) for i in range(50)]).select("content_id", "h", "click", "id")
    same = act.drop("id")
    solved = bandit.solve_state(bandit.gram_by_arm(same), "arm")
    assert bandit.score_by_arm(same, solved, rows_per_part=5).count() == 50
    parts = lambda row: act.select(F.pmod(bandit._draw(act if row else same, row), F.lit(8))).distinct().count()
    assert parts(None) == 1 and parts("id") > 1
    assert _rows(bandit.gram_by_arm(act, row="id")) == _rows(bandit.gram_by_arm(same))


def test_one_singular_arm_leaves_the_others(spark):
    good = [(i, 1, [float(i % 3 == k) + 0.1 * (i % 2) for k in range(3)], i % 2) for i in range(12)]
    act = _act(spark, good + [(99, 2, [1.0, 2.0, 3.0], 1), (98, 2, [2.0, 4.0, 6.0], 0)])
    solved = {r["arm"]: r for r in bandit.solve_state(bandit.gram_by_arm(act, lam=0.0), "arm").collect()}
    assert solved[2]["singular"] and solved[2]["theta"] is None and solved[2]["a_inv"] is None
    assert not solved[1]["singular"]
    m = np.array([r[2] for r in good])
    m /= np.linalg.norm(m, axis=1, keepdims=True) + bandit.EPS
    a, b = m.T @ m, m.T @ np.array([r[3] for r in good], dtype=float)
    np.testing.assert_allclose(solved[1]["theta"], np.linalg.solve(a, b), rtol=1e-8)
    np.testing.assert_allclose(np.array(solved[1]["a_inv"]).reshape(3, 3), np.linalg.inv(a), rtol=1e-8)
    state = bandit.solve_state(bandit.gram_by_arm(act, lam=0.0), "arm")
    scores = {r["id"]: r for r in bandit.score_by_arm(act, state, lam=4.0).collect()}
    assert scores[99]["mean"] == 0 and scores[99]["sd"] == pytest.approx(0.5, abs=1e-6)


def test_cells_of_an_arm_travel_together(spark):
    rnd = np.random.default_rng(3)
    act = spark.createDataFrame([(i, [float(v) for v in rnd.normal(size=3)], i % 2, a) for i, a in enumerate([1, 1, 1, 1, 2, None] * 3)],
                                "id long, h array<double>, click int, content_id long")
    state = bandit.gram_by_arm(act)
    key = lambda df: sorted(((r["arm"], [round(v, 9) for v in [*r["a_inv"], *r["theta"]]], r["singular"]) for r in df.collect()), key=str)
    whole, half = bandit.solve_state(state, "arm"), bandit.solve_state(state, "arm", symmetric=True)
    assert key(half) == key(whole) and len(key(half)) == 3
    holed = state.filter("i <> 0 or j <> 1")  # only one of the two cells: it counts half
    assert key(bandit.solve_state(holed, "arm")) != key(whole)
    plan = half._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" in plan and not [p for p in plan.splitlines() if "Exchange" in p and "i#" in p.split("hashpartitioning(")[-1].split(")")[0]]


def test_a_state_that_is_not_finite_is_singular(spark):
    state = spark.createDataFrame([(0, 0, float("nan")), (0, -1, 1.0)], "i int, j int, a double")
    assert bandit.solve_state(state).first()["singular"]


DAYS = ["1997-01-01", "1997-01-02", "1997-01-05"]


def _log(spark):
    rows = []
    for i in range(900):
        rows.append((f"t{i % 4}", None if i % 77 == 0 else f"u{i % 350}", DAYS[i % 3], "sports" if i % 13 == 0 else "ent", i % 5 - 1))
    df = spark.createDataFrame(rows, "sub_title_id string, dw_p_id string, cd string, category string, watch_minutes int")
    return df.withColumn("cd", F.to_date("cd"))


def test_days_added_one_at_a_time_give_the_weeks_viewers(spark, monkeypatch):
    log, avail = _log(spark).filter("dw_p_id is not null"), spark.createDataFrame([("t0",), ("t1",), ("t2",)], "show_content_id string")
    for few in (0, 256):
        monkeypatch.setattr(popularity, "FEW", few)
        numbers, days = None, None
        for cd in DAYS:
            day = log.filter(F.col("cd") == F.lit(cd).cast("date"))
            new = popularity.number_users(day, numbers)
            numbers = new if numbers is None else numbers.unionByName(new)
            numbers = spark.createDataFrame(numbers.collect(), "dw_p_id string, number long")
            sets = popularity.day_viewers(day, numbers)
            days = sets if days is None else days.unionByName(sets)
        ids = sorted(r["number"] for r in numbers.collect())
        assert ids == list(range(1, len(ids) + 1))
        for end in (DAYS[1], DAYS[2]):
            want = _rows(popularity.weekly_viewers(log, avail, DAYS[0], end))
            assert _rows(popularity.viewers_of_days(days, avail, DAYS[0], end)) == want


def test_viewers_over_several_buckets(spark):
    log = spark.range(40_000).select(F.lit("t").alias("sub_title_id"), F.col("id").cast("string").alias("dw_p_id"), F.lit("1997-01-01").cast("date").alias("cd"),
                                     F.lit("ent").alias("category"), F.lit(1).alias("watch_minutes"))
    numbers = popularity.number_users(log)
    days = popularity.day_viewers(log, numbers)
    assert days.count() == 2 and days.filter("bits is null").count() == 0
    avail = spark.createDataFrame([("t",)], "show_content_id string")
    assert _rows(popularity.viewers_of_days(days, avail, "1997-01-01", "1997-01-01")) == [("t", 40_000, 0), (None, 40_000, 1)]


def test_sketches_merge_within_their_error(spark):
    df = spark.range(60_000).select((F.col("id") % 5).alias("day"), (F.col("id") % 20_011).alias("user"), F.lit(1).alias("t"))
    days = aggregates.item_sketches(df, ["day", "t"], "user")
    about = aggregates.sketched_items(aggregates.merge_sketches(days, ["t"])).first()["items"]
    assert abs(about - 20_011) <= 20_011 * 4 * 1.04 / 2 ** (aggregates.SKETCH_BITS / 2)
    coarse = aggregates.sketched_items(aggregates.merge_sketches(aggregates.item_sketches(df, ["day"], "user", bits=8), [])).first()["items"]
    assert abs(coarse - 20_011) <= 20_011 * 4 * 1.04 / 2**4
