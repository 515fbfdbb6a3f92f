"""Numeric operators against NumPy and pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ranklens.operators import aggregates, bandit, keyed, metrics
from ranklens.streaming import incremental
from ranklens.streaming.incremental import fold_batch, stored_state

D = 6


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    n = 400
    return pd.DataFrame({"id": range(n), "content_id": np.where(rng.random(n) < 0.4, 1, rng.integers(2, 8, n)), "h": list(rng.normal(size=(n, D))),
                         "click": rng.choice([-1, 0, 1], n)})


@pytest.fixture(scope="module")
def act(spark, data):
    return spark.createDataFrame(data.assign(h=data["h"].map(list)), "id long, content_id long, h array<double>, click int").repartition(5).persist()


def state(df):
    h = np.stack(df["h"])
    h = h / (np.linalg.norm(h, axis=1, keepdims=True) + 1e-8)
    y = df["click"].to_numpy(float)
    keep = y != -1
    return h, h[keep].T @ h[keep] + np.eye(D), h[keep].T @ y[keep]


def dense(rows):
    a, b = np.zeros((D, D)), np.zeros(D)
    for r in rows:
        if r["j"] < 0:
            b[r["i"]] = r["a"]
        else:
            a[r["i"], r["j"]] = r["a"]
    return a, b


def test_gram_under_any_partitioning(act, data):
    _, a, b = state(data)
    for df in (act, act.coalesce(1), act.repartition(13)):
        got = dense(bandit.gram(df, D).collect())
        assert np.allclose(got[0], a) and np.allclose(got[1], b)


def test_gram_by_arm_splits_a_hot_arm(act, data):
    rows = bandit.gram_by_arm(act, parts=5).collect()
    for arm, df in data.groupby("content_id"):
        _, a, b = state(df)
        got = dense([r for r in rows if r["arm"] == arm])
        assert np.allclose(got[0], a) and np.allclose(got[1], b)


def test_no_rows_that_count_give_lambda(act):
    for none in (act.withColumn("click", F.lit(-1)), act.filter("false")):
        a, b = dense(bandit.gram(none, D, lam=3.0).collect())
        assert np.allclose(a, 3 * np.eye(D)) and not b.any()


def test_empty_first_increment_keeps_lambda(spark, act, data, tmp_path):
    path = f"file://{tmp_path}/state"
    incremental.next_state(spark, path, act.filter("false"), "0", None, D)
    incremental.next_state(spark, path, act, "1", "0", D)
    a, b = dense(incremental.stored_state(spark, path, "1").collect())
    assert np.allclose(a, state(data)[1]) and np.allclose(b, state(data)[2])


def test_null_arm_is_cold_or_trained(act, data):
    null3 = act.withColumn("content_id", F.when(F.col("content_id") != 3, F.col("content_id")))
    h3 = data[data["content_id"] == 3]
    for trained in (False, True):
        base = null3 if trained else act.filter("content_id <> 3")
        got = bandit.score_by_arm(null3, bandit.solve_state(bandit.gram_by_arm(base), "arm")).toPandas().set_index("id")
        assert len(got) == len(data) and got.loc[h3["id"], "content_id"].isna().all()
        assert (got.loc[h3["id"], "mean"] != 0).all() == trained


def test_hot_arm_of_equal_vectors_is_split(spark):
    df = spark.range(200).selectExpr("7 AS content_id", "array(1.0D, 0.0D) AS h", "1 AS click")
    rows = bandit.gram_by_arm(df, parts=8).collect()
    assert {(r["i"], r["j"]): round(r["a"], 4) for r in rows} == {(0, 0): 201.0, (0, 1): 0.0, (1, 0): 0.0, (1, 1): 1.0, (0, -1): 200.0, (1, -1): 0.0}


def test_smallest_eigenvalue(act, data):
    got = bandit.solve_state(bandit.gram(act, D)).first()["min_eigenvalue"]
    assert np.isclose(got, np.linalg.eigvalsh(state(data)[1]).min())


def test_constant_scores_standardise_to_zero(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 4.0), ("b", 5.0, 7.0)], "g string, x double, y double")
    assert [(r.x, round(r.y, 4)) for r in aggregates.zscore(df, ["x", "y"], ["g"]).orderBy("g", "y").collect()] == [(0.0, -0.7071), (0.0, 0.7071), (0.0, 0.0)]
    one = aggregates.zscore(df.withColumn("x", F.lit(3.0)), ["x"])
    assert {r.x for r in one.collect()} == {0.0}
    assert all(r.z == pytest.approx(13 / 3) for r in aggregates.rescale(one, "x", "y", "z").collect())


def test_null_scores_keep_their_rows(spark):
    df = spark.createDataFrame([(1, 5.0), (1, None), (1, 5.0), (1, 2.0)], "g int, s double")
    got = sorted((r.s or 0, r["rank"] or 0) for r in metrics.avg_rank(df, ["g"], "s").collect())
    assert got == [(0, 0), (2.0, 3.0), (5.0, 1.5), (5.0, 1.5)]
    assert sorted(r.s for r in metrics.at_k(df, ["g"], "s", 3).collect()) == [2.0, 5.0, 5.0]


def test_scores(act, data):
    h, a, b = state(data)
    inv = np.linalg.inv(a)
    got = bandit.score_shared(act, bandit.solve_state(bandit.gram(act, D))).toPandas().sort_values("id")
    assert np.allclose(got["mean"], h @ (inv @ b)) and np.allclose(got["sd"], np.sqrt(np.diag(h @ inv @ h.T)))


def test_scores_by_arm_and_cold_arm(act, data):
    solved = bandit.solve_state(bandit.gram_by_arm(act.filter("content_id <> 3")), "arm")
    got = bandit.score_by_arm(act, solved, lam=2.0, rows_per_part=30).toPandas().set_index("id")
    assert len(got) == len(data)
    for arm, df in data.groupby("content_id"):
        h, a, b = state(df)
        inv = np.linalg.inv(a)
        mean, var = (h @ (inv @ b), np.einsum("ij,jk,ik->i", h, inv, h)) if arm != 3 else (np.zeros(len(df)), (h * h).sum(1) / 2)
        assert np.allclose(got.loc[df["id"], "mean"], mean) and np.allclose(got.loc[df["id"], "sd"], np.sqrt(var))


def test_combine_days_written_out(spark):
    rng = np.random.default_rng(1)
    days = [rng.normal(size=(2, 2)) for _ in range(4)]
    df = spark.createDataFrame([(f"d{t}", i, j, float(x[i, j])) for t, x in enumerate(days) for i in range(2) for j in range(2)], "day string, i int, j int, a double")
    g, eye = 0.9, np.eye(2)
    want = {"reset": lambda t: days[t] + eye, "cumulative": lambda t: eye + sum(days[: t + 1]),
            "penalised": lambda t: g**t * (eye + days[0]) + sum((g ** (t - s)) * days[s] for s in range(1, t + 1))}
    for strategy, f in want.items():
        rows = bandit.combine_days(df, strategy, g).collect()
        for t in range(4):
            got = np.zeros((2, 2))
            for r in rows:
                if r["day"] == f"d{t}":
                    got[r["i"], r["j"]] = r["a"]
            assert np.allclose(got, f(t)), (strategy, t)


def test_merge_arms_counts_lambda_once(act, data):
    one, two = act.filter("content_id < 4"), act.filter("content_id >= 3")
    merged = bandit.merge_arms(bandit.gram_by_arm(one).unionByName(bandit.gram_by_arm(two)), 1.0, lam_inside=1.0)
    assert {r["arm"] for r in merged.select("arm").distinct().collect()} == set(data["content_id"])
    df = data[data["content_id"] == 5]
    got = dense(merged.filter("arm = 5").collect())
    assert np.allclose(got[0], state(df)[1])


def test_check_state_finds_asymmetry(spark):
    good = [(0, 0, 2.0), (0, 1, 0.5), (1, 0, 0.5), (1, 1, 2.0), (0, -1, 1.0), (1, -1, 1.0)]
    ok = bandit.check_state(spark.createDataFrame(good, "i int, j int, a double")).first()
    assert tuple(ok) == (2, True, True, True)
    bad = [(i, j, 0.6 if (i, j) == (0, 1) else a) for i, j, a in good]
    assert not bandit.check_state(spark.createDataFrame(bad, "i int, j int, a double")).first()["symmetric"]


def test_stream_batches_fold_into_versions(spark, act, data, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "state")
    act.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(act.schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = stream.writeStream.foreachBatch(fold_batch(out, D)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    a, b = dense(stored_state(spark, out).collect())
    want = state(data)
    assert np.allclose(a, want[1]) and np.allclose(b, want[2])


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(9)
    n = 3000
    pdf = pd.DataFrame({"id": range(n), "g": np.where(rng.random(n) < 0.4, 0, rng.integers(1, 40, n)), "s": np.round(rng.random(n), 2), "label": rng.integers(0, 2, n), "x": rng.gamma(2.0, size=n)})
    return pdf, spark.createDataFrame(pdf).persist()


def test_average_rank_like_pandas(scored):
    pdf, df = scored
    got = metrics.avg_rank(df, ["g"], "s").toPandas().set_index("id").sort_index()["rank"]
    assert (got.to_numpy() == pdf.groupby("g")["s"].rank(ascending=False).to_numpy()).all()


def test_auc_by_pairs(scored):
    pdf, df = scored
    pos, neg = pdf.loc[pdf.label == 1, "s"].to_numpy(), pdf.loc[pdf.label == 0, "s"].to_numpy()
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert metrics.pooled_auc(df, "s", "label").first()["auc"] == pytest.approx(want)


def test_quantiles_like_numpy(scored):
    pdf, df = scored
    got = aggregates.quantiles(df, ["g"], "x", [0.0, 0.25, 0.5, 0.9, 1.0]).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert np.allclose(got.loc[g], np.quantile(part["x"], [0.0, 0.25, 0.5, 0.9, 1.0]))


def test_user_metrics_long_tie_runs(spark):
    rows = [("u", float(i % 2), i % 3 == 0) for i in range(25)] + [("v", float(i), i == 0) for i in range(5)]
    df = spark.createDataFrame([(u, s, int(y)) for u, s, y in rows], "dw_p_id string, s double, label int")
    runs = spark.createDataFrame([(2, 23), (0, 0), (5, 4), (5, 5)], "ahead long, n long")
    for piece in (4, 10_000):
        got = runs.select("ahead", "n", metrics._discounts_between(F.col("ahead"), F.col("n"), piece).alias("d")).collect()
        assert [r.d for r in got] == pytest.approx([sum(1 / np.log2(i + 1) for i in range(r.ahead + 1, r.ahead + r.n + 1)) for r in got])
    assert metrics.user_metrics(df, "s", "label").first()["num_users"] == 2


def test_bandit_evaluation_like_pandas(spark, data):
    from ranklens.plans import evaluate

    rng = np.random.default_rng(2)
    pdf = data.assign(h=data["h"].map(list), base=rng.random(len(data)), request=data["id"] // 8, day=data["id"] % 2)
    df = spark.createDataFrame(pdf)
    tags = spark.createDataFrame([(1, "High"), (2, "Low")], "content_id long, popularity_tag string")
    scored = evaluate.score_requests(df.filter("day = 0"), df, D)
    table = evaluate.experiment(evaluate.compare({("d", "s"): scored}, tags), ["request"]).toPandas()

    h, _, _ = state(pdf)
    _, a, b = state(pdf[pdf.day == 0])
    inv = np.linalg.inv(a)
    want = pdf.assign(mean=h @ (inv @ b), sd=np.sqrt(np.einsum("ij,jk,ik->i", h, inv, h)))
    want = want[want.click != -1]
    for c in ("base", "sd", "mean"):
        want[c] = (want[c] - want[c].mean()) / want[c].std()
    want["score"] = want["base"] + want["sd"]
    want["rank"] = want.groupby("request")["score"].rank(ascending=False)
    rows = table[(table.blend == "base_explore") & table.category.isna()]
    got = {(r.metric, r.k): r.value for r in rows.itertuples()}
    for k in (1, 3, 5):
        top = want[want["rank"] <= k]
        assert got["catalog", k] == top["content_id"].nunique()
        p = want[want["rank"] == k]["content_id"].value_counts(normalize=True)
        assert got["perplexity", k] == pytest.approx(2 ** -(p * np.log2(p)).sum())
    assert got["score_std", 0] == pytest.approx(want["score"].std())

    def ndcg(g, k=3):
        if len(g) < 5:
            return None
        if g["click"].nunique() == 1:
            return 0.0
        d = 1 / np.log2(np.arange(2, k + 2))
        return (g.sort_values("score", ascending=False)["click"].to_numpy()[:k] * d).sum() / (np.sort(g["click"])[::-1][:k] * d).sum()

    per = [v for v in (ndcg(g) for _, g in want.groupby("request")) if v is not None]
    assert got["ndcg", 3] == pytest.approx(np.mean(per))


def test_prefix_sums_do_not_depend_on_slices(spark):
    rng = np.random.default_rng(5)
    data = sorted({(g, float(x)) for g, x in zip(rng.choice(["a", "b", None], 400, p=[0.8, 0.15, 0.05]), rng.normal(size=400))}, key=str)
    df = spark.createDataFrame([(g, x, i % 7) for i, (g, x) in enumerate(data)], "g string, x double, n long")
    want = {}
    for g in ("a", "b", None):
        own = sorted((x, n) for h, x, n in map(tuple, df.collect()) if h == g)
        for k, (x, _) in enumerate(own):
            want[g, x] = (sum(n for _, n in own[:k]), sum(n for _, n in own[k + 1 :]), sum(n for _, n in own))
    for width in (1, 5, 10_000):
        up = {(r.g, r.x): (r.s, r.s_total) for r in keyed.prefix_sums(df, ["g"], "x", {"s": F.col("n")}, slice_rows=width).collect()}
        down = {(r.g, r.x): r.s for r in keyed.prefix_sums(df, ["g"], "x", {"s": F.col("n")}, True, width).collect()}
        assert {k: (up[k][0], down[k], up[k][1]) for k in up} == want
    total = sum(n for _, _, n in map(tuple, df.collect()))
    once = keyed.prefix_sums(df.dropDuplicates(["x"]), [], "x", {"s": F.col("n")}, slice_rows=3).orderBy("x").collect()
    assert [r.s for r in once] == list(np.cumsum([0, *(r.n for r in once[:-1])])) and once[0].s_total == total
