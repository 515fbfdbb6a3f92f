"""Queries for bandit statistics over the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ranklens.operators import bandit, metrics
from ranklens.plans import evaluate
from ranklens.plans.q_metrics import auc_sql, ndcg_sql
from ranklens.plans.registry import query
from ranklens.session import scratch_path
from ranklens.sources.logs import stage, unmark
from ranklens.sources.versions import versions
from ranklens.streaming.incremental import next_state, stored_state

D = 64

def r5(df):
    return df.select("vec_id", "content_id", (F.round("mean", 5) + 0.0).alias("mean"), F.round("sd", 5).alias("sd"))


_CELLS = """
    vecs AS (SELECT *, list_transform(h, lambda x: x / (sqrt(list_sum(list_transform(h, lambda y: y * y))) + 1e-8)) AS u FROM acts),
    cells AS (SELECT vec_id, content_id, day, click, generate_subscripts(u, 1) - 1 AS i, unnest(u) AS x FROM vecs WHERE click <> -1)"""


def _gram_sql(keys: str, lam: str) -> str:
    k = f"{keys}, " if keys else ""
    g = ", ".join(f"a.{x.strip()}" for x in keys.split(",")) + ", " if keys else ""
    h = ", ".join(x.strip() for x in keys.split(",")) + ", " if keys else ""
    return f"""SELECT {g}CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, sum(a.x * b.x) + CASE WHEN a.i = b.i THEN {lam} ELSE 0 END AS a FROM cells a JOIN cells b USING (vec_id) GROUP BY {g}a.i, b.i
        UNION ALL SELECT {h}CAST(i AS INTEGER), -1, sum(x * click) FROM cells GROUP BY {h}i"""


def _solved_sql(state: str, key: str = "") -> str:
    """WITH parts that end in ``solved`` (key, theta, inv): Gauss-Jordan over lists, one pivot per step."""
    k = f"{key}, " if key else ""
    g = f" GROUP BY {key}" if key else ""
    return f"""st AS ({state}),
    lines AS (SELECT {k}i, list(a ORDER BY j) FILTER (j >= 0) AS r, max(a) FILTER (j < 0) AS b FROM st GROUP BY {k}i),
    gj AS (SELECT {k}1 AS k, list(list_concat(r, [b], list_transform(range(0, {D}), lambda c: CASE WHEN c = i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) ORDER BY i) AS m FROM lines{g}
           UNION ALL
           SELECT {k}k + 1, list_transform(m, lambda row, r: CASE WHEN r = k THEN pn ELSE list_transform(list_zip(row, pn), lambda z: z[1] - row[k] * z[2]) END)
           FROM (SELECT *, list_transform(m[k], lambda x: x / piv) AS pn FROM (SELECT *, m[k][k] AS piv FROM gj WHERE k <= {D}))),
    solved AS (SELECT {k}list_transform(m, lambda row: row[{D} + 1]) AS theta, list_transform(m, lambda row: row[{D} + 2:2 * {D} + 1]) AS inv FROM gj WHERE k = {D} + 1)"""


_MEAN = "list_dot_product(u, theta)"
_SD = "sqrt(greatest(list_dot_product(u, list_transform(inv, lambda r: list_dot_product(r, u))), {}))"
_SHARED = _gram_sql("", "1")


@query("b1_empty", f"SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CASE WHEN i = j THEN 2.0::DOUBLE ELSE 0.0 END AS a FROM (SELECT unnest(range(0, {D})) AS i), (SELECT unnest(range(-1, {D})) AS j) WHERE EXISTS (SELECT 1 FROM acts)")
def _(t):
    """All rows masked: the state is lambda I."""
    return bandit.gram(t.acts.withColumn("click", F.lit(-1)), D, lam=2.0)


@query("b2_empty_first_day", f"WITH {_CELLS} SELECT i, j, round(a, 6) + 0.0 AS a FROM ({_SHARED})")
def _(t):
    """The first stored day has no rows; lambda is kept for the later ones."""
    path = scratch_path(t.spark, "state-empty")
    next_state(t.spark, path, t.acts.filter("false"), "0", None, D)
    next_state(t.spark, path, t.acts, "1", "0", D)
    return stored_state(t.spark, path, "1").withColumn("a", F.round("a", 6) + 0.0)


@query("b1_gram", f"WITH {_CELLS} SELECT i, j, round(a, 6) + 0.0 AS a FROM ({_gram_sql('', '1')})")
def _(t):
    return bandit.gram(t.acts, D).withColumn("a", F.round("a", 6) + 0.0)


@query("b2_update_state", f"WITH {_CELLS} SELECT i, j, round(a, 6) + 0.0 AS a FROM ({_gram_sql('', '1')})")
def _(t):
    state = bandit.gram(t.acts.filter("day < 2"), D)
    for day in (2, 3):
        state = bandit.update_state(state, bandit.gram(t.acts.filter(F.col("day") == day), D, lam=0.0))
    return state.withColumn("a", F.round("a", 6) + 0.0)


@query("b2_stored_state", f"WITH {_CELLS} SELECT i, j, round(a, 6) + 0.0 AS a FROM ({_gram_sql('', '1')})")
def _(t):
    """The same through stored versions, one per day."""
    path = scratch_path(t.spark, "state")
    for day in range(4):
        next_state(t.spark, path, t.acts.filter(F.col("day") == day), str(day), None if day == 0 else str(day - 1), D)
    return stored_state(t.spark, path).withColumn("a", F.round("a", 6) + 0.0)


@query("b2_committed_state", f"WITH {_CELLS} SELECT i, j, round(a, 6) + 0.0 AS a FROM ({_gram_sql('', '1')})")
def _(t):
    """A newer version that was not written to its end is passed over, then written again on the last good one."""
    path = scratch_path(t.spark, "state-commit")
    act = lambda day: t.acts.filter(F.col("day") == day)
    for day in range(3):
        next_state(t.spark, path, act(day), str(day), None if day == 0 else str(day - 1), D)
    next_state(t.spark, path, t.acts, "3", "2", D)
    unmark(t.spark, f"{path}/version=3")
    last = versions(t.spark, path)[-1]
    next_state(t.spark, path, act(3), "3", last, D)
    return stored_state(t.spark, path).withColumn("a", F.round("a", 6) + 0.0)


@query("b2_stored_state_by_arm", f"WITH {_CELLS} SELECT content_id AS arm, i, j, round(a, 6) + 0.0 AS a FROM ({_gram_sql('content_id', '1')})")
def _(t):
    path = scratch_path(t.spark, "state-arms")
    for day in range(4):
        next_state(t.spark, path, t.acts.filter(F.col("day") == day), str(day), None if day == 0 else str(day - 1), D, arm="content_id")
    return stored_state(t.spark, path).select("arm", "i", "j", (F.round("a", 6) + 0.0).alias("a"))


@query("b3_gram_by_arm", f"WITH {_CELLS} SELECT content_id AS arm, i, j, round(a, 6) + 0.0 AS a FROM ({_gram_sql('content_id', '1')})")
def _(t):
    return bandit.gram_by_arm(t.acts).withColumn("a", F.round("a", 6) + 0.0)


@query("b4_solve_state", f"WITH RECURSIVE {_CELLS}, {_solved_sql(_SHARED)} SELECT {D} AS d, CAST(generate_subscripts(theta, 1) - 1 AS INTEGER) AS i, round(unnest(theta), 5) + 0.0 AS theta FROM solved")
def _(t):
    solved = bandit.solve_state(bandit.gram(t.acts, D))
    return solved.select("d", F.posexplode("theta").alias("i", "theta")).withColumn("theta", F.round("theta", 5) + 0.0)


@query("b4_singular_arms", f"SELECT content_id AS arm, count(DISTINCT h) FILTER (click <> -1) < {D} AS singular, count(DISTINCT h) FILTER (click <> -1) >= {D} AS solved FROM acts GROUP BY ALL HAVING count(*) FILTER (click <> -1) > 0")
def _(t):
    """Without a regulariser, arms with fewer different vectors than dimensions have no state; the others are solved."""
    solved = bandit.solve_state(bandit.gram_by_arm(t.acts, lam=0.0), "arm")
    return solved.select("arm", "singular", F.col("theta").isNotNull().alias("solved"))


@query("b6_singular_arms", f"WITH {_CELLS} SELECT vec_id, 0.0::DOUBLE AS mean, round(sqrt(greatest(list_sum(list_transform(u, lambda y: y * y)) / 2, 1e-8)), 6) AS sd FROM vecs")
def _(t):
    """Arms of one row each, without a regulariser, are all singular and scored as cold."""
    one = t.acts.withColumn("content_id", F.col("vec_id"))
    out = bandit.score_by_arm(one, bandit.solve_state(bandit.gram_by_arm(one, lam=0.0), "arm", symmetric=True), lam=2.0)
    return out.select("vec_id", "mean", F.round("sd", 6).alias("sd"))


_BY_ARM = f"SELECT content_id AS arm, i, j, a FROM ({_gram_sql('content_id', '1')})"


@query("b4_solve_by_arm", f"WITH RECURSIVE {_CELLS}, {_solved_sql(_BY_ARM, 'arm')} SELECT arm, {D} AS d, CAST(generate_subscripts(theta, 1) - 1 AS INTEGER) AS i, round(unnest(theta), 5) + 0.0 AS theta FROM solved")
def _(t):
    solved = bandit.solve_state(bandit.gram_by_arm(t.acts), "arm")
    return solved.select("arm", "d", F.posexplode("theta").alias("i", "theta")).withColumn("theta", F.round("theta", 5) + 0.0)


@query("b4_solve_residual", f"WITH {_CELLS} SELECT CAST(i AS INTEGER) AS i, round(sum(x * click), 5) + 0.0 AS b FROM cells GROUP BY i")
def _(t):
    """A times theta gives b back."""
    state = bandit.gram(t.acts, D)
    theta = bandit.solve_state(state).select(F.posexplode("theta").alias("j", "theta"))
    return state.join(theta, "j").groupBy("i").agg((F.round(F.sum(F.col("a") * F.col("theta")), 5) + 0.0).alias("b"))


@query("b5_score_shared", f"WITH RECURSIVE {_CELLS}, {_solved_sql(_SHARED)} SELECT vec_id, content_id, round({_MEAN}, 5) + 0.0 AS mean, round({_SD.format('0.0::DOUBLE')}, 5) AS sd FROM vecs, solved")
def _(t):
    return r5(bandit.score_shared(t.acts, bandit.solve_state(bandit.gram(t.acts, D)), rows_per_part=100))


@query("b5_score_identity", f"WITH {_CELLS}, n AS (SELECT vec_id, list_sum(list_transform(u, lambda y: y * y)) AS q FROM vecs) SELECT vec_id, 0.0::DOUBLE AS mean, round(sqrt(q / 4), 6) AS sd FROM n")
def _(t):
    """Scores against a state without data: mean 0, deviation |h| / sqrt(lambda)."""
    none = t.acts.withColumn("click", F.lit(0)).withColumn("h", F.transform("h", lambda x: x * 0))
    scored = bandit.score_shared(t.acts, bandit.solve_state(bandit.gram(none, D, lam=4.0)))
    return scored.select("vec_id", (F.round("mean", 6) + 0.0).alias("mean"), F.round("sd", 6).alias("sd"))


_COLD = "sqrt(greatest(list_dot_product(u, u), 1e-8))"
_BUT_3 = f"SELECT arm, i, j, a FROM ({_BY_ARM}) WHERE arm <> 3"


@query("b6_score_by_arm", f"""WITH RECURSIVE {_CELLS}, {_solved_sql(_BUT_3, 'arm')}
    SELECT vec_id, content_id, CASE WHEN theta IS NULL THEN 0.0 ELSE round({_MEAN}, 5) + 0.0 END AS mean, round(CASE WHEN theta IS NULL THEN {_COLD} ELSE {_SD.format('1e-8')} END, 5) AS sd FROM vecs LEFT JOIN solved ON arm = content_id""")
def _(t):
    """Arm 3 was not trained."""
    solved = bandit.solve_state(bandit.gram_by_arm(t.acts.filter("content_id <> 3")), "arm")
    return r5(bandit.score_by_arm(t.acts, solved, rows_per_part=16))


@query("b6_null_arm", f"""WITH RECURSIVE {_CELLS}, {_solved_sql(_BUT_3, 'arm')}
    SELECT vec_id, nullif(content_id, 3) AS content_id, CASE WHEN theta IS NULL THEN 0.0 ELSE round({_MEAN}, 5) + 0.0 END AS mean, round(CASE WHEN theta IS NULL THEN {_COLD} ELSE {_SD.format('1e-8')} END, 5) AS sd FROM vecs LEFT JOIN solved ON arm = content_id""")
def _(t):
    """Rows without an arm are scored as a cold arm."""
    solved = bandit.solve_state(bandit.gram_by_arm(t.acts.filter("content_id <> 3")), "arm")
    null3 = t.acts.withColumn("content_id", F.when(F.col("content_id") != 3, F.col("content_id")))
    return r5(bandit.score_by_arm(null3, solved, rows_per_part=16))


@query("b3_null_arm", f"WITH {_CELLS} SELECT nullif(content_id, 3) AS arm, i, j, round(a, 6) + 0.0 AS a FROM ({_gram_sql('content_id', '1')})")
def _(t):
    """Rows without an arm are summed as an arm of their own."""
    null3 = t.acts.withColumn("content_id", F.when(F.col("content_id") != 3, F.col("content_id")))
    return bandit.gram_by_arm(null3).withColumn("a", F.round("a", 6) + 0.0)


@query("b6_cold_start", f"WITH {_CELLS} SELECT vec_id, 0.0::DOUBLE AS mean, round(sqrt(greatest(list_sum(list_transform(u, lambda y: y * y)) / 2, 1e-8)), 6) AS sd FROM vecs")
def _(t):
    """No arm of the scored rows was trained."""
    solved = bandit.solve_state(bandit.gram_by_arm(t.acts.withColumn("content_id", F.col("content_id") + 1000)), "arm")
    out = bandit.score_by_arm(t.acts, solved, lam=2.0)
    return out.select("vec_id", "mean", F.round("sd", 6).alias("sd"))


_DAILY = f"daily_c AS (SELECT * FROM ({_gram_sql('day', '0')}))"


def _daily(t):
    """Increment of every day, one grouped Gram with the day as arm."""
    return bandit.gram_by_arm(t.acts.drop("content_id").withColumnRenamed("day", "content_id"), lam=0.0).withColumnRenamed("arm", "day")


def _combined(strategy: str, rate: float) -> str:
    ridge = f"CASE WHEN i = j THEN pow({rate}, d) ELSE 0 END"
    if strategy == "reset":
        return "SELECT day, i, j, a + CASE WHEN i = j THEN 1 ELSE 0 END AS a FROM daily_c"
    return f"SELECT d AS day, i, j, sum(a * pow({rate}, d - day)) + {ridge} AS a FROM daily_c, (SELECT unnest(range(0, 4)) AS d) WHERE day <= d GROUP BY d, i, j"


for _strategy, _rate in (("reset", 1.0), ("cumulative", 1.0), ("penalised", 0.95)):

    @query(f"b7_{_strategy}", f"WITH {_CELLS}, {_DAILY} SELECT day, i, j, round(a, 5) + 0.0 AS a FROM ({_combined(_strategy, _rate)})")
    def _(t, strategy=_strategy):
        return bandit.combine_days(_daily(t), strategy).withColumn("a", F.round("a", 5) + 0.0)


@query("w5_decayed_fold", """
    WITH s AS (SELECT content_id, watch_dt, CAST(sum(watch_time) AS DOUBLE) AS s FROM curve_watches GROUP BY ALL), t AS (SELECT content_id, sum(s) AS plain FROM s GROUP BY ALL)
    SELECT d AS day, content_id, round(sum(s * pow(0.95, d - watch_dt)) / max(plain), 6) AS share FROM s JOIN t USING (content_id) JOIN (SELECT DISTINCT watch_dt AS d FROM s) ON watch_dt <= d GROUP BY ALL""")
def _(t):
    """Decayed running sum per title over days, as a share of the title's plain total."""
    daily = t.curve_watches.groupBy(F.col("watch_dt").alias("day"), F.col("content_id").cast("int").alias("i")).agg(F.sum("watch_time").cast("double").alias("a"))
    out = bandit.combine_days(daily.withColumn("j", F.lit(-2)), "penalised").join(daily.groupBy("i").agg(F.sum("a").alias("plain")), "i")
    return out.select("day", F.col("i").cast("bigint").alias("content_id"), F.round(F.col("a") / F.col("plain"), 6).alias("share"))


@query("b8_merge_arms", f"WITH {_CELLS} SELECT content_id AS arm, i, j, round(a, 6) + 0.0 AS a FROM ({_gram_sql('content_id', '1')})")
def _(t):
    days = [bandit.gram_by_arm(t.acts.filter(F.col("day") == d), lam=1.0) for d in range(4)]
    daily = days[0]
    for d in days[1:]:
        daily = daily.unionByName(d)
    return bandit.merge_arms(daily, lam=1.0, lam_inside=1.0).withColumn("a", F.round("a", 6) + 0.0)


@query("b9_check_state", "SELECT DISTINCT content_id AS arm, 64 AS d, true AS complete, true AS symmetric, true AS positive FROM acts WHERE click <> -1")
def _(t):
    return bandit.check_state(bandit.gram_by_arm(t.acts), "arm")


@query("b10_fit_quality", "SELECT round(avg(pow(label - mean, 2)), 6) AS mse FROM scored")
def _(t):
    return bandit.fit_quality(t.scored, "label", "mean").select(F.round("mse", 6).alias("mse"))


@query("b10_auc_of_mean", f"SELECT round(auc, 6) AS auc FROM ({auc_sql('scored', 'mean', 'label')})")
def _(t):
    return metrics.pooled_auc(t.scored, "mean", "label").select(F.round("auc", 6).alias("auc"))


@query("b10_scored_fit", f"WITH RECURSIVE {_CELLS}, {_solved_sql(_SHARED)} SELECT round(avg(pow(click - {_MEAN}, 2)), 6) AS mse FROM vecs, solved WHERE click <> -1")
def _(t):
    scored = bandit.score_shared(t.acts, bandit.solve_state(bandit.gram(t.acts, D)))
    return bandit.fit_quality(scored).select(F.round("mse", 6).alias("mse"))


def _requests(t):
    return t.acts.withColumn("base", F.round(F.get("h", F.lit(0)), 6)).withColumn("request", F.floor(F.col("vec_id") / 40))


# scored (train_date, strategy, request, content_id, click, base, mean, sd) -> the table of all blends
_TABLE = f"""
    tagged1 AS (SELECT s.* EXCLUDE (content_id), s.content_id, coalesce(popularity_tag, 'Unmapped') AS category FROM sets s LEFT JOIN tags USING (content_id)),
    z AS (SELECT train_date, strategy, request, content_id, click, category, {", ".join(f"coalesce(({c} - avg({c}) OVER w) / nullif(stddev_samp({c}) OVER w, 0), 0) AS {c}" for c in ("base", "sd", "mean"))} FROM tagged1 WINDOW w AS (PARTITION BY train_date, strategy)),
    s AS (SELECT * REPLACE (round(score, 6) AS score) FROM ({" UNION ALL ".join(f"SELECT *, '{n}' AS blend, {a} * base + {b} * sd + {c} * mean AS score FROM z" for n, (a, b, c) in metrics.BLENDS.items())})),
    nd AS ({ndcg_sql("s", "score", "click", by="train_date, strategy, blend, request")}),
    rk AS (SELECT *, rank() OVER (PARTITION BY train_date, strategy, blend, request ORDER BY score DESC) + (count(*) OVER (PARTITION BY train_date, strategy, blend, request, score) - 1) / 2.0::DOUBLE AS rank FROM s),
    ks AS (SELECT unnest([1::BIGINT, 3, 5]) AS k),
    t1 AS (
      SELECT train_date, strategy, blend, 'popularity_mix' AS metric, k, category, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY train_date, strategy, blend, k), 2) AS value FROM rk, ks WHERE rank <= k GROUP BY train_date, strategy, blend, k, category
      UNION ALL SELECT train_date, strategy, blend, 'catalog', k, NULL, count(DISTINCT content_id)::DOUBLE FROM rk, ks WHERE rank <= k GROUP BY ALL
      UNION ALL SELECT train_date, strategy, blend, 'perplexity', k, NULL, pow(2, -sum(n / t * log2(n / t))) FROM (SELECT *, sum(n) OVER (PARTITION BY train_date, strategy, blend, k) AS t FROM (SELECT train_date, strategy, blend, k, content_id, count(*)::DOUBLE AS n FROM rk, ks WHERE rank = k GROUP BY ALL)) GROUP BY ALL
      UNION ALL SELECT train_date, strategy, blend, 'ndcg', unnest([1::BIGINT, 3, 5]), NULL, unnest([a, b, c]) FROM (SELECT train_date, strategy, blend, avg(ndcg_1) AS a, avg(ndcg_3) AS b, avg(ndcg_5) AS c FROM nd GROUP BY ALL)
      UNION ALL SELECT train_date, strategy, blend, unnest(['score_mean', 'score_std']), 0, NULL, unnest([m, d]) FROM (SELECT train_date, strategy, blend, avg(score) AS m, stddev_samp(score) AS d FROM s GROUP BY ALL))
    SELECT train_date, strategy, blend, metric, k, category, round(value, 3) + 0.0 AS value FROM t1"""
_REQUESTS = "SELECT vec_id, vec_id // 40 AS request, content_id, click, day, round(h[1], 6) AS base, u FROM vecs WHERE click <> -1"
_TRAIN3 = _gram_sql("content_id", "1").replace("FROM cells a JOIN cells b", "FROM (SELECT * FROM cells WHERE day < 3) a JOIN (SELECT * FROM cells WHERE day < 3) b").replace("FROM cells GROUP", "FROM (SELECT * FROM cells WHERE day < 3) GROUP")
_TRAIN3_SHARED = f"SELECT -1 AS arm, i, j, sum(a) - CASE WHEN i = j THEN count(*) - 1 ELSE 0 END AS a FROM (SELECT content_id, i, j, a FROM ({_TRAIN3})) GROUP BY i, j"


def _table(standard):
    return evaluate.experiment(stage(standard, "standardised"), ["request"], digits=6).withColumn("value", F.round("value", 3) + 0.0)


@query("m11_bandit_experiment", f"""WITH RECURSIVE {_CELLS}, {_solved_sql(f"SELECT content_id AS arm, i, j, a FROM ({_TRAIN3}) UNION ALL {_TRAIN3_SHARED}", "arm")},
    rq AS ({_REQUESTS} AND day = 3),
    sets AS (SELECT 'd3' AS train_date, 'shared' AS strategy, rq.* EXCLUDE (u), {_MEAN} AS mean, {_SD.format('0.0::DOUBLE')} AS sd FROM rq JOIN solved ON arm = -1
             UNION ALL SELECT 'd3', 'by_arm', rq.* EXCLUDE (u), coalesce({_MEAN}, 0), CASE WHEN theta IS NULL THEN {_COLD} ELSE {_SD.format('1e-8')} END FROM rq LEFT JOIN solved ON arm = content_id), {_TABLE}""")
def _(t):
    """Train on three days, score the fourth with shared and per-arm states, compare the blends."""
    acts = _requests(t)
    train, test = acts.filter("day < 3"), acts.filter("day = 3")
    sets = {("d3", "shared"): evaluate.score_requests(train, test, D), ("d3", "by_arm"): evaluate.score_requests(train, test, D, arm="content_id")}
    return _table(evaluate.compare(sets, t.tags.withColumn("content_id", F.col("content_id").cast("int"))))


_STATES = " UNION ALL ".join(f"SELECT '{n}:' || day AS arm, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, a FROM ({_combined(n, r)})" for n, r in (("cumulative", 1.0), ("penalised", 0.95), ("reset", 1.0)))


@query("m11_progressive", f"""WITH RECURSIVE {_CELLS}, {_DAILY}, {_solved_sql(_STATES, "arm")},
    rq AS ({_REQUESTS} AND day > 0),
    sets AS (SELECT CAST(day - 1 AS VARCHAR) AS train_date, strategy, rq.* EXCLUDE (u), {_MEAN} AS mean, {_SD.format('0.0::DOUBLE')} AS sd
             FROM rq, (SELECT unnest(['cumulative', 'penalised', 'reset']) AS strategy) JOIN solved ON arm = strategy || ':' || (day - 1)), {_TABLE}""")
def _(t):
    """Each day scored by the states of the day before, three strategies by five blends by three dates in one plan."""
    return _table(evaluate.progressive(_requests(t), t.tags.withColumn("content_id", F.col("content_id").cast("int"))))


@query("b11_layer_choice", f"WITH {_CELLS.replace('acts)', '(SELECT * REPLACE (list_transform(h, lambda x: greatest(x, 0.0)) AS h) FROM acts))', 1)} SELECT i, j, round(a, 6) + 0.0 AS a FROM ({_gram_sql('', '1')})")
def _(t):
    """The rectified layer instead of the raw one."""
    layers = t.acts.withColumn("relu", F.transform("h", lambda x: F.greatest(x, F.lit(0.0))))
    return bandit.gram(layers, D, h="relu").withColumn("a", F.round("a", 6) + 0.0)
