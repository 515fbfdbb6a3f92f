"""Ranking evaluation on scored rows (request keys, item, scores, label).

Rank-based metrics first fold a request to its tie groups (one row per distinct score); the first k
groups of each request are enough for every metric at k, and Spark limits rows per request before
the shuffle. Metrics over all rows use the sliced running sums.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranklens.functions.hashing import hash_uniform
from ranklens.operators.keyed import prefix_sums, top_n

KS = [1, 3, 5]
# Fixed values: (base, deviation, mean) weights of the five blends.
BLENDS = {
    "base": (1.0, 0.0, 0.0),
    "explore": (0.0, 1.0, 0.0),
    "mean": (0.0, 0.0, 1.0),
    "base_explore": (1.0, 1.0, 0.0),
    "mean_explore": (0.0, 1.0, 1.0),
}


def tie_groups(df: DataFrame, by: list[str], score: str, k: int, label: str | None = None) -> DataFrame:
    """First k distinct scores per request with size, label sum and rows before them (``ahead``).

    Rows without a score take no position.
    """
    df = df.filter(F.col(score).isNotNull())
    sums = [F.sum(F.col(label).cast("double")).alias("gain")] if label else []
    return _first_groups(df.groupBy(*by, score).agg(F.count(F.lit(1)).alias("n"), *sums), by, score, k)


def _first_groups(groups: DataFrame, by: list[str], score: str, k: int) -> DataFrame:
    kept = top_n(groups, by, [F.col(score).desc()], k)
    w = Window.partitionBy(*by).orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return kept.withColumn("ahead", F.coalesce(F.sum("n").over(w), F.lit(0)))


def avg_rank(df: DataFrame, by: list[str], score: str) -> DataFrame:
    """Every row with its descending rank; equal scores share the mean of their positions.

    A row without a score takes no position; its rank is null.
    """
    groups = df.filter(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count(F.lit(1)).alias("__n"))
    placed = prefix_sums(groups, by, score, {"__ahead": F.col("__n")}, descending=True)
    ranks = placed.select(*by, score, (F.col("__ahead") + (F.col("__n") + 1) / 2).alias("rank"))
    return df.join(ranks, [*by, score], "left")


def at_k(df: DataFrame, by: list[str], score: str, k: int, mode: str = "le", groups: DataFrame | None = None) -> DataFrame:
    """Rows with average rank <= k (or exactly k), with the rank.

    Equal to filtering ``avg_rank``, from the first k tie groups only (``groups``, if a caller has them).
    """
    groups = tie_groups(df, by, score, k) if groups is None else groups
    rank = F.col("ahead") + (F.col("n") + 1) / 2
    chosen = groups.select(*by, score, rank.alias("rank")).filter(F.col("rank") <= k if mode == "le" else F.col("rank") == k)
    return df.join(chosen, [*by, score])


def _discounts(k: int) -> list[float]:
    return [1 / math.log2(i + 2) for i in range(k)]


def _cum_discount(pos: Column, k: int) -> Column:
    """Sum of the first ``pos`` log2 discounts, at most k of them."""
    totals, acc = [0.0], 0.0
    for d in _discounts(k):
        acc += d
        totals.append(acc)
    return F.element_at(F.array(*[F.lit(t) for t in totals]), (F.least(pos, F.lit(k)) + 1).cast("int"))


def request_ndcg(df: DataFrame, by: list[str], score: str, label: str, ks=KS, min_rows: int | None = None, groups: DataFrame | None = None) -> DataFrame:
    """NDCG@k per request with linear gain, log2 discount and mean gain inside ties.

    Requests with fewer than ``min_rows`` rows (default: the largest k) are left out; a request with
    one label value scores 0. Request facts and the ideal order both come from the label counts.
    """
    kmax = max(ks)
    labels = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    facts = labels.groupBy(*by).agg(F.sum("n").alias("rows"), F.min(label).alias("lo"), F.max(label).alias("hi"))
    facts = facts.filter(F.col("rows") >= (kmax if min_rows is None else min_rows))

    def gains(g: DataFrame):
        mean = F.col("gain") / F.col("n")
        return g.groupBy(*by).agg(*[
            F.sum(mean * (_cum_discount(F.col("ahead") + F.col("n"), k) - _cum_discount(F.col("ahead"), k))).alias(f"s{k}")
            for k in ks])

    got = gains(tie_groups(df, by, score, kmax, label) if groups is None else groups)
    ideal = labels.withColumn("gain", F.col("n") * F.col(label).cast("double"))
    best = gains(_first_groups(ideal, by, label, kmax)).withColumnsRenamed({f"s{k}": f"i{k}" for k in ks})
    joined = facts.join(got, by).join(best, by)
    flat = F.col("lo") == F.col("hi")
    return joined.select(*by, *[F.when(flat, 0.0).otherwise(F.col(f"s{k}") / F.col(f"i{k}")).alias(f"ndcg_{k}") for k in ks])


def ndcg_at(df: DataFrame, by: list[str], score: str, label: str, ks=KS, group: list[str] = (), groups: DataFrame | None = None) -> DataFrame:
    """Mean NDCG@k over requests, in long form (group, metric, k, value)."""
    per = request_ndcg(df, [*group, *by], score, label, ks, groups=groups)
    means = per.groupBy(*group).agg(*[F.avg(f"ndcg_{k}").alias(f"ndcg_{k}") for k in ks])
    return _long(means, group, "ndcg", {k: f"ndcg_{k}" for k in ks})


def _long(df: DataFrame, group: list[str], metric: str, by_k: dict[int, str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.col(c).cast("double").alias("value")) for k, c in by_k.items()])
    return df.select(*group, F.lit(metric).alias("metric"), F.inline(rows))


def _top_counts(df: DataFrame, by: list[str], score: str, keep: list[str], ks, group: list[str], groups: DataFrame | None = None) -> DataFrame:
    """Rows with rank <= the largest k counted per (group, rank, keep columns): all that the list metrics need."""
    return at_k(df, [*group, *by], score, max(ks), groups=groups).groupBy(*group, *keep, "rank").agg(F.count(F.lit(1)).alias("n"))


def _at_each_k(top: DataFrame, keep: list[str], ks, group: list[str], mode: str = "le") -> DataFrame:
    """Counts of ``_top_counts`` summed per (group, k, keep columns)."""
    each = top.withColumn("k", F.explode(F.array(*[F.lit(k).cast("bigint") for k in ks])))
    test = F.col("rank") == F.col("k") if mode == "eq" else F.col("rank") <= F.col("k")
    return each.filter(test).groupBy(*group, "k", *keep).agg(F.sum("n").alias("n"))


def _popularity_mix(top: DataFrame, category: str, ks, group: list[str]) -> DataFrame:
    counted = _at_each_k(top, [category], ks, group)
    share = F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(*group, "k")), 2)
    return counted.select(*group, F.lit("popularity_mix").alias("metric"), "k", F.col(category).alias("category"), share.alias("value"))


def _catalog(top: DataFrame, item: str, ks, group: list[str]) -> DataFrame:
    counted = _at_each_k(top, [item], ks, group)
    return counted.groupBy(*group, "k").agg(F.count(F.lit(1)).cast("double").alias("value")).select(*group, F.lit("catalog").alias("metric"), "k", "value")


def _perplexity(top: DataFrame, item: str, ks, mode: str, group: list[str]) -> DataFrame:
    counted = _at_each_k(top, [item], ks, group, mode)
    # H = log2 N - sum(n log2 n) / N
    total = F.sum("n")
    entropy = F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total
    per_k = counted.groupBy(*group, "k").agg(F.pow(F.lit(2.0), entropy).alias("value"))
    return per_k.select(*group, F.lit("perplexity").alias("metric"), "k", "value")


def popularity_mix_at(df: DataFrame, by: list[str], score: str, category: str, ks=KS, group: list[str] = ()) -> DataFrame:
    """Percent of rows with rank <= k per category, two decimals."""
    return _popularity_mix(_top_counts(df, by, score, [category], ks, group), category, ks, group)


def catalog_at(df: DataFrame, by: list[str], score: str, item: str, ks=KS, group: list[str] = ()) -> DataFrame:
    """Distinct items with rank <= k."""
    return _catalog(_top_counts(df, by, score, [item], ks, group), item, ks, group)


def perplexity_at(df: DataFrame, by: list[str], score: str, item: str, ks=KS, mode: str = "eq", group: list[str] = ()) -> DataFrame:
    """2 ** entropy of the items at rank exactly k; ``mode='le'`` takes all ranks up to k."""
    return _perplexity(_top_counts(df, by, score, [item], ks, group), item, ks, mode, group)


def blend(df: DataFrame, blends: dict[str, tuple] = BLENDS, base="base", sd="sd", mean="mean") -> DataFrame:
    """One row per blend with ``score = a * base + b * sd + c * mean``."""
    structs = F.array(*[F.struct(F.lit(n).alias("blend"), (F.lit(a) * F.col(base) + F.lit(b) * F.col(sd) + F.lit(c) * F.col(mean)).alias("score"))
                        for n, (a, b, c) in blends.items()])
    return df.select("*", F.inline(structs))


def validation_set(rows: DataFrame, min_items: int = 5) -> DataFrame:
    """Impression rows of requests with enough distinct items and at least one click."""
    keys = ["dw_p_id", "timestamp", "flag"]
    pairs = rows.filter(F.col("flag") == 0).groupBy(*keys, "content_id").agg(F.max("click").alias("click"))
    good = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("items"), F.max("click").alias("clicked"))
    good = good.filter((F.col("items") >= min_items) & (F.col("clicked") == 1))
    return rows.join(good.select(*keys), keys, "left_semi")


def _score_counts(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Distinct scores with positives and negatives."""
    return df.groupBy(*by, score).agg(F.count_if(F.col(label) > 0).alias("pos"), F.count_if(F.col(label) <= 0).alias("neg"))


def _with_above(counts: DataFrame, by: list[str], score: str) -> DataFrame:
    """``_score_counts`` with the same counted over all larger scores."""
    return prefix_sums(counts, by, score, {"pos_above": F.col("pos"), "neg_above": F.col("neg")}, descending=True)


def _auc() -> Column:
    """Mann-Whitney: each negative counts the positives above it and half of the tied ones."""
    wins = F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2))
    return wins / (F.sum("pos").cast("double") * F.sum("neg"))


def pooled_auc(df: DataFrame, score: str, label: str, by: list[str] = ()) -> DataFrame:
    """AUC over all rows (per group if asked); null without both classes."""
    return _counted_auc(_score_counts(df, list(by), score, label), score, list(by))


def _counted_auc(counts: DataFrame, score: str, by: list[str]) -> DataFrame:
    both = (F.sum("pos") > 0) & (F.sum("neg") > 0)
    return _with_above(counts, by, score).groupBy(*by).agg(F.when(both, _auc()).alias("auc"))


def log_loss_expr(label: Column, logit: Column, eps: float = 1e-8) -> Column:
    p = F.least(F.greatest(F.lit(1.0) / (F.lit(1.0) + F.exp(-logit)), F.lit(eps)), F.lit(1 - eps))
    return -(label * F.log(p) + (F.lit(1.0) - label) * F.log(F.lit(1.0) - p))


def log_loss(df: DataFrame, label: str, logit: str, eps: float = 1e-8) -> DataFrame:
    """Mean binary log loss from logits; 0 for no rows."""
    loss = F.avg(log_loss_expr(F.col(label).cast("double"), F.col(logit), eps))
    return df.agg(F.coalesce(loss, F.lit(0.0)).alias("log_loss"))


def rmse(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.agg(F.sqrt(F.avg(F.pow(F.col(y) - F.col(p), 2))).alias("rmse"))


def _discounts_between(ahead: Column, n: Column, piece: int = 10_000) -> Column:
    """Sum of the log2 discounts of the positions ahead + 1 .. ahead + n.

    A long run of tied positions is summed in pieces, so no array holds all of them.
    """
    zero, long = F.lit(0.0), lambda x: F.lit(x).cast("bigint")
    one = lambda i: F.lit(1.0) / F.log2(ahead + i + 1)
    inside = lambda at: F.aggregate(F.sequence(at + 1, F.least(at + piece, n)), zero, lambda s, i: s + one(i))
    return F.when(n > 0, F.aggregate(F.sequence(long(0), n - 1, long(piece)), zero, lambda s, at: s + inside(at))).otherwise(zero)


def user_metrics(df: DataFrame, score: str, label: str, rate: float | None = None, salt: str = "eval", user: str = "dw_p_id") -> DataFrame:
    """AP, NDCG and AUC averaged unweighted over users with both classes, plus pooled AUC and loss.

    All users take part; a caller that wants a sample names the ``rate`` of users drawn by hash. The
    input is read by several metrics, so a caller with an expensive one stages it first.
    """
    both = df.groupBy(user).agg(F.max(label).alias("hi"), F.min(label).alias("lo")).filter("hi > 0 and lo <= 0").select(user)
    users = both if rate is None else both.filter(hash_uniform([user], salt) < rate)
    rows = df.select(user, score, label).join(users, user, "left_semi")
    counts = _score_counts(rows, [user], score, label)
    hist = _with_above(counts, [user], score)
    n, ahead = F.col("pos") + F.col("neg"), F.col("pos_above") + F.col("neg_above")
    precision = (F.col("pos_above") + F.col("pos")) / (ahead + n)
    gain = F.sum(F.col("pos") / n * _discounts_between(ahead, n))
    parts = hist.groupBy(user).agg((F.sum(F.col("pos") * precision) / F.sum("pos")).alias("ap"), _auc().alias("auc"), F.sum("pos").alias("total"), gain.alias("dcg"))
    per_user = parts.withColumn("ndcg", F.col("dcg") / _discounts_between(F.lit(0).cast("bigint"), F.col("total")))
    means = per_user.agg(F.count(F.lit(1)).alias("num_users"), F.avg("ap").alias("map"), F.avg("ndcg").alias("ndcg"), F.avg("auc").alias("group_auc"))
    # all rows together: the users' counts summed per score
    pooled = _counted_auc(counts.groupBy(score).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), score, []).scalar()
    loss = log_loss(rows, label, score).scalar()
    return means.withColumn("auc", pooled).withColumn("loss", loss)


def task_metrics(df: DataFrame, tasks: list[tuple[str, str]]) -> DataFrame:
    """AUC and log loss per (label column, logit column), over rows the task does not mask."""
    structs = F.array(*[F.struct(F.lit(y).alias("task"), F.col(y).cast("double").alias("y"), F.col(s).cast("double").alias("logit")) for y, s in tasks])
    rows = df.select(F.inline(structs)).filter(F.col("y") != -1)
    loss = rows.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.avg(log_loss_expr(F.col("y"), F.col("logit"))).alias("log_loss"))
    return loss.join(pooled_auc(rows, "logit", "y", ["task"]), "task")


def mean_by(df: DataFrame, category: str, score: str) -> DataFrame:
    return df.groupBy(category).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"))


def task_weights(stats: DataFrame, weights: dict[str, float], batch: int) -> DataFrame:
    """Loss weights normalised to 1 and expected active rows per batch, by task."""
    total = sum(weights.values())
    mapping = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v) / total)])
    return stats.withColumn("loss_weight", F.coalesce(F.try_element_at(mapping, F.col("task")), F.lit(0.0))).withColumn(
        "active_rows", F.col("share") * batch)


EXPERIMENT = ["train_date", "strategy", "blend"]
TIERS = ["High", "Medium", "Low", "Negligible", "Unmapped"]


def experiment_table(df: DataFrame, by: list[str], score: str, label: str, category: str, item: str, ks=KS,
                     high: str = "High", new: str = "new release") -> DataFrame:
    """Metrics and score moments per (train date, matrix strategy, blend), in long form.

    ``df`` holds the scored rows of all experiments; the experiment is a key prefix, so a metric is one
    pass over all of them. The High tier includes new releases.
    """
    merged = df.withColumn(category, F.when(F.col(category) == new, high).otherwise(F.col(category)))
    none = F.lit(None).cast("string").alias("category")
    moments = merged.groupBy(*EXPERIMENT).agg(F.avg(score).alias("mean"), F.stddev_samp(score).alias("std")).select(
        *EXPERIMENT, F.inline(F.array(*[F.struct(F.lit(f"score_{m}").alias("metric"), F.lit(0).cast("bigint").alias("k"), F.col(m).alias("value")) for m in ("mean", "std")])))
    # one plan of tie groups for NDCG and ranks; rows are counted once, the three list metrics are sums of these counts
    groups = tie_groups(merged, [*EXPERIMENT, *by], score, max(ks), label)
    top = _top_counts(merged, by, score, [category, item], ks, EXPERIMENT, groups)
    out = _popularity_mix(top, category, ks, EXPERIMENT)
    for part in (ndcg_at(merged, by, score, label, ks, EXPERIMENT, groups), _catalog(top, item, ks, EXPERIMENT),
                 _perplexity(top, item, ks, "eq", EXPERIMENT), moments):
        out = out.unionByName(part.select(*EXPERIMENT, "metric", "k", none, "value"))
    return out


def wide_table(table: DataFrame, ks=KS, tiers: list[str] = TIERS) -> DataFrame:
    """Experiment table with one column per metric (metric@k, and the category where there is one).

    The columns follow from ``ks`` and ``tiers``, not from the data; a metric without rows is null.
    """
    clean = lambda c: c.lower().replace(" ", "_")
    names = [f"{m}_{k}" for m in ("catalog", "ndcg", "perplexity") for k in ks] + [f"popularity_mix_{k}_{clean(c)}" for k in ks for c in tiers] + ["score_mean", "score_std"]
    name = F.concat_ws("_", "metric", F.when(F.col("k") > 0, F.col("k").cast("string")), F.lower(F.replace("category", F.lit(" "), F.lit("_"))))
    return table.withColumn("name", name).groupBy(*EXPERIMENT).pivot("name", names).agg(F.first("value"))
