"""Linear bandit statistics on activation vectors, shared or per arm.

State is long: (i, j, a) and (i, b) cells, plus ``arm`` for per-arm state. Dense products run in
Arrow batches where Spark has put the rows; only d x d partial sums are shuffled. Scoring brings rows
and solved states together by (arm, part) with a bounded number of rows per part, for the shared
model too, so a state of any size takes the same way. A null arm is an arm like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranklens.operators.keyed import row_hash

EPS = 1e-8
PACKED = "arm string, i array<int>, j array<int>, a array<double>"


def _matrix(series: pd.Series) -> np.ndarray:
    h = np.stack(series.to_numpy()).astype(np.float64)
    return h / (np.linalg.norm(h, axis=1, keepdims=True) + EPS)


def _cells(a: np.ndarray, b: np.ndarray, count: int) -> pd.DataFrame:
    """Upper triangle of A, b in column -1, and the row count in cell (-1, -1)."""
    i, j = np.triu_indices(len(b))
    rows = np.concatenate([i, np.arange(len(b)), [-1]]).astype(np.int32)
    cols = np.concatenate([j, np.full(len(b), -1), [-1]]).astype(np.int32)
    return pd.DataFrame({"i": rows, "j": cols, "a": np.concatenate([a[i, j], b, [float(count)]])})


def gram_partials(act: DataFrame, h: str = "h", label: str = "click") -> DataFrame:
    """Sums of h h' and h y in the cell form of ``_cells``; masked rows (label -1) are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = b = None
        count = 0
        for pdf in batches:
            if len(pdf) == 0:
                continue
            m, y = _matrix(pdf["h"]), pdf["y"].to_numpy(dtype=np.float64)
            if a is None:
                a, b = np.zeros((m.shape[1],) * 2), np.zeros(m.shape[1])
            a += m.T @ m
            b += m.T @ y
            count += len(pdf)
        if a is not None:
            yield _cells(a, b, count)

    rows = act.filter((F.col(label) != -1) & F.col(h).isNotNull()).select(F.col(h).alias("h"), F.col(label).cast("double").alias("y"))
    return rows.mapInPandas(run, "i int, j int, a double").groupBy("i", "j").agg(F.sum("a").alias("a"))


def _unfold(cells: DataFrame, keys: list[str], lam: float) -> DataFrame:
    """Both triangles of A with lambda on the diagonal, and b as column -1."""
    both = cells.filter("i >= 0").withColumn("mirror", F.explode(
        F.when((F.col("j") >= 0) & (F.col("i") != F.col("j")), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    i = F.when(F.col("mirror"), F.col("j")).otherwise(F.col("i"))
    j = F.when(F.col("mirror"), F.col("i")).otherwise(F.col("j"))
    ridge = F.when(F.col("i") == F.col("j"), F.lit(float(lam))).otherwise(0.0)
    return both.select(*keys, i.alias("i"), j.alias("j"), (F.col("a") + ridge).alias("a"))


def gram(act: DataFrame, d: int, lam: float = 1.0, h: str = "h", label: str = "click") -> DataFrame:
    """Shared state (i, j, a): A = lam I + H'H, and b = H'y in the rows with j = -1.

    Without any row that counts, the state is lam I and b = 0 of dimension ``d``. ``h`` names the layer
    to use (before or after the activation, or another layer).
    """
    span = F.sequence(F.col("i"), F.lit(d - 1))
    zeros = act.sparkSession.range(d).select(F.col("id").cast("int").alias("i"))
    zeros = zeros.select("i", F.explode(F.concat(F.array(F.lit(-1)), span)).alias("j"), F.lit(0.0).alias("a"))
    cells = gram_partials(act, h, label).filter("i >= 0").unionByName(zeros).groupBy("i", "j").agg(F.sum("a").alias("a"))
    return _unfold(cells, [], lam)


def update_state(state: DataFrame, partial: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Stored state plus a new increment (computed with lam = 0)."""
    cols = [*keys, "i", "j", "a"]
    return state.select(*cols).unionByName(partial.select(*cols)).groupBy(*keys, "i", "j").agg(F.sum("a").alias("a"))


def _arm_key(arm) -> Column:
    """An arm as text that is never null, so that rows of a null arm meet too."""
    return F.coalesce(F.concat(F.lit("="), F.col(arm).cast("string")), F.lit("none"))


def _arm_value(key: str, kind: str) -> Column:
    return F.when(F.col(key) != "none", F.substring(F.col(key), 2, 1 << 30)).cast(kind)


def _draw(act: DataFrame, row: str | None) -> Column:
    """A hash that deals rows: of the column ``row`` that names them, or of all their columns."""
    return row_hash(act, [row] if row else act.columns)


def gram_by_arm(act: DataFrame, lam: float = 1.0, arm: str = "content_id", h: str = "h", label: str = "click", parts: int = 16, row: str | None = None) -> DataFrame:
    """Per-arm state (arm, i, j, a) with lam I for every arm with a row that counts.

    Rows are dealt by (arm, part), so a hot arm is summed by ``parts`` tasks. The part is a hash of the
    row, so a task that runs again, over rows in whatever order, deals them as before; rows equal in every
    column share a part, unless ``row`` names a column that tells them apart. Inside a task the rows come
    sorted by arm, and one d x d sum is held.
    """
    kept = act.filter((F.col(label) != -1) & F.col(h).isNotNull()).select(
        _arm_key(arm).alias("arm"), F.col(h).alias("h"), F.col(label).cast("double").alias("y"), F.pmod(_draw(act, row), F.lit(parts)).alias("part"))
    placed = kept.repartition("arm", "part").sortWithinPartitions("arm", "part")
    arm_type = act.schema[arm].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, a, b, count = None, None, None, 0

        def flush():
            own = _cells(a, b, count)
            return pd.DataFrame({"arm": [current], **{c: [own[c].to_numpy()] for c in ("i", "j", "a")}})

        for pdf in batches:
            for key, g in pdf.groupby("arm", sort=True):
                m, y = _matrix(g["h"]), g["y"].to_numpy(dtype=np.float64)
                if current is not None and key != current:
                    yield flush()
                    a = None
                if a is None:
                    a, b, count = np.zeros((m.shape[1],) * 2), np.zeros(m.shape[1]), 0
                current = key
                a += m.T @ m
                b += m.T @ y
                count += len(g)
        if a is not None:
            yield flush()

    # the cells of a state travel in one row and are summed where its rows meet
    packed = placed.select("arm", "h", "y").mapInPandas(run, PACKED)
    cells = packed.repartition("arm").select("arm", F.inline(F.arrays_zip("i", "j", "a")))
    summed = cells.groupBy("arm", "i", "j").agg(F.sum("a").alias("a"))
    return _unfold(summed.withColumn("arm", _arm_value("arm", arm_type)), ["arm"], lam)


def _dense(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    i, j, value = (np.concatenate(pdf[c].to_list()) for c in ("i", "j", "a"))
    d = int(i.max()) + 1
    a, b = np.zeros((d, d)), np.zeros(d)
    quad = j >= 0
    a[i[quad], j[quad]] = value[quad]
    b[i[~quad]] = value[~quad]
    return a, b


def _inverse(a: np.ndarray) -> tuple[np.ndarray | None, float]:
    """A^-1 of a symmetric positive definite matrix, None if it is singular, and the smallest eigenvalue."""
    if not np.isfinite(a).all():
        return None, float("nan")
    whole = (a + a.T) / 2
    values = np.linalg.eigvalsh(whole)
    least = float(values[0])
    # rank check: an eigenvalue below rounding error of the largest counts as 0
    if least <= len(a) * np.finfo(np.float64).eps * max(float(values[-1]), 0.0):
        return None, least
    low = np.linalg.solve(np.linalg.cholesky(whole), np.eye(len(a)))
    return low.T @ low, least


def solve_state(state: DataFrame, arm: str | None = None, symmetric: bool = False) -> DataFrame:
    """One row per arm (or one in all): flattened A^-1, theta = A^-1 b, smallest eigenvalue, singular.

    A is solved through its Cholesky factor. An arm whose A has no full rank (lambda 0 and too few
    different rows) or is not finite comes back ``singular``, without A^-1 and theta; the other arms are not
    touched, and scoring treats it as an arm without state. A group is the d x d state of one arm, whatever
    the number of rows behind it; its cells travel as three lists side by side. ``symmetric`` says
    that both triangles of A are equal, as ``gram`` and ``gram_by_arm`` make them; only one of them travels then.
    """
    arm_type = state.schema[arm].dataType.simpleString() if arm else "int"
    cells = state.select((_arm_key(arm) if arm else F.lit("=0")).alias("arm"), "i", "j", F.coalesce("a", F.lit(float("nan"))).alias("a"))
    if symmetric:
        cells = cells.filter("j < 0 or i <= j")
    keyed = cells.groupBy("arm").agg(*[F.collect_list(c).alias(c) for c in ("i", "j", "a")])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = _dense(pdf)
        if symmetric:
            a = a + np.triu(a, 1).T
        inverse, least = _inverse(a)
        return pd.DataFrame({"arm": [pdf["arm"].iloc[0]], "d": [len(b)], "a_inv": [None if inverse is None else inverse.ravel()],
                             "theta": [None if inverse is None else inverse @ b], "min_eigenvalue": [least], "singular": [inverse is None]})

    out = keyed.groupBy("arm").applyInPandas(run, "arm string, d int, a_inv array<double>, theta array<double>, min_eigenvalue double, singular boolean")
    return out.withColumn("arm", _arm_value("arm", arm_type)) if arm else out.drop("arm")


def _with_scores(act: DataFrame) -> T.StructType:
    return T.StructType([*act.schema.fields, T.StructField("mean", T.DoubleType()), T.StructField("sd", T.DoubleType())])


def _scores(m: np.ndarray, inverse: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return m @ theta, np.einsum("ij,jk,ik->i", m, inverse, m, optimize=True)


def score_shared(act: DataFrame, solved: DataFrame, lam: float = 1.0, h: str = "h", rows_per_part: int = 50_000, row: str | None = None) -> DataFrame:
    """Rows with ``mean`` = h theta and ``sd`` = sqrt(h' A^-1 h); rows are never multiplied with each other.

    The same way as ``score_by_arm``, with one arm for all rows.
    """
    one = act.withColumn("__one", F.lit(0))
    return score_by_arm(one, solved.withColumn("arm", F.lit(0)), lam, "__one", h, rows_per_part, 0.0, row).drop("__one")


def score_by_arm(act: DataFrame, solved: DataFrame, lam: float = 1.0, arm: str = "content_id", h: str = "h", rows_per_part: int = 50_000, floor: float = EPS, row: str | None = None) -> DataFrame:
    """Scores against the row's own arm; an arm without state, or with a singular one, gets mean 0 and variance h'h / lam.

    Rows and state meet by (arm, part) with about ``rows_per_part`` rows per part; a hot arm's state is
    repeated once per part. The part is a hash of the row, as in ``gram_by_arm``, so every row is scored
    once even if tasks run again or ``act`` is evaluated in another order. A null arm is cold unless it was
    trained.
    """
    keyed = act.select(_arm_key(arm).alias("__arm"), _draw(act, row).alias("__row"), *act.columns)
    parts = keyed.groupBy("__arm").agg(F.ceil(F.count(F.lit(1)) / rows_per_part).cast("int").alias("__parts"))
    rows = keyed.join(parts, "__arm").withColumn("__part", F.pmod("__row", "__parts").cast("int")).drop("__row", "__parts")
    copies = solved.filter(F.col("theta").isNotNull()).select(_arm_key("arm").alias("__arm"), "d", "a_inv", "theta").join(parts, "__arm")
    copies = copies.select("__arm", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__part"), "d", "a_inv", "theta")
    names = act.columns
    schema = _with_scores(act)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) == 0:
            return pd.DataFrame(columns=[*names, "mean", "sd"])
        m = _matrix(left[h])
        if len(right):
            d = int(right["d"].iloc[0])
            mean, var = _scores(m, np.array(right["a_inv"].iloc[0]).reshape(d, d), np.array(right["theta"].iloc[0]))
        else:
            mean, var = np.zeros(len(m)), (m * m).sum(axis=1) / lam
        return left[names].assign(mean=mean, sd=np.sqrt(np.maximum(var, floor)))

    return rows.groupBy("__arm", "__part").cogroup(copies.groupBy("__arm", "__part")).applyInPandas(run, schema)


def combine_days(daily: DataFrame, strategy: str, gamma: float = 0.95, lam: float = 1.0) -> DataFrame:
    """State as of each day from daily increments (day, i, j, a), computed with lam = 0.

    reset: that day plus lam I. cumulative: all days so far plus lam I. penalised: earlier days decay by
    gamma per step, the first day together with lam I. Days are numbered by order, whatever the gaps.
    """
    days = daily.select("day").distinct()
    ordered = days.agg(F.array_sort(F.collect_list("day")).alias("days"))
    n = F.array_position(ordered.scalar(), F.col("day")).cast("int")
    numbered = daily.withColumn("step", n)
    last = ordered.select(F.size("days")).scalar()
    if strategy == "reset":
        return numbered.withColumn("a", F.col("a") + F.when(F.col("i") == F.col("j"), F.lit(lam)).otherwise(0.0)).drop("step")
    rate = {"cumulative": 1.0, "penalised": gamma}[strategy]
    # a cell's increments in day order, folded once; a cell's list has one entry per day
    once = numbered.groupBy("i", "j", "step").agg(F.sum("a").alias("a")).withColumn("last", last)
    cell = once.groupBy("i", "j").agg(F.map_from_entries(F.collect_list(F.struct("step", "a"))).alias("by_step"), F.min("step").alias("first"), F.max("last").alias("last"))

    def fold(acc, at):
        state = acc["state"] * F.lit(rate) + F.coalesce(F.try_element_at(F.col("by_step"), at), F.lit(0.0))
        return F.struct(F.concat(acc["out"], F.array(state)).alias("out"), state.alias("state"))

    zero = F.struct(F.array().cast("array<double>").alias("out"), F.lit(0.0).alias("state"))
    states = F.aggregate(F.sequence("first", "last"), zero, fold)["out"]
    rows = cell.select("i", "j", "first", F.posexplode(states).alias("after", "a")).withColumn("at", F.col("first") + F.col("after"))
    ridge = F.when(F.col("i") == F.col("j"), F.lit(lam) * F.pow(F.lit(rate), F.col("at") - 1)).otherwise(0.0)
    return rows.select(F.element_at(ordered.scalar(), F.col("at").cast("int")).alias("day"), "i", "j", (F.col("a") + ridge).alias("a"))


def merge_arms(daily: DataFrame, lam: float = 1.0, lam_inside: float = 0.0) -> DataFrame:
    """Per-arm state over the union of arms of several days, with lam I once.

    ``lam_inside`` is the lam each daily state already carries; it is taken out before the sum.
    """
    on_diagonal = F.col("i") == F.col("j")
    bare = daily.withColumn("a", F.col("a") - F.when(on_diagonal, F.lit(lam_inside)).otherwise(0.0))
    summed = bare.groupBy("arm", "i", "j").agg(F.sum("a").alias("a"))
    return summed.withColumn("a", F.col("a") + F.when(on_diagonal, F.lit(lam)).otherwise(0.0))


def check_state(state: DataFrame, arm: str | None = None, tolerance: float = 1e-6) -> DataFrame:
    """Per arm: dimension, expected cells present, symmetric within tolerance, positive definite."""
    keyed = state if arm else state.withColumn("arm", F.lit(0))
    quad = keyed.filter("j >= 0")
    lo, hi = F.least("i", "j"), F.greatest("i", "j")
    pairs = quad.groupBy("arm", lo.alias("lo"), hi.alias("hi")).agg((F.max("a") - F.min("a")).alias("gap"), F.count(F.lit(1)).alias("n"), F.max("i").alias("i"))
    shape = pairs.groupBy("arm").agg((F.max("hi") + 1).cast("int").alias("d"), F.sum("n").alias("cells"), (F.max("gap") <= tolerance).alias("symmetric"))
    solved = solve_state(keyed, "arm").select("arm", (F.col("min_eigenvalue") > 0).alias("positive"))
    out = shape.join(solved, "arm").select("arm", "d", (F.col("cells") == F.col("d") * F.col("d")).alias("complete"), "symmetric", "positive")
    return out if arm else out.drop("arm")


def fit_quality(scored: DataFrame, label: str = "click", mean: str = "mean") -> DataFrame:
    """Mean squared error of the linear prediction against the label."""
    return scored.filter(F.col(label) != -1).agg(F.avg(F.pow(F.col(label) - F.col(mean), 2)).alias("mse"))
