"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Built-in functions only. Every row takes part; no source, document or weight is capped other than by
the number of epochs the caller allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranklens.llm.common import free_name, stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
SEED = "mix-1"
#: Hexadecimal digits of the draw that name a slice of a source: 4096 slices to sort apart from each other.
SLICE_DIGITS = 3


def water_fill(sources: DataFrame, share: float = SHARE, epochs: int = EPOCHS, weights=WEIGHTS) -> DataFrame:
    """Adds ``target`` to one row per source (source, source_size).

    Sources in code-point order, null last, take the weights in turn. Sources are filled from the
    smallest cap per weight upwards: a source whose cap is within its part of what is left is
    clamped, and the rest share what remains by weight; once one fits, all later ones fit. A source
    of size 0 gets 0. The windows run over one row per source.
    """
    named = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    named = named.select("source", "source_size", "rank", weight.cast("long").alias("weight"), (F.col("source_size") * epochs).alias("cap"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, whole = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    state = named.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"),
        (F.sum("source_size").over(whole) * F.lit(float(share))).alias("total"),
    )
    level = (F.col("total") - F.col("cap_before")) / F.col("weight_left")
    state = state.select("*", level.alias("level"), (F.col("cap") <= F.col("weight") * level).alias("clamped"))
    # among the unclamped, the one with the least cap per weight holds the level for all
    first = F.min(F.when(~F.col("clamped"), F.struct("cap_before", "rank", "level"))).over(whole)
    state = state.select("*", first.alias("open"))
    target = F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("open.level"))
    return state.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, share: float = SHARE, epochs: int = EPOCHS, weights=WEIGHTS, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    ``size`` is the number of words (null or empty text: 0). Every document of a source is repeated
    the same whole number of times; the words still missing to the target are taken in the order of
    a seeded draw of doc_id, a whole document at a time, the last one in part. A source's taken
    words are therefore its target rounded to a word, and a document exceeds no more than ``epochs``
    times its size. Repeated rows each count; equal rows are interchangeable; a null doc_id has a
    draw of its own; null is a source. No rows: no rows. Other columns are ignored.
    """
    draw = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sized = docs.select(
        "doc_id", "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        draw.alias("draw"),
    )
    sized = stage(sized.withColumn("slice", F.substring("draw", 1, SLICE_DIGITS)), "sized")
    slices = sized.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    goal = water_fill(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), share, epochs, weights)
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    plan = slices.select("source", "slice", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0)).alias("before"))
    same = lambda a, b, c: F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    plan = plan.alias("p").join(goal.alias("g"), same("p", "g", "source")).select("p.source", "p.slice", "before", "source_size", "target")
    rows = sized.alias("d").join(plan.alias("p"), same("d", "p", "source") & same("d", "p", "slice"))
    within = Window.partitionBy("d.source", "d.slice").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("doc_id", "size", "source_size", "target", (F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0))).alias("start"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor(F.col("target") + 0.5).cast("long") - F.col("whole") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("start")))
    rows = rows.withColumn("whole", whole).withColumn("rest", rest)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + part).alias("taken"))


ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS draw
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM sources
), weighted AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 2 AS cap FROM ranked
), state AS (
  SELECT *, CAST(coalesce(sum(cap) OVER w, 0) AS BIGINT) AS cap_before,
         CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS BIGINT) AS weight_left,
         CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS total
  FROM weighted
  WINDOW w AS (ORDER BY CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE), rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, (total - cap_before) / weight_left AS level FROM state
), open AS (
  SELECT first(level ORDER BY cap_before, rank) AS level FROM levels WHERE cap > weight * level
), targets AS (
  SELECT source, source_size,
         CASE WHEN cap <= weight * l.level THEN CAST(cap AS DOUBLE) ELSE weight * (SELECT level FROM open) END AS target
  FROM levels l
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, CAST(floor(target + 0.5) AS BIGINT) - whole * source_size - start)) AS BIGINT) AS taken
FROM placed
"""
