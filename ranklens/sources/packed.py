"""Decoders and encoders for values that arrive packed in one column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POPULARITY_TAGS = ["dc", "dv", "wc", "wv", "mc", "mv"]  # fixed values: day, week and month count and percentile


def explode_packed_triples(df: DataFrame, src: str, src_lang: str, packed: str) -> DataFrame:
    """``"id,lang,score,id,lang,score"`` per source item to one row per target."""
    parts = F.split(packed, ",")
    triples = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(parts) / 3).cast("int") - 1),
        lambda i: F.struct(
            F.get(parts, i * 3).cast("bigint").alias("dst"),
            F.get(parts, i * 3 + 1).cast("int").alias("dst_lang"),
            F.get(parts, i * 3 + 2).cast("double").alias("score"),
        ),
    )
    return df.filter(F.size(parts) >= 3).select(F.col(src).alias("src"), F.col(src_lang).alias("src_lang"), F.inline(triples))


def step_arrays(packed: Column) -> tuple[Column, Column]:
    """Threshold array and value array of ``"thr,val,thr,val"``."""
    numbers = F.transform(F.split(packed, ","), lambda x: x.cast("double"))
    return F.filter(numbers, lambda _, i: i % 2 == 0), F.filter(numbers, lambda _, i: i % 2 == 1)


def explode_steps(df: DataFrame, keys: list[str], packed: str) -> DataFrame:
    thresholds, values = step_arrays(F.col(packed))
    steps = F.arrays_zip(thresholds.alias("threshold"), values.alias("value"))
    return df.select(*keys, F.posexplode(steps).alias("pos", "step")).select(
        *keys, "pos", F.col("step.threshold").alias("threshold"), F.col("step.value").alias("value")
    )


def decode_watches(flat: Column) -> Column:
    """Flat array of 5-tuples to an array of watch structs; a trailing partial tuple is ignored."""
    names = ["content_id", "language", "watch_len", "first_watch", "last_watch"]
    n = F.floor(F.size(flat) / 5).cast("int")
    return F.when(
        n > 0,
        F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.struct(*[F.get(flat, i * 5 + j).alias(name) for j, name in enumerate(names)]),
        ),
    )


def pivot_popularity(df: DataFrame, keys=("day", "content_id", "language_id")) -> DataFrame:
    """Rows (key, tag, value) to one column per known tag.

    A repeated (key, tag) keeps the largest value; unknown tags are dropped; missing tags are 0.
    """
    known = df.filter(F.col("tag").isin(POPULARITY_TAGS))
    return known.groupBy(*keys).agg(
        *[F.coalesce(F.max(F.when(F.col("tag") == t, F.col("value"))), F.lit(0.0)).alias(t) for t in POPULARITY_TAGS]
    )


def merge_windows(d1: DataFrame, d7: DataFrame, d30: DataFrame, keys=("state", "content_id")) -> DataFrame:
    """Counts and percentiles of three windows side by side, 0 where a window lacks the key.

    A tagged union and one aggregation does the work of two full joins with one shuffle.
    """
    tagged = None
    for prefix, frame in (("d", d1), ("w", d7), ("m", d30)):
        part = frame.select(*keys, F.lit(prefix).alias("w"), F.col("count").cast("double").alias("c"), F.col("percentile").cast("double").alias("v"))
        tagged = part if tagged is None else tagged.unionByName(part)
    columns = [
        F.coalesce(F.max(F.when(F.col("w") == prefix, F.col(source))), F.lit(0.0)).alias(f"{prefix}{source}")
        for prefix in ("d", "w", "m")
        for source in ("c", "v")
    ]
    return tagged.groupBy(*keys).agg(*columns)


def pack_items(df: DataFrame, key: str, ids: str, updated_at: int, ttl_days: int = 730) -> DataFrame:
    """Key-value rows: id, result ids as strings, update time and expiry; empty results are dropped."""
    return df.filter(F.size(ids) > 0).select(
        F.col(key).cast("string").alias("id"),
        F.transform(ids, lambda x: x.cast("string")).alias("items"),
        F.lit(updated_at).cast("bigint").alias("updated_at"),
        F.lit(updated_at + ttl_days * 86400).cast("bigint").alias("ttl"),
    )


def to_items_json(items: Column) -> Column:
    """Array of (content_id, score) structs as a JSON list."""
    return F.to_json(items)


def from_items_json(text: Column) -> Column:
    return F.from_json(text, "array<struct<content_id:bigint,score:double>>")
