"""Outputs that can be rerun: committed versions, a pointer to the one in use, replaced increments, counts in the writing pass.

A version is one folder ``version=<name>``. Spark puts a success marker into a folder when the whole write
has succeeded, so a version counts once its marker is there: a write that failed half way, or is still going
on, is never read. No step reads the data it has just written to count it: statistics are aggregates of the
rows on their way into the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ranklens.sources.logs import _exists, _fs, done

POINTER = "_pointer"


def _folder(path: str, name: str) -> str:
    return f"{path.rstrip('/')}/version={name}"


def _order(name: str):
    """Numbers by value, before all other names, which go by text (dates and padded numbers keep their order)."""
    return (0, int(name), name) if name.isdecimal() else (1, 0, name)


def _listed(spark: SparkSession, path: str, prefix: str) -> list[str]:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return sorted((n.removeprefix(prefix) for n in names if n.startswith(prefix)), key=_order)


def versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the committed versions, oldest first. Folders without the marker are not versions."""
    return [n for n in _listed(spark, path, "version=") if done(spark, _folder(path, n))]


def write_version(df: DataFrame, path: str, name: str) -> None:
    """Write a version as a whole; a rerun replaces it.

    While it is written the folder has no marker, so readers keep to the other versions. ``df`` must not
    read the version it replaces.
    """
    df.write.mode("overwrite").parquet(_folder(path, name))


def read_version(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """A version's rows: the named one, or the newest committed one. Without it: FileNotFoundError."""
    known = versions(spark, path)
    if name is None and not known:
        raise FileNotFoundError(f"no committed version below {path}")
    if name is not None and name not in known:
        raise FileNotFoundError(f"version {name} below {path} is missing or was not committed")
    return spark.read.parquet(_folder(path, known[-1] if name is None else name))


def publish(spark: SparkSession, path: str, name: str, stats: dict | None = None) -> None:
    """Point to a committed version, with statistics beside it; the pointer before it stays as history.

    Publishing an older version again goes back to it. A pointer is a committed folder itself: one that was
    not written to its end is passed over.
    """
    if name not in versions(spark, path):
        raise FileNotFoundError(f"version {name} below {path} is missing or was not committed")
    taken = _listed(spark, f"{path.rstrip('/')}/{POINTER}", "version=")
    number = int(taken[-1]) + 1 if taken else 0
    facts = [F.lit(k) for pair in (stats or {}).items() for k in map(str, pair)]
    row = spark.range(1).select(F.lit(name).alias("version"), F.create_map(*facts).cast("map<string,string>").alias("stats"))
    row.coalesce(1).write.json(_folder(f"{path.rstrip('/')}/{POINTER}", f"{number:012d}"))


def published(spark: SparkSession, path: str) -> DataFrame:
    """(version, stats) of the pointer in use, the newest committed one; FileNotFoundError before the first."""
    base = f"{path.rstrip('/')}/{POINTER}"
    known = versions(spark, base)
    if not known:
        raise FileNotFoundError(f"nothing published below {path}")
    return spark.read.schema("version string, stats map<string,string>").json(_folder(base, known[-1]))


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the version in use."""
    return read_version(spark, path, published(spark, path).first()["version"])


def observed(df: DataFrame, **stats: Column) -> tuple[DataFrame, Observation]:
    """``df`` that computes aggregates of its rows as they pass; read ``Observation.get`` after the action.

    Apply it last, right before the write: there every row passes once, also if tasks are run again. Above a
    shuffle a lost executor may have rows pass twice.
    """
    seen = Observation()
    return df.observe(seen, *[c.alias(n) for n, c in stats.items()]), seen


def write_observed(df: DataFrame, path: str, **stats: Column) -> dict:
    """Write a table anew and return aggregates of the written rows, from the same pass."""
    rows, seen = observed(df, **stats)
    rows.write.mode("overwrite").parquet(path)
    return seen.get


def write_increment(df: DataFrame, path: str, key: dict[str, str | int], **stats: Column) -> dict:
    """Replace one increment of a table partitioned by ``key`` and return its row count ``n`` and ``stats``.

    ``df`` holds the increment without the key columns. Only the increment's partition is replaced, when the
    job commits; others stay. Running it again leaves the rows of one run, and a run without rows leaves
    none.
    """
    clash = {c.lower() for c in df.columns} & {k.lower() for k in key}
    if clash:
        raise ValueError(f"the increment has key columns: {sorted(clash)}")
    rows, seen = observed(df, n=F.count(F.lit(1)), **stats)
    keyed = rows.withColumns({k: F.lit(v) for k, v in key.items()})
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*key).parquet(path)
    facts = seen.get
    if not facts["n"]:
        # no row, so the write has touched no partition
        folder = "/".join([path.rstrip("/"), *[f"{k}={v}" for k, v in key.items()]])
        if _exists(df.sparkSession, folder):
            fs, p = _fs(df.sparkSession, folder)
            fs.delete(p, True)
    return facts


def to_rows(spark: SparkSession, facts: dict) -> DataFrame:
    """Statistics of a write as one row, for a side table; whole numbers are longs, also where the value is missing."""
    value = lambda v: F.lit(v).cast("bigint") if v is None or type(v) is int else F.lit(v)
    return spark.range(1).select(*[value(v).alias(k) for k, v in facts.items()])
