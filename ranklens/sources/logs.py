"""Dated log tables: scans, readiness checks, unions and sinks."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklens.session import scratch_path

ANONYMOUS_USER = "-1"
_STAGED: list[str] = []


def _fs(spark: SparkSession, path: str):
    """Hadoop file system and path object of a path, whatever its scheme."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _days(start: str, n: int) -> list[str]:
    first = dt.date.fromisoformat(start)
    step = 1 if n >= 0 else -1
    return [(first + dt.timedelta(days=step * i)).isoformat() for i in range(abs(n))]


def valid_users(df: DataFrame, col: str = "dw_p_id", anonymous: str = ANONYMOUS_USER) -> DataFrame:
    """Rows with a user id that is present, not blank and not the anonymous id."""
    return df.filter(F.col(col).isNotNull() & (F.col(col) != "") & (F.col(col) != anonymous))


def read_day(spark: SparkSession, table: str, cd: str, country: str | None = None) -> DataFrame:
    """One day (and country) of a table partitioned by country and cd, valid users only."""
    df = spark.read.option("mergeSchema", "false").parquet(table).filter(F.col("cd") == F.lit(cd).cast("date"))
    if country is not None:
        df = df.filter(F.col("country") == country)
    return valid_users(df)


def read_days(spark: SparkSession, table: str, end: str, n: int, backwards: bool = True) -> DataFrame:
    """n days ending at (or starting at) a date; the date filter prunes partitions."""
    days = sorted(_days(end, -n if backwards else n))
    df = spark.read.option("mergeSchema", "false").parquet(table)
    return df.filter(F.col("cd").between(F.lit(days[0]).cast("date"), F.lit(days[-1]).cast("date")))


def require_days(spark: SparkSession, paths: list[str]) -> None:
    """Fail when a day has not been closed by its success marker."""
    missing = [p for p in paths if not _exists(spark, f"{p.rstrip('/')}/_SUCCESS")]
    if missing:
        raise FileNotFoundError(f"days not ready: {missing}")


def done(spark: SparkSession, path: str) -> bool:
    """True when an output already carries its success marker and the job may be skipped."""
    return _exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def unmark(spark: SparkSession, path: str) -> None:
    """Take the success marker away, so that readers wait until the output is written again."""
    fs, p = _fs(spark, f"{path.rstrip('/')}/_SUCCESS")
    fs.delete(p, False)


def latest_partition(spark: SparkSession, table: str, date: str, look_back: int = 7) -> str | None:
    """Newest ``cd=`` partition on or before a date, within the look-back window."""
    for day in _days(date, -look_back):
        if _exists(spark, f"{table.rstrip('/')}/cd={day}"):
            return day
    return None


def by_user(df: DataFrame, partitions: int, key: str = "dw_p_id") -> DataFrame:
    """Rows of a user together, in about ``partitions`` parts.

    A rebalance, not a plain repartition: adaptive execution splits the part of a heavy user.
    """
    return df.hint("rebalance", partitions, F.col(key))


def union_countries(dfs: list[DataFrame], partitions: int | None = None, key: str = "dw_p_id") -> DataFrame:
    """Union by name; the optional repartition co-locates users for the jobs that follow."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
    return by_user(out, partitions, key) if partitions else out


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write an expensive input once and read it back for several extracts."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """``materialize`` below the cluster's shared folder: cuts the plan and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    _STAGED.append(path)
    return materialize(df, path)


def drop_staged(spark: SparkSession) -> int:
    """Delete the folders staged by this process, once the results built on them are written."""
    dropped = 0
    while _STAGED:
        fs, p = _fs(spark, _STAGED.pop())
        dropped += bool(fs.delete(p, True))
    return dropped


def write_by_user(df: DataFrame, path: str, partitions: int, key: str = "dw_p_id") -> None:
    by_user(df, partitions, key).write.mode("overwrite").parquet(path)


def write_csv1(df: DataFrame, path: str) -> None:
    """One CSV file with header; for reports whose row count is bounded by titles."""
    df.repartition(1).write.mode("overwrite").option("header", True).csv(path)


def write_stats(df: DataFrame, path: str) -> None:
    """Side table of run statistics as JSON lines."""
    df.write.mode("overwrite").json(path)


def current_version(df: DataFrame, col: str = "version") -> DataFrame:
    """Rows of the newest version, the table form of a pointer file."""
    return df.filter(F.col(col) == df.agg(F.max(col)).scalar())


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("header", header).csv(path)


def create_like(spark: SparkSession, table: str, like: str, location: str) -> None:
    spark.sql(f"CREATE TABLE {table} LIKE {like} USING PARQUET LOCATION '{location}'")


def insert_into(table: str, df: DataFrame) -> None:
    """Insert-select by column name."""
    target = df.sparkSession.table(table).columns
    df.select(*target).write.insertInto(table)
