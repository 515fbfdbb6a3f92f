"""Helpers shared by the operators: table reads, staged tables, column-name hygiene."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklens.session import scratch_path
from ranklens.sources.logs import _STAGED


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write below the cluster's shared folder and read back: cuts lineage, survives lost executors.

    ``logs.drop_staged`` deletes what is left once a job's results are written.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    _STAGED.append(path)
    return out


def drop(df: DataFrame) -> None:
    """Delete what ``stage`` wrote for this frame, when no later step reads it."""
    path = getattr(df, "_staged_at", None)
    if path in _STAGED:
        _STAGED.remove(path)
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free_name(df: DataFrame, want: str) -> str:
    """A column name that the frame does not use (compared without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while want.lower() in taken:
        want = f"{want}_"
    return want


def fold(doc_id, n: int):
    """crc32 of the id written as text, modulo n (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n
