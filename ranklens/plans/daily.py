"""The daily job: wait for closed inputs, skip what is done, extract per country, merge, write, and build the training set."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklens.operators import aggregates
from ranklens.plans import extract
from ranklens.sources import logs, versions


def run_day(spark: SparkSession, root: str, cd: str, countries: dict[str, Callable[[], DataFrame]], ready: list[str], partitions: int) -> bool:
    """Feature rows of all countries of a day below ``root/cd=<day>``; False if the day was done already.

    ``countries`` gives a function per country that plans its rows; it is called only when every
    folder in ``ready`` carries its success marker. Countries are merged into one table, the rows of
    a user together.
    """
    path = f"{root.rstrip('/')}/cd={cd}"
    if logs.done(spark, path):
        return False
    logs.require_days(spark, ready)
    rows = [build().withColumn("country", F.lit(name)) for name, build in countries.items()]
    logs.write_by_user(logs.union_countries(rows), path, partitions)
    return True


def run_training(spark: SparkSession, root: str, end: str, n_days: int, rate: float, out: str) -> DataFrame:
    """Training set of the last ``n_days`` days that are done, written with its statistics beside it.

    The statistics are counted while the rows are written; the set is not read again.
    """
    base = root.rstrip("/")
    days = [d for d in logs._days(end, -n_days) if logs.done(spark, f"{base}/cd={d}")]
    if not days:
        raise FileNotFoundError(f"no finished day within {n_days} days before {end}")
    rows = spark.read.option("basePath", base).parquet(*[f"{base}/cd={d}" for d in days]).withColumn("cd", F.col("cd").cast("string"))
    picked = extract.training_set(rows, end, rate)
    tasks = [extract.EXPOSED, extract.RANDOM_WATCH]
    label = "click" if "click" in picked.columns else "label"
    facts = versions.write_observed(picked, out, **aggregates.task_counters(tasks, click=label))
    stats = spark.createDataFrame(aggregates.task_rows(facts, tasks), "task int, n long, post_click long, share double")
    logs.write_stats(stats, f"{out.rstrip('/')}_stats")
    return spark.read.schema(picked.schema).parquet(out)
