"""Committed versions, the published pointer, replaced increments, counts in the writing pass, tables by user."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ranklens.operators import aggregates
from ranklens.sources import bucketed, logs, versions
from ranklens.streaming import incremental


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def _broken(spark, n=100):
    """Rows whose last partition fails while they are written."""

    def run(batches):
        for b in batches:
            if (b["id"] == n - 1).any():
                raise ValueError("half way")
            yield b

    return spark.range(0, n, 1, 4).mapInPandas(run, "id long")


def test_a_half_written_version_is_not_read(spark, tmp_path):
    path = str(tmp_path / "state")
    versions.write_version(spark.range(3), path, "1")
    with pytest.raises(Exception, match="half way"):
        versions.write_version(_broken(spark), path, "2")
    assert versions.versions(spark, path) == ["1"]
    assert versions.read_version(spark, path).count() == 3
    with pytest.raises(FileNotFoundError):
        versions.read_version(spark, path, "2")
    versions.write_version(spark.range(7), path, "2")
    assert versions.versions(spark, path) == ["1", "2"] and versions.read_version(spark, path).count() == 7


def test_files_without_a_marker_do_not_count(spark, tmp_path):
    path = str(tmp_path / "state")
    for name, n in (("9", 1), ("10", 2), ("2024-01-31", 3)):
        versions.write_version(spark.range(n), path, name)
    assert versions.versions(spark, path) == ["9", "10", "2024-01-31"]
    logs.unmark(spark, f"{path}/version=2024-01-31")
    assert versions.read_version(spark, path).count() == 2
    with pytest.raises(FileNotFoundError):
        versions.read_version(spark, str(tmp_path / "nowhere"))


def test_state_of_a_failed_day_is_passed_over(spark, tmp_path):
    path = str(tmp_path / "bandit")
    act = spark.createDataFrame([([1.0, 0.0], 1), ([0.0, 1.0], 0)], "h array<double>, click int")
    incremental.next_state(spark, path, act, "0", None, 2)
    incremental.next_state(spark, path, act, "1", "0", 2)
    logs.unmark(spark, f"{path}/version=1")
    first = _rows(incremental.stored_state(spark, path))
    assert first == _rows(incremental.stored_state(spark, path, "0"))
    with pytest.raises(FileNotFoundError):
        incremental.next_state(spark, path, act, "2", "1", 2)
    incremental.next_state(spark, path, act, "1", "0", 2)
    assert _rows(incremental.stored_state(spark, path)) != first


def test_pointer(spark, tmp_path):
    path = str(tmp_path / "model")
    with pytest.raises(FileNotFoundError):
        versions.published(spark, path)
    for name, n in (("a", 1), ("b", 2)):
        versions.write_version(spark.range(n), path, name)
        versions.publish(spark, path, name, {"rows": n})
    assert versions.read_published(spark, path).count() == 2
    assert versions.published(spark, path).first()["stats"] == {"rows": "2"}
    with pytest.raises(FileNotFoundError):
        versions.publish(spark, path, "c")
    versions.publish(spark, path, "a")
    assert versions.read_published(spark, path).count() == 1
    logs.unmark(spark, f"{path}/_pointer/version=000000000002")
    assert versions.read_published(spark, path).count() == 2
    versions.publish(spark, path, "a")
    assert versions.versions(spark, f"{path}/_pointer")[-1] == "000000000003"


def test_an_increment_run_again_replaces_its_rows_only(spark, tmp_path):
    path = str(tmp_path / "horizons")
    for h, n in ((1, 5), (7, 3), (1, 4)):
        facts = versions.write_increment(spark.range(n), path, {"horizon": h}, top=F.max("id"))
        assert facts == {"n": n, "top": n - 1}
    assert _rows(spark.read.parquet(path).groupBy("horizon").count()) == [(1, 4), (7, 3)]
    with pytest.raises(Exception, match="half way"):
        versions.write_increment(_broken(spark), path, {"horizon": 7})
    assert _rows(spark.read.parquet(path).groupBy("horizon").count()) == [(1, 4), (7, 3)]
    assert versions.write_increment(spark.range(0), path, {"horizon": 7})["n"] == 0
    assert _rows(spark.read.parquet(path).groupBy("horizon").count()) == [(1, 4)]
    with pytest.raises(ValueError, match="horizon"):
        versions.write_increment(spark.range(1).withColumn("Horizon", F.lit(1)), path, {"horizon": 1})


def test_counts_of_the_writing_pass(spark, tmp_path):
    df = spark.createDataFrame([(0, 1), (0, 0), (1, 1), (0, None)], "task int, click int")
    facts = versions.write_observed(df, str(tmp_path / "out"), **aggregates.task_counters([0, 1, 2]))
    assert aggregates.task_rows(facts, [0, 1, 2]) == [(0, 3, 1, 0.75), (1, 1, 1, 0.25)]
    want = _rows(aggregates.task_stats(df).select("task", "n", "post_click", "share"))
    assert sorted(aggregates.task_rows(facts, [0, 1, 2])) == want
    counts = spark.createDataFrame([("a", 1, None), ("b", None, None), ("c", 2, 3)], "dw_p_id string, x int, y int")
    seen = versions.write_observed(counts, str(tmp_path / "counts"), **aggregates.example_counters(["x", "y"]))
    assert seen == aggregates.example_stats(counts, ["x", "y"]).first().asDict()


RETRY = """
import sys
from pyspark.sql import SparkSession, functions as F
from ranklens.sources import versions
spark = (SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
spark.sparkContext.setLogLevel("OFF")
marker = sys.argv[2]

def fails_once(batches):
    import os
    from pyspark import TaskContext
    for b in batches:
        yield b
    if TaskContext.get().partitionId() == 1 and not os.path.exists(marker):
        open(marker, "w").close()
        raise ValueError("first attempt")

rows = spark.range(0, 1000, 1, 4).mapInPandas(fails_once, "id long")
facts = versions.write_observed(rows, sys.argv[1], n=F.count(F.lit(1)), total=F.sum("id"))
print("FACTS", facts["n"], facts["total"], spark.read.parquet(sys.argv[1]).count())
"""


def test_a_task_that_runs_again_is_counted_once(tmp_path):
    marker = tmp_path / "failed"
    out = subprocess.run([sys.executable, "-c", RETRY, str(tmp_path / "out"), str(marker)], capture_output=True, text=True,
                         cwd=Path(__file__).resolve().parents[1], timeout=300)
    assert marker.exists() and "FACTS 1000 499500 1000" in out.stdout, out.stderr[-2000:]


@pytest.fixture(scope="module")
def by_user(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("by-user")
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 101 == 1, None).otherwise((F.col("id") % 50).cast("string")).alias("dw_p_id"), F.col("id").alias("x"))
    facts = spark.range(0, 80, 2).select(F.when(F.col("id") == 0, "hot").otherwise(F.col("id").cast("string")).alias("dw_p_id"), (F.col("id") * 10).alias("y"))
    heavy = logs.stage(bucketed.heavy_users(rows, 200), "heavy")
    bucketed.write_bucketed(rows, "bu_rows", str(base / "rows"), 4, heavy)
    bucketed.write_bucketed(facts, "bu_facts", str(base / "facts"), 4, heavy, lookup=True)
    yield rows, facts, heavy
    for t in ("bu_rows", "bu_facts"):
        spark.sql(f"DROP TABLE {t}")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_user_joins_move_no_rows(spark, by_user, how):
    rows, facts, _ = by_user
    joined = bucketed.join_users(spark.table("bu_rows"), spark.table("bu_facts"), how)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(tuple, joined.collect()), key=key) == sorted(map(tuple, rows.join(facts, "dw_p_id", how).collect()), key=key)


def test_a_heavy_user_is_in_several_buckets(spark, by_user):
    _, _, heavy = by_user
    assert [tuple(r) for r in heavy.collect()] == [("hot", 5)]
    files = spark.table("bu_rows").filter("dw_p_id = 'hot'").groupBy(F.input_file_name()).count().collect()
    assert len(files) > 1 and max(r[1] for r in files) < 1000
    with pytest.raises(ValueError):
        bucketed.join_users(spark.table("bu_rows"), spark.table("bu_facts"), "full")
