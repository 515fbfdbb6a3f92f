"""Readiness checks, staging and partition lookup on small written tables."""

import pytest
from pyspark.sql import functions as F

from ranklens.sources import logs, packed


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log") / "table")
    rows = [(u, c, d, i) for i, (u, c, d) in enumerate([("a", "in", "2024-01-01"), ("-1", "in", "2024-01-01"), ("", "in", "2024-01-03"), (None, "in", "2024-01-03"), ("b", "my", "2024-01-05")])]
    spark.createDataFrame(rows, "dw_p_id string, country string, cd string, x int").write.partitionBy("country", "cd").parquet(path)
    return path


def test_read_day_drops_invalid_users(spark, table):
    assert [r["dw_p_id"] for r in logs.read_day(spark, table, "2024-01-01", "in").collect()] == ["a"]
    assert logs.read_day(spark, table, "2024-01-03", "in").count() == 0


def test_read_days_both_directions(spark, table):
    assert logs.read_days(spark, table, "2024-01-05", 3).count() == 3
    assert logs.read_days(spark, table, "2024-01-01", 3, backwards=False).count() == 4


def test_latest_partition_and_look_back(spark, table):
    assert logs.latest_partition(spark, f"{table}/country=in", "2024-01-09", 7) == "2024-01-03"
    assert logs.latest_partition(spark, f"{table}/country=in", "2024-01-09", 3) is None


def test_missing_day_fails(spark, table):
    logs.require_days(spark, [table])
    with pytest.raises(FileNotFoundError, match="nowhere"):
        logs.require_days(spark, [table, f"{table}-nowhere"])
    assert logs.done(spark, table) and not logs.done(spark, f"{table}-nowhere")


def test_heavy_user_is_kept_whole_over_several_files(spark, tmp_path):
    df = spark.range(20000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("dw_p_id"), "id")
    logs.write_by_user(df, str(tmp_path / "out"), 4)
    assert spark.read.parquet(str(tmp_path / "out")).distinct().count() == 20000


def test_staged_folders_can_be_dropped(spark):
    logs.drop_staged(spark)
    kept = logs.stage(spark.range(5).toDF("x"), "probe")
    assert kept.count() == 5
    assert logs.drop_staged(spark) == 1 and logs.drop_staged(spark) == 0


def test_empty_packed_values(spark):
    df = spark.createDataFrame([(1, 0, ""), (2, 0, "5,1"), (3, 0, "5,1,0.5,6")], "s int, l int, p string")
    assert [tuple(r) for r in packed.explode_packed_triples(df, "s", "l", "p").collect()] == [(3, 0, 5, 1, 0.5)]
    flat = spark.createDataFrame([([],), ([1, 2, 3, 4, 5, 9],), (None,)], "w array<bigint>")
    assert flat.select(F.size(packed.decode_watches(F.col("w"))).alias("n")).filter("n > 0").count() == 1


def test_unknown_tags_and_repeats(spark):
    df = spark.createDataFrame([("d", 1, 0, "dc", 1.0), ("d", 1, 0, "dc", 3.0), ("d", 2, 0, "zz", 1.0)], "day string, content_id int, language_id int, tag string, value double")
    assert [tuple(r)[1:5] for r in packed.pivot_popularity(df).collect()] == [(1, 0, 3.0, 0.0)]
