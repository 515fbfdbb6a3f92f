"""The derived tables have the same rows in Spark and in SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from ranklens.plans import domain
from ranklens.plans.registry import with_domain

SF = "/root/testdata/sf0.001"
SUMS = {
    "log": "k + content_id + watch_time + timestamp + language", "impressions": "timestamp + tile_position", "daily": "watch_time + first_watch_ts + content_id",
    "history": "watch_len + first_watch + content_id", "curve_watches": "watch_time + first_watch_ts + content_id + language", "scored": "timestamp + content_id + label + click",
    "rel": "src + src_lang + dst + dst_lang", "catalog": "content_type_id + studio_id + parental_rating + year + start_dt + last_broadcast + priority", "ns_watches": "content_id + watch_len",
    "videos": "content_id + content_type_id + duration", "view_log": "cast(watch_minutes as bigint)", "acts": "vec_id + content_id + item + day + click", "tags": "content_id",
}


@pytest.mark.parametrize("name", sorted(SUMS))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("events", "part", "lineitem", "orders", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(with_domain(f"SELECT count(*), CAST(sum({SUMS[name]}) AS BIGINT) FROM {name}")).fetchone()
    got = getattr(domain.tables(spark, SF), name).agg(F.count(F.lit(1)), F.sum(F.expr(SUMS[name])).cast("bigint")).first()
    assert tuple(got) == want and want[0] > 0
