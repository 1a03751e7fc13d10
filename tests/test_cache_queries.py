"""The cache's index against its SQL on events at the edges of seconds and with missing fields."""

import datetime

import duckdb
import pytest

from lodestack.operators import cache
from lodestack.plans import catalogue

KINDS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def moment(micros):
    return datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=micros)


def against_sql(spark, folder, name, rows):
    spark.createDataFrame(rows, KINDS).coalesce(1).write.parquet(f"{folder}/events.parquet")
    got = catalogue.QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalogue.ORACLES[name]})").fetchall()
    return sorted(map(tuple, got.collect()), key=repr), sorted(want, key=repr)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_seconds_come_from_rounded_milliseconds(spark, tmp_path, zone):
    base = 1_704_067_200_000_000
    edges = [base + x for x in (0, 999_499, 999_500, 999_501, 1_000_000)] + [-499, -500, -501, -999_499, -999_500, -1_999_499, -1_999_500]
    rows = [(k, moment(m), k, "view", 1.5, "") for k, m in enumerate(edges)]
    rows += [(20, None, 20, "view", 2.0, ""), (-1, moment(base), 21, "view", 3.0, ""), (-2, moment(base), 21, "view", 4.0, ""), (None, moment(base + 5_000_000), 21, "view", 5.0, "")]
    rows += [(30, moment(base), None, "view", 6.0, ""), (31, moment(base), 22, None, None, "")]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        got, want = against_sql(spark, tmp_path, "cache_index_upsert", rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == want and len(got) == len(edges) + 3


@pytest.mark.parametrize("last", ["click", "view", None])
def test_touch_and_delete_at_edges(spark, tmp_path, last):
    base = 1_704_067_200_000_000
    rows = [(k, moment(base + k * 1_000_000 + 999_500), k % 6, ("view", "click", "error")[k % 3], 1.0, "") for k in range(40)]
    rows += [(100, moment(base), None, "error", 2.0, ""), (101, moment(base + 9_000_000), None, last, 3.0, ""), (105, None, 7, "view", 4.0, "")]
    got, want = against_sql(spark, tmp_path, "cache_touch_delete", rows)
    assert got == want and len(got) > 3


def test_new_writes_win_whatever_their_number(spark):
    kinds = "content_id string, filename string, rel_path string, size_bytes long, last_accessed_at long, seq long"
    index = cache.upsert(None, spark.createDataFrame([("a", "f", "r", 1, 50, 7), ("b", "f", "r", 1, 50, 7)], kinds))
    new = cache.upsert(index, spark.createDataFrame([("a", "g", "r", 2, 40, None), ("b", "g", "r", 2, 40, -5)], kinds))
    assert sorted((r.content_id, r.size_bytes, r.last_accessed_at, r.created_at) for r in new.collect()) == [("a", 2, 40, 40), ("b", 2, 40, 40)]
