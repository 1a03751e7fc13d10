"""Streams over files, against what the same rows give at once."""

from pyspark.sql import functions as F

from lodestack.sources import tables
from lodestack.streaming import presence

SF = "/root/testdata/sf0.001"


def source(spark, tmp_path):
    rows = tables.read(spark, SF, "events").select("event_id", "user_id", F.col("event_type").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"))
    rows = rows.withColumn("lock_key", F.col("session_id")).withColumn("action", F.when(F.col("event_id") % 3 == 0, "release").otherwise("acquire"))
    rows.write.parquet(str(tmp_path / "in"))
    return rows, spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))


def drained(stream, tmp_path, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_lock_stream_follows_each_holder(spark, tmp_path):
    rows, stream = source(spark, tmp_path)
    got = {r.event_id: r.outcome for r in drained(presence.lock_outcomes(stream), tmp_path, "locks").collect()}
    holder, want = {}, {}
    for r in rows.orderBy("ts", "event_id").collect():
        h = holder.get(r.lock_key)
        if r.action == "acquire":
            want[r.event_id] = "held_by_other" if h not in (None, r.user_id) else "acquired"
            holder[r.lock_key] = r.user_id if h is None else h
        else:
            want[r.event_id] = "not_found" if h is None else "released" if h == r.user_id else "not_owner"
            holder[r.lock_key] = None if h == r.user_id else h
    assert got == want


def test_heartbeat_streams(spark, tmp_path):
    rows, stream = source(spark, tmp_path)
    assert drained(presence.distinct_heartbeats(stream), tmp_path, "beats").count() == rows.count()
    runs = drained(presence.session_windows(stream, "1 day"), tmp_path, "runs", "complete")
    assert runs.agg(F.sum("n")).first()[0] == rows.count()
