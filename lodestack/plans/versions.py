"""Queries on the version registry, presence and locks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.operators import versions
from lodestack.plans.registry import query
from lodestack.sources import tables

VERSIONS_SQL = """v AS (SELECT lang AS project, source AS asset, 'txt' AS representation, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS version_number,
                  doc_id, sha256(text) AS content_id, source || '/' || doc_id || '.txt' AS filename, strlen(text) AS size FROM documents)"""


@query(
    "register_next_version",
    f"""WITH {VERSIONS_SQL}, l AS (SELECT project, asset, max(version_number) AS latest FROM v WHERE doc_id % 4 <> 0 GROUP BY 1, 2)
    SELECT project, asset, doc_id, CAST(coalesce(latest, 0) + row_number() OVER (PARTITION BY project, asset ORDER BY doc_id) AS BIGINT) AS version_number FROM v LEFT JOIN l USING (project, asset) WHERE doc_id % 4 = 0""",
)
def register_next_version(spark, sf_dir):
    v = tables.versions(spark, sf_dir)
    asked = v.where("doc_id % 4 = 0").select(*versions.KEY, "content_id", F.lit(None).cast("int").alias("version"), F.col("doc_id").alias("seq"))
    out = versions.register(v.where("doc_id % 4 <> 0"), asked)
    return out.select("project", "asset", F.col("seq").alias("doc_id"), F.col("version_number").cast("long").alias("version_number"))


@query(
    "register_outcomes",
    f"""WITH RECURSIVE {VERSIONS_SQL}, s AS MATERIALIZED (SELECT DISTINCT content_id FROM v WHERE doc_id % 3 <> 0),
    q AS MATERIALIZED (SELECT project, asset, doc_id, content_id IN (SELECT content_id FROM s) AS found, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN version_number ELSE version_number + 3 END AS asked,
                 row_number() OVER (PARTITION BY project, asset ORDER BY doc_id) AS i FROM v),
    e AS MATERIALIZED (SELECT project, asset, list(version_number) AS taken FROM v WHERE version_number <= 3 GROUP BY 1, 2),
    r(project, asset, i, taken, doc_id, outcome, version_number) AS (
      SELECT project, asset, 0::BIGINT, taken, NULL::BIGINT, NULL::VARCHAR, NULL::BIGINT FROM e
      UNION ALL
      SELECT project, asset, i, CASE WHEN outcome = 'ok' THEN list_append(taken, number) ELSE taken END, doc_id, outcome, CASE WHEN outcome = 'ok' THEN number END FROM (
        SELECT r.project, r.asset, q.i, r.taken, q.doc_id, coalesce(q.asked, list_max(r.taken) + 1) AS number,
               CASE WHEN NOT q.found THEN 'content_not_found' WHEN q.asked IS NOT NULL AND list_contains(r.taken, q.asked) THEN 'version_conflict' ELSE 'ok' END AS outcome
        FROM r JOIN q ON q.project = r.project AND q.asset = r.asset AND q.i = r.i + 1))
    SELECT doc_id, outcome, version_number FROM r WHERE i > 0""",
)
def register_outcomes(spark, sf_dir):
    v = tables.versions(spark, sf_dir)
    k = F.col("doc_id") % 5
    asked = F.when(k == 1, F.col("version_number")).when(k > 1, F.col("version_number") + 3).cast("int")
    requests = v.select(*versions.KEY, "content_id", asked.alias("version"), F.col("doc_id").alias("seq"))
    out = versions.register(v.where("version_number <= 3"), requests, v.where("doc_id % 3 <> 0").select("content_id"))
    return out.select(F.col("seq").alias("doc_id"), "outcome", "version_number")


@query(
    "resolve_versions",
    f"""WITH {VERSIONS_SQL}, l AS (SELECT project, asset, arg_max(content_id, version_number) AS content_id, arg_max(filename, version_number) AS filename, arg_max(size, version_number) AS size FROM v GROUP BY 1, 2)
    SELECT project, asset, 'latest' AS version_spec, content_id, filename, size FROM l UNION ALL SELECT project, asset, CAST(version_number AS VARCHAR), content_id, filename, size FROM v WHERE doc_id % 5 = 0
    UNION ALL SELECT 'xx', 'none', 'latest', NULL, NULL, NULL""",
)
def resolve_versions(spark, sf_dir):
    v = tables.versions(spark, sf_dir)
    uri = lambda df, spec: df.select("project", "asset", spec.alias("version_spec"), "representation")
    none = spark.range(1).select(F.lit("xx").alias("project"), F.lit("none").alias("asset"), F.lit("latest").alias("version_spec"), F.lit("txt").alias("representation"))
    asked = uri(v, F.lit("latest")).distinct().union(uri(v.where("doc_id % 5 = 0"), F.col("version_number").cast("string"))).union(none)
    return versions.resolve(v, asked).drop("representation")


@query(
    "latest_content_dedup",
    f"""WITH {VERSIONS_SQL}, d AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN sha256(content_id) END AS dedup FROM v)
    SELECT project, asset, arg_max(content_id, version_number) AS delivery, coalesce(arg_max_null(dedup, version_number), arg_max(content_id, version_number)) AS dedup FROM d GROUP BY 1, 2""",
)
def latest_content_dedup(spark, sf_dir):
    v = tables.versions(spark, sf_dir).withColumn("dedup_content_id", F.when(F.col("doc_id") % 2 == 0, F.sha2("content_id", 256)))
    two = versions.latest_content(v).withColumnRenamed("content_id", "delivery").join(versions.latest_content(v, "dedup").withColumnRenamed("content_id", "dedup"), list(versions.KEY))
    return two.select("project", "asset", "delivery", "dedup")


def _events(spark, sf_dir):
    return tables.read(spark, sf_dir, "events")


@query("presence_sessions", "SELECT user_id, event_type AS session_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def presence_sessions(spark, sf_dir):
    return versions.sessions(_events(spark, sf_dir).select("user_id", F.col("event_type").alias("session_id"), "event_id", "value", "ts")).select("user_id", "session_id", "event_id", "value")


LOCKS_SQL = """q AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lock_key ORDER BY ts, event_id) AS i FROM (SELECT {key} AS lock_key, ts, event_id, user_id, event_id % 3 <> 0 AS acquires FROM events)),
    r(lock_key, i, event_id, before, outcome, holder) AS (
      SELECT DISTINCT lock_key, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::BIGINT FROM q
      UNION ALL
      SELECT q.lock_key, q.i, q.event_id, r.holder,
             CASE WHEN acquires THEN CASE WHEN r.holder <> user_id THEN 'held_by_other' ELSE 'acquired' END WHEN r.holder IS NULL THEN 'not_found' WHEN r.holder <> user_id THEN 'not_owner' ELSE 'released' END,
             CASE WHEN r.holder <> user_id THEN r.holder WHEN acquires THEN user_id END
      FROM r JOIN q ON q.lock_key = r.lock_key AND q.i = r.i + 1)"""


def _lock_requests(spark, sf_dir, key):
    return _events(spark, sf_dir).select(key.alias("lock_key"), "user_id", F.when(F.col("event_id") % 3 == 0, "release").otherwise("acquire").alias("action"), "ts", "event_id")


@query("lock_conflicts", f"WITH RECURSIVE {LOCKS_SQL.format(key="event_type || '/' || (user_id % 7)")} SELECT event_id, before AS holder, outcome FROM r WHERE i > 0")
def lock_conflicts(spark, sf_dir):
    key = F.concat_ws("/", "event_type", (F.col("user_id") % 7).cast("string"))
    return versions.lock_requests(_lock_requests(spark, sf_dir, key)).select("event_id", "holder", "outcome")


@query("lock_status", f"WITH RECURSIVE {LOCKS_SQL.format(key='event_type')} SELECT lock_key, arg_max_null(holder, i) AS holder, max(event_id) FILTER (i = n) AS last FROM (SELECT *, max(i) OVER (PARTITION BY lock_key) AS n FROM r WHERE i > 0) GROUP BY lock_key")
def lock_status(spark, sf_dir):
    return versions.lock_holders(_lock_requests(spark, sf_dir, F.col("event_type")))
