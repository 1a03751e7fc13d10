"""Queries on the documents that hosts exchange, and on what their dialogs list."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions import context, errors, manifests
from lodestack.operators import catalog
from lodestack.plans.registry import query
from lodestack.sources import tables


def _customers(spark, sf_dir):
    return tables.read(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey") % 5)


def _context_text():
    key = F.col("c_custkey").cast("string")
    full = F.concat(F.lit('{"intent":"open","dcc":"maya","project_id":"'), key, F.lit('","version_spec":{"version":"7"}}'))
    return F.when(F.col("k") == 0, "").when(F.col("k") == 1, "[1]").when(F.col("k") == 2, '{"intent":"open"}').when(F.col("k") == 3, full)


@query("launch_context", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 3 THEN CAST(c_custkey AS VARCHAR) END AS project_id, CASE WHEN c_custkey % 5 = 3 THEN 'maya' END AS dcc FROM customer")
def launch_context(spark, sf_dir):
    rows = _customers(spark, sf_dir).select("c_custkey", context.launch_context(_context_text()).alias("c"))
    return rows.select("c_custkey", "c.project_id", "c.dcc")


@query(
    "launch_context_lenient",
    """SELECT c_custkey, CASE c_custkey % 5 WHEN 2 THEN '' WHEN 3 THEN CAST(c_custkey AS VARCHAR) END AS project_id, CASE c_custkey % 5 WHEN 2 THEN 'blender' WHEN 3 THEN 'maya' END AS dcc,
       CASE c_custkey % 5 WHEN 2 THEN '1' WHEN 3 THEN '7' END AS version FROM customer""",
)
def launch_context_lenient(spark, sf_dir):
    rows = _customers(spark, sf_dir).select("c_custkey", context.lenient_context(_context_text()).alias("c"))
    return rows.select("c_custkey", "c.project_id", "c.dcc", "c.version")


@query("url_join", "SELECT c_custkey, 'http://host/api/v' || c_custkey AS url FROM customer")
def url_join(spark, sf_dir):
    base = F.when(F.col("k") < 2, "http://host/api//").otherwise("http://host/api")
    path = F.concat(F.when(F.col("k") % 2 == 0, "/v").otherwise("v"), F.col("c_custkey").cast("string"))
    return _customers(spark, sf_dir).select("c_custkey", context.joined_url(base, path).alias("url"))


@query(
    "error_detail",
    """SELECT c_custkey, CASE WHEN c_custkey % 35 = 33 THEN '{"detail":[{"msg":"x"}]}' WHEN c_custkey % 35 = 34 THEN ' {"detail":42} ' WHEN c_custkey % 5 = 0 THEN c_name WHEN c_custkey % 5 = 1 THEN 'plain' WHEN c_custkey % 5 = 2 THEN ' ' ELSE 'Reason' END AS detail FROM customer""",
)
def error_detail(spark, sf_dir):
    body = F.when(F.col("k") == 0, F.concat(F.lit('{"detail":"'), "c_name", F.lit('"}'))).when(F.col("k") == 1, "plain").when(F.col("k") == 2, " ")
    odd = F.col("c_custkey") % 35
    body = F.when(odd == 33, '{"detail":[{"msg":"x"}]}').when(odd == 34, ' {"detail":42} ').otherwise(body)
    return _customers(spark, sf_dir).select("c_custkey", errors.detail_of(body, F.lit("Reason")).alias("detail"))


@query("issue_payload", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'title_required' WHEN c_custkey % 5 = 1 THEN 'project_required' END AS problem, CASE WHEN c_custkey % 5 = 2 THEN NULL ELSE c_name END AS asset_code FROM customer")
def issue_payload(spark, sf_dir):
    title, project, asset = (F.when(F.col("k") == i, "  ").otherwise(F.col("c_name")) for i in range(3))
    return _customers(spark, sf_dir).select("c_custkey", context.issue_problem(title, project).alias("problem"), catalog.filled(asset).alias("asset_code"))


@query("publish_validation", "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'project_required' WHEN 1 THEN 'asset_required' WHEN 2 THEN 'unknown_stage' WHEN 3 THEN 'file_missing' END AS problem FROM customer")
def publish_validation(spark, sf_dir):
    project, asset = (F.when(F.col("k") == i, " ").otherwise("x") for i in range(2))
    stage, path = F.when(F.col("k") == 2, "animation").otherwise(" Rigging "), F.when(F.col("k") == 3, "").otherwise("f.blend")
    return _customers(spark, sf_dir).select("c_custkey", context.publish_problem(project, asset, stage, path).alias("problem"))


@query("heartbeat_defaults", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'blender_user' ELSE c_name END AS user_id, CASE WHEN c_custkey % 5 = 1 THEN 's' || c_custkey ELSE 'own' END AS session_id, CASE WHEN c_custkey % 5 = 2 THEN 'blend' ELSE 'ma' END AS representation FROM customer")
def heartbeat_defaults(spark, sf_dir):
    k, fresh = F.col("k"), F.concat(F.lit("s"), F.col("c_custkey").cast("string"))
    beat = context.heartbeat(F.when(k != 0, F.col("c_name")), F.when(k == 1, " ").otherwise("own"), F.when(k != 2, "ma"), fresh)
    return _customers(spark, sf_dir).select("c_custkey", beat.alias("b")).select("c_custkey", "b.*")


@query("theme_template", "SELECT c_custkey, 'color: ' || c_mktsegment || '; pad: ' || c_custkey || '; {other}' AS sheet FROM customer")
def theme_template(spark, sf_dir):
    tokens = F.create_map(F.lit("color.fg"), F.col("c_mktsegment"), F.lit("pad"), F.col("c_custkey").cast("string"))
    return _customers(spark, sf_dir).select("c_custkey", context.themed(F.lit("color: {color.fg}; pad: {pad}; {other}"), tokens).alias("sheet"))


@query(
    "load_route",
    "SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'hit' WHEN doc_id % 6 = 1 OR strlen(text) > 2000 THEN 'large' WHEN doc_id % 6 = 2 THEN 'manifest' ELSE 'small' END AS route FROM documents",
)
def load_route(spark, sf_dir):
    k = F.col("doc_id") % 6
    size = F.when(k != 1, F.col("size"))
    text = F.when(k == 2, F.lit(f'{{"schema":"{manifests.SCHEMA_PREFIX}.v2","chunks":[]}}')).otherwise(F.decode("body", "UTF-8"))
    return tables.blobs(spark, sf_dir).select("doc_id", context.load_route(k == 0, size, manifests.problem(text).isNull(), 2000).alias("route"))


@query(
    "task_options",
    """WITH t AS (SELECT o_orderkey AS id, 'Task ' || o_orderkey AS title, lower(o_orderpriority) AS stage, o_orderstatus AS status FROM orders WHERE o_orderkey % 9 <> 0)
       SELECT id, title FROM t WHERE contains(lower(title || ' ' || stage || ' ' || status), 'urgent')""",
)
def task_options(spark, sf_dir):
    rows = tables.read(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderkey")).alias("id"), F.concat(F.lit("Task "), F.col("o_orderkey").cast("string")).alias("title"), F.lower("o_orderpriority").alias("stage"), F.col("o_orderstatus").alias("status"))
    hay = rows.where("id is not null").withColumn("hay", F.concat_ws(" ", "title", "stage", "status"))
    return catalog.filter_assets(hay, "Urgent", ("hay",)).select("id", "title")


@query(
    "sanitized_selection",
    """WITH a AS (SELECT c_nationkey AS project_id, min(c_name) AS first, max(c_name) AS last FROM customer GROUP BY 1)
       SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN last ELSE first END AS asset_code, CASE WHEN n_nationkey % 3 = 0 THEN 'latest' ELSE '4' END AS version FROM nation JOIN a ON project_id = n_nationkey""",
)
def sanitized_selection(spark, sf_dir):
    codes = tables.assets(spark, sf_dir).groupBy("project_id").agg(F.min("code").alias("first"), F.max("code").alias("last"))
    wanted = tables.read(spark, sf_dir, "nation").join(codes, F.col("n_nationkey") == F.col("project_id")).withColumn("asked", F.when(F.col("n_nationkey") % 2 == 0, F.col("last")).otherwise("gone"))
    known = tables.assets(spark, sf_dir).select(F.col("project_id").alias("_p"), F.col("code").alias("_code"))
    found = wanted.join(known, (F.col("_p") == F.col("project_id")) & (F.col("_code") == F.col("asked")), "left")
    version = F.coalesce(catalog.filled(F.when(F.col("n_nationkey") % 3 == 0, " ").otherwise("4")), F.lit("latest"))
    return found.select("n_nationkey", F.coalesce("_code", "first").alias("asset_code"), version.alias("version"))


@query("navigator_items", "SELECT c_custkey, c_name || '  ' || c_mktsegment AS label FROM customer WHERE c_nationkey = 3 UNION ALL SELECT -1, '(no assets)' WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = 3)")
def navigator_items(spark, sf_dir):
    rows = tables.assets(spark, sf_dir).where("project_id = 3").select(F.col("id").alias("c_custkey"), F.concat_ws("  ", "code", "type").alias("label"))
    some = rows.limit(1).select(F.lit(1).alias("some"))
    none = spark.range(1).join(some, F.lit(1) == F.col("some"), "left_anti").select(F.lit(-1).cast("long").alias("c_custkey"), F.lit("(no assets)").alias("label"))
    return rows.union(none)


@query("active_users", "SELECT s_suppkey AS id, s_name AS username FROM supplier WHERE s_acctbal > 0")
def active_users(spark, sf_dir):
    users = tables.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("username"), (F.col("s_acctbal") > 0).alias("is_active"))
    return catalog.list_rows(users, is_active=True).select("id", "username")
