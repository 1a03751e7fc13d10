"""Catalogue queries: projects, assets, version groups, tasks and addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions.uris import asset_uri, parsed_uri, restore_path
from lodestack.operators import catalog
from lodestack.plans.registry import query
from lodestack.sources import tables

GROUPS_SQL = """g AS (SELECT o_custkey AS asset_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version_number,
                      lower(o_orderpriority) AS stage, o_orderstatus AS representation FROM orders)"""
STAGE = "2-high"


@query("asset_uri_roundtrip", "SELECT doc_id, 'asset://' || lang || '/' || source || '/' || (CASE WHEN doc_id % 3 = 0 THEN 'latest' ELSE CAST(doc_id AS VARCHAR) END) || '/txt' AS uri, lang AS project, source AS asset, CASE WHEN doc_id % 3 = 0 THEN 'latest' ELSE CAST(doc_id AS VARCHAR) END AS version_spec, 'txt' AS representation FROM documents")
def asset_uri_roundtrip(spark, sf_dir):
    docs = tables.read(spark, sf_dir, "documents")
    spec = F.when(F.col("doc_id") % 3 == 0, "latest").otherwise(F.col("doc_id").cast("string"))
    return docs.select("doc_id", asset_uri("lang", "source", spec, F.lit("txt")).alias("uri")).withColumn("p", parsed_uri("uri")).select("doc_id", "uri", "p.*")


@query("project_enum_codec", "SELECT n_nationkey AS id, n_name AS name, n_nationkey || '|' || n_name AS enum_value, CAST(n_nationkey AS VARCHAR) AS decoded_id, n_name AS decoded_code FROM nation")
def project_enum_codec(spark, sf_dir):
    rows = catalog.project_rows(tables.projects(spark, sf_dir)).withColumn("d", catalog.decoded_enum("enum_value"))
    return rows.select("id", "name", "enum_value", F.col("d.id").alias("decoded_id"), F.col("d.code").alias("decoded_code"))


@query("filter_assets", "SELECT c_custkey AS id, c_name AS code, c_mktsegment AS type FROM customer WHERE contains(lower(c_name), 'build') OR contains(lower(c_mktsegment), 'build')")
def filter_assets(spark, sf_dir):
    return catalog.filter_assets(tables.assets(spark, sf_dir), " BUILD ").select("id", "code", "type")


@query("list_assets_of_project", "SELECT c_custkey AS id, c_name AS code FROM customer WHERE c_nationkey = 7 AND c_mktsegment = 'BUILDING'")
def list_assets_of_project(spark, sf_dir):
    return catalog.list_rows(tables.assets(spark, sf_dir), project_id=7, type="BUILDING", code=None).select("id", "code")


def _palette_sql(where: str) -> str:
    return f"""
    WITH {GROUPS_SQL}, f AS (SELECT c_custkey AS id, c_name AS code, c_nationkey AS project_id FROM customer WHERE {where}),
    p AS (SELECT project_id, count(*) AS n_assets, min(code) AS asset_code, array_to_string(list_slice(list_sort(list(code)), 1, 8), ',') AS codes FROM f GROUP BY 1)
    SELECT p.project_id, n_assets, asset_code, codes, coalesce((SELECT array_to_string(list_slice(list(version_number ORDER BY version_number DESC), 1, 12), ',') FROM g WHERE g.asset_id = f.id), '') AS versions
    FROM p JOIN f ON f.project_id = p.project_id AND f.code = p.asset_code"""


@query("palette_refresh", _palette_sql("contains(lower(c_name), 'auto') OR contains(lower(c_mktsegment), 'auto')"))
def palette_refresh(spark, sf_dir):
    return catalog.palette(tables.assets(spark, sf_dir), tables.groups(spark, sf_dir), "auto")


@query("palette_refresh_cached", _palette_sql("contains(lower(c_name), '1')"))
def palette_refresh_cached(spark, sf_dir):
    return catalog.palette(tables.assets(spark, sf_dir), tables.groups(spark, sf_dir), "1", ("code", "name"))


@query(
    "launch_hint_match",
    """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE n_nationkey || '|' || n_name END AS enum_value, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE n_name END AS default_project
       FROM customer JOIN nation ON n_nationkey = c_nationkey""",
)
def launch_hint_match(spark, sf_dir):
    listed = catalog.project_rows(tables.projects(spark, sf_dir)).select("enum_value", "code", F.col("id").cast("string").alias("pid"))
    doc = F.when(F.col("c_custkey") % 4 == 0, '{"intent":"open"}').otherwise(F.concat(F.lit('{"intent":"open","dcc":"maya","project_id":"'), F.col("c_nationkey").cast("string"), F.lit('"}')))
    hints = tables.read(spark, sf_dir, "customer").select("c_custkey", F.from_json(doc, "intent string, dcc string, project_id string").alias("h"))
    complete = F.when(F.col("h.intent").isNotNull() & F.col("h.dcc").isNotNull(), F.col("h.project_id"))
    joined = hints.select("c_custkey", complete.alias("pid")).join(F.broadcast(listed), "pid", "left")  # nations: 25 rows
    return joined.select("c_custkey", "enum_value", F.coalesce("code", F.lit("")).alias("default_project"))


@query("distinct_stages", f"WITH {GROUPS_SQL} SELECT asset_id, array_to_string(list_sort(list(DISTINCT stage)), ',') AS stages FROM g GROUP BY 1")
def distinct_stages(spark, sf_dir):
    return catalog.distinct_stages(tables.groups(spark, sf_dir)).select("asset_id", F.array_join("stages", ",").alias("stages"))


@query("distinct_versions_by_stage", f"WITH {GROUPS_SQL} SELECT DISTINCT asset_id, version_number, printf('v%03d', version_number) AS label FROM g WHERE stage = '' OR stage = '{STAGE}'")
def distinct_versions_by_stage(spark, sf_dir):
    return catalog.distinct_versions(tables.groups(spark, sf_dir), STAGE)


@query(
    "distinct_representations",
    f"""WITH {GROUPS_SQL} SELECT asset_id, version_number, coalesce(nullif(array_to_string(list_sort(list(DISTINCT representation) FILTER (stage = '{STAGE}' AND representation <> '')), ','), ''), 'blend') AS representations FROM g GROUP BY 1, 2""",
)
def distinct_representations(spark, sf_dir):
    return catalog.distinct_representations(tables.groups(spark, sf_dir), STAGE).select("asset_id", "version_number", F.array_join("representations", ",").alias("representations"))


@query("asset_version_fanout", f"WITH {GROUPS_SQL} SELECT c_custkey AS id, count(asset_id) AS n_groups, max(version_number) AS latest FROM customer LEFT JOIN g ON asset_id = c_custkey GROUP BY 1")
def asset_version_fanout(spark, sf_dir):
    return catalog.version_fanout(tables.assets(spark, sf_dir), tables.groups(spark, sf_dir)).select("id", "n_groups", "latest")


@query("version_switch_rep", f"WITH {GROUPS_SQL} SELECT asset_id, coalesce(arg_min(representation, version_number) FILTER (stage = '{STAGE}' AND representation <> ''), 'blend') AS representation FROM g GROUP BY 1")
def version_switch_rep(spark, sf_dir):
    return catalog.switch_representation(tables.groups(spark, sf_dir), STAGE)


def _tasks(spark, sf_dir):
    with_suppliers = tables.read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("collaborators"))
    orders = tables.read(spark, sf_dir, "orders")
    return orders.join(with_suppliers, orders.o_orderkey == with_suppliers.l_orderkey, "left").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("assignee_id"), "collaborators")


@query(
    "my_tasks",
    """WITH u AS (SELECT s_suppkey AS id FROM supplier WHERE lower(s_name) = (SELECT lower(s_name) FROM supplier WHERE s_suppkey = 3))
       SELECT o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT id FROM u) OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey IN (SELECT id FROM u))""",
)
def my_tasks(spark, sf_dir):
    users = tables.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("username"), F.col("s_name").alias("name"))
    name = users.where("id = 3").select(F.concat(F.lit(" "), F.upper("username"), F.lit(" "))).scalar()  # null, so no tasks, without that user
    return catalog.my_tasks(_tasks(spark, sf_dir), users, name).select("id")


@query(
    "task_labels",
    """WITH t AS (SELECT o_orderkey AS id, (CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 1 THEN 'kind' ELSE 'task' END)
              || (CASE WHEN o_orderkey % 2 = 0 THEN ' [' || lower(o_orderpriority) || ']' ELSE '' END) || ' (' || o_orderstatus || ')' AS label FROM orders)
       SELECT id, label FROM t WHERE contains(lower(label), 'kind')""",
)
def task_labels(spark, sf_dir):
    k = F.col("o_orderkey")
    label = catalog.task_label(F.when(k % 3 == 0, F.col("o_orderpriority")).otherwise(" "), F.when(k % 3 == 1, "kind"), F.when(k % 2 == 0, F.lower("o_orderpriority")), F.col("o_orderstatus"))
    rows = tables.read(spark, sf_dir, "orders").select(k.alias("id"), label.alias("label"))
    return catalog.filter_assets(rows, "KIND", ("label",))


@query(
    "detect_host",
    """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'blender' WHEN p_partkey % 7 = 1 THEN 'maya' WHEN p_partkey % 7 = 2 THEN 'houdini' WHEN p_partkey % 7 = 3 THEN lower(p_brand)
              WHEN p_partkey % 7 = 4 THEN 'houdini' WHEN p_partkey % 7 = 5 THEN 'unreal' ELSE 'N/A' END AS host FROM part""",
)
def detect_host(spark, sf_dir):
    k = F.col("p_partkey") % 7
    modules = F.when(k == 0, F.array(F.lit("maya"), F.lit("bpy"))).when(k == 1, F.array(F.lit("pymel"))).when(k == 2, F.array(F.lit("hou"), F.lit("mari"))).otherwise(F.array(F.lit("numpy")))
    hint = F.when(k == 3, F.concat(F.lit(" "), "p_brand")).otherwise("  ")
    exe = F.when(k == 4, "/opt/HFS20/bin/hfs20").when(k == 5, "C:/ue/UE4Editor-Cmd.exe").otherwise("/usr/bin/python3")
    return tables.read(spark, sf_dir, "part").select("p_partkey", catalog.host_name(modules, hint, exe).alias("host"))


@query("restore_path", "SELECT doc_id, 'work/' || source || '/' || (CASE WHEN doc_id % 5 = 0 THEN 'latest' ELSE printf('v%04d', doc_id) END) || '/' || doc_id || '.txt' AS path FROM documents")
def restore_paths(spark, sf_dir):
    version = F.when(F.col("doc_id") % 5 == 0, "latest").otherwise(F.col("doc_id").cast("string"))
    return tables.read(spark, sf_dir, "documents").select("doc_id", restore_path("work", "source", version, F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"))
