"""Sinks keep what is there and add what is new."""

from pyspark.sql import functions as F

from lodestack.operators import cache
from lodestack.plans.manifests import manifest_v2_build
from lodestack.sources import sinks, tables

SF = "/root/testdata/sf0.001"


def test_index_table(spark):
    sinks.create_index(spark, "lode_index")
    sinks.create_index(spark, "lode_index")
    try:
        assert spark.table("lode_index").count() == 0
        index = cache.upsert(None, tables.accesses(spark, SF))
        sinks.replace_index(index, "lode_index")
        sinks.replace_index(cache.delete(spark.table("lode_index"), index.limit(3)), "lode_index")
        assert spark.table("lode_index").count() == index.count() - 3
    finally:
        spark.sql("DROP TABLE lode_index")


def test_manifests_are_written_once(spark, tmp_path):
    made = manifest_v2_build(spark, SF)
    for _ in range(2):
        sinks.write_manifests(made, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == made.select("manifest_id").distinct().count()


def test_reports_and_issues(spark, tmp_path):
    sinks.write_report(spark.range(3), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 3
    issues = spark.createDataFrame([("t", "p"), (" ", "p"), ("t", None)], "title string, project_code string")
    assert sorted(r.problem for r in sinks.append_issues(issues, str(tmp_path / "i")).collect()) == ["project_required", "title_required"]
    assert spark.read.parquet(str(tmp_path / "i")).count() == 1


def test_whole_files_are_read(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.ma").write_bytes(b"one")
    (tmp_path / "b.txt").write_bytes(b"two")
    assert [bytes(r.content) for r in tables.files(spark, str(tmp_path), "*.ma").collect()] == [b"one"]
    assert tables.files(spark, str(tmp_path)).agg(F.sum("length")).first()[0] == 6
