"""Where results go: manifests, reports, the cache's table and issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX_COLUMNS = "content_id STRING NOT NULL, filename STRING NOT NULL, rel_path STRING NOT NULL, size_bytes BIGINT NOT NULL, last_accessed_at BIGINT NOT NULL, created_at BIGINT NOT NULL"


def create_index(spark: SparkSession, table: str) -> None:
    """The cache's index as an empty Parquet table, if it is not there."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({INDEX_COLUMNS}) USING parquet")


def replace_index(index: DataFrame, table: str) -> None:
    """Puts a new state of the index in place of the table's; the state is written before it takes the place."""
    spark, aside = index.sparkSession, f"{table}_new"
    spark.sql(f"DROP TABLE IF EXISTS {aside}")
    index.write.saveAsTable(aside)
    spark.table(aside).write.mode("overwrite").insertInto(table)
    spark.sql(f"DROP TABLE {aside}")


def write_manifests(manifests: DataFrame, path: str) -> None:
    """Appends manifests (manifest_id, manifest) that the folder lacks, by hash prefix, one JSON text a line."""
    spark = manifests.sparkSession
    rows = manifests.select("manifest_id", "manifest", F.substring("manifest_id", 1, 2).alias("prefix")).dropDuplicates(["manifest_id"])
    try:
        rows = rows.join(spark.read.json(path).select("manifest_id"), "manifest_id", "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows.write.mode("append").partitionBy("prefix").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of few rows as JSON lines in one file."""
    report.coalesce(1).write.mode("overwrite").json(path)


def append_issues(issues: DataFrame, path: str) -> DataFrame:
    """Appends issues that can be sent and returns the others with their problem."""
    from lodestack.functions.context import issue_problem

    judged = issues.withColumn("problem", issue_problem("title", "project_code"))
    judged.where("problem IS NULL").drop("problem").withColumn("source", F.lit("palette")).write.mode("append").parquet(path)
    return judged.where("problem IS NOT NULL")
