"""Running numbers of rows under a key, in two levels, so that a hot key is not ordered in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered(df: DataFrame, keys: list[str], order: list[str], bucket: Column, to: str, counts: Column | None = None) -> DataFrame:
    """``df`` with the column ``to``: how many rows of the key stand up to each row, in ``order``.

    ``bucket`` must rise with the order. Numbers run inside each bucket; those of
    earlier buckets are added from a table of bucket totals. With ``counts``, a
    boolean, only rows where it holds are counted.
    """
    one = F.lit(1) if counts is None else F.coalesce(counts.cast("int"), F.lit(0))
    rows = df.withColumn("_bucket", bucket).withColumn("_one", one)
    totals = rows.groupBy(*keys, "_bucket").agg(F.sum("_one").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_bucket").alias("_b"), before.alias("_before"))
    inner = F.sum("_one").over(Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    same = F.col("_bucket").eqNullSafe(F.col("_b"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = rows.withColumn("_inner", inner).join(totals, same)
    return out.withColumn(to, (F.col("_before") + F.col("_inner")).cast("int")).select(*df.columns, to)
