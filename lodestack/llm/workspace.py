"""Tables that cut lineage, written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_made = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary folder; any other
    session is an error, as its executors could not see such a folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/checkpoints"
    path = f"{root}/lodestack-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended before
        pass


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back.

    A lost executor costs the reruns of its own tasks only; what was written
    stays readable.
    """
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    _paths().append(path)
    return spark.read.schema(df.schema).parquet(path)


def _paths() -> list[str]:
    """The tables that this thread has written and not yet deleted."""
    if not hasattr(_made, "paths"):
        _made.paths = []
    return _made.paths


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """Writes what ``make`` returns, then deletes the tables that were written on the way to it.

    The shuffle files of their plans go as well, as soon as the driver has
    collected the plans, so disk holds one step of an operator and not all.
    """
    paths = _paths()
    first = len(paths)
    out = materialise(make())
    for path in paths[first:-1]:
        _remove(spark, path)
    del paths[first:-1]
    spark.sql("SELECT 1").collect()  # listeners hold the last plan that they were told of, so they are told of another
    gc.collect()  # for the references that Python holds to plans
    spark.sparkContext._jvm.System.gc()
    return out


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as keep it apart from the columns of ``df`` in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
