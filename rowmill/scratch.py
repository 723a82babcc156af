"""Tables of a query's own, in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_MADE: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder the session names, else one in the warehouse. A machine's own folder serves only where driver and executors are one process."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named
    if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="rowmill-"))
        return sc.getCheckpointDir()
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if warehouse.startswith("file:") or "://" not in warehouse:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{warehouse}/_rowmill"


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder; it is deleted when the session's process ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _MADE.append(path)
    return path


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """df written once and read again, so that later steps see the same rows and a lost executor costs one reread."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _clear() -> None:
    spark = SparkSession.getActiveSession() if _MADE and SparkContext._active_spark_context else None
    if spark is None:
        return
    with contextlib.suppress(Exception):  # the JVM may be gone already
        for p in _MADE:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
