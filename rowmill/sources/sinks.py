"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import safe_segment
from ..operators.export import flat_lines


def write_partitioned(df: DataFrame, out_dir: str, keys, fmt: str = "parquet", mode: str = "overwrite", rows_a_file: int = 5_000_000) -> None:
    """df under folders of safe names of its keys. Routes that share a safe name share a folder, so none overwrites another.

    Rows of a folder come together by its name and a salt, so that a folder with a large share of all rows is written by
    several tasks.
    """
    names = {f"p_{k}": safe_segment(k) for k in keys}
    salt = (F.spark_partition_id() % 16).alias("_salt")
    out = df.withColumns(names).withColumn("_salt", salt).repartition(*names, "_salt").drop("_salt")
    writer = out.write.mode(mode).option("maxRecordsPerFile", rows_a_file).partitionBy(*names)
    writer.option("header", True).csv(out_dir) if fmt == "csv" else writer.format(fmt).save(out_dir)


def write_flat(df: DataFrame, path: str) -> None:
    """Lines of comma-joined values without quotes, ended by CR LF."""
    flat_lines(df).write.mode("overwrite").option("lineSep", "\r\n").text(path)


def append_audit(df: DataFrame, path: str, run_id: str) -> None:
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").parquet(path)


def count_export(spark: SparkSession, out_dir: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(out_dir).agg(F.count(F.lit(1)).alias("n_rows"))
