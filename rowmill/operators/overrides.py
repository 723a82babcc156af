"""Manual overrides: matched by record id, else by id and name, else by an id that one row alone has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import OVERRIDE_COLUMNS
from ..functions.ids import digits
from ..functions.text import blank


def read_overrides(spark: SparkSession, path: str, cols=("record_id", "INN", "CompanyNameOfficial", *OVERRIDE_COLUMNS, "OverrideReason")) -> DataFrame:
    """Overrides in file order; an empty frame where there is no file."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], ", ".join(f"{x} string" for x in ("override_no long", *cols)).replace("long string", "long"))
    rows = spark.read.option("header", True).csv(path)
    return rows.withColumn("override_no", F.monotonically_increasing_id() + 1).select("override_no", *cols)


def match_overrides(df: DataFrame, ov: DataFrame, row_id: str = "record_id", inn: str = "INN", name: str = "CompanyNameOfficial") -> DataFrame:
    """(record id, override_no): for each override the rows of its best way to match."""
    rows = df.select(F.col(row_id).alias("_id"), digits(inn).alias("_inn"), blank(name).alias("_name"))
    alone = rows.where("_inn is not null").groupBy("_inn").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select("_inn", F.lit(True).alias("_alone"))
    rows = rows.join(alone, "_inn", "left")  # rows without an id match no key, and are never brought together
    o = ov.select("override_no", blank(row_id).alias("o_id"), digits(inn).alias("o_inn"), blank(name).alias("o_name"))
    ways = [F.col("_id") == F.col("o_id"), (F.col("_inn") == F.col("o_inn")) & (F.col("_name") == F.col("o_name")), (F.col("_inn") == F.col("o_inn")) & F.coalesce("_alone", F.lit(False))]
    hits = None
    for i, on in enumerate(ways):
        part = rows.join(o, on).select("override_no", F.col("_id").alias(row_id), F.lit(i).alias("_way"))
        hits = part if hits is None else hits.unionByName(part)
    best = F.min("_way").over(Window.partitionBy("override_no"))
    return hits.withColumn("_best", best).where("_way = _best").select("override_no", row_id).distinct()


def apply_overrides(df: DataFrame, ov: DataFrame, fields=OVERRIDE_COLUMNS, row_id: str = "record_id", reason: str = "OverrideReason", source: str = "overrides") -> tuple[DataFrame, DataFrame]:
    """(df with non-blank override values in place, the later override winning, and what was applied; report by override)."""
    fields = [f for f in fields if f in ov.columns]
    hits = match_overrides(df, ov, row_id)
    applied = F.array_compact(F.array(*[F.when(blank(f).isNotNull(), F.lit(f)) for f in fields]))
    values = ov.select("override_no", *[blank(f).alias(f"_{f}") for f in fields], blank(reason).alias("_reason"), applied.alias("_fields"))
    matched = hits.join(values, "override_no")
    last = lambda x: F.max_by(F.col(x), F.when(F.col(x).isNotNull(), F.col("override_no")))
    any_ = F.when(F.size("_fields") > 0, F.col("override_no"))
    per_row = matched.groupBy(row_id).agg(*[last(f"_{f}").alias(f"_{f}") for f in fields], F.max_by("_reason", any_).alias("_reason"), F.max(any_).isNotNull().alias("_on"))
    out = df.join(per_row, row_id, "left").withColumns({f: F.coalesce(f"_{f}", f) for f in fields})
    out = out.withColumns({"override_applied": F.coalesce("_on", F.lit(False)), "override_reason": F.when(F.col("_on"), F.col("_reason")), "override_source": F.when(F.col("_on"), source)})
    counts = hits.groupBy("override_no").agg(F.count(F.lit(1)).alias("matched_rows"))
    report = values.join(counts, "override_no", "left").withColumn("matched_rows", F.coalesce("matched_rows", F.lit(0)))
    status = F.when(F.col("matched_rows") == 0, "not_matched").when(F.size("_fields") > 0, "applied").otherwise("matched_no_values")
    report = report.select("override_no", "matched_rows", status.alias("status"), F.when(F.col("matched_rows") > 0, F.array_join("_fields", ";")).otherwise("").alias("fields"), F.col("_reason").alias("reason"))
    return out.select(*df.columns, "override_applied", "override_reason", "override_source"), report
