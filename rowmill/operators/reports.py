"""Counts, roll-ups, layers and the quality gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import digits, valid_id
from ..functions.money import to_double
from ..functions.text import blank


def group_counts(df: DataFrame, keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


def condition_counts(df: DataFrame, **conditions: str) -> DataFrame:
    """One row: all rows, and those that meet each named condition."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.coalesce(F.expr(x), F.lit(False))).alias(name) for name, x in conditions.items()])


def group_rollup(df: DataFrame, keys) -> DataFrame:
    """Counts at each level of a hierarchy; `level` is the number of keys that apply."""
    return df.rollup(*keys).agg(F.count(F.lit(1)).alias("n_rows"), (len(keys) - F.bit_count(F.grouping_id())).cast("int").alias("level"))


def order_by_category(df: DataFrame, col: str, order: DataFrame, last: int = 9999) -> DataFrame:
    """df with `position` from (name, position); categories that are not listed come last, by name."""
    return df.join(order, df[col] == order["name"], "left").withColumn("position", F.coalesce("position", F.lit(last))).drop("name").orderBy("position", col)


def layer_status(layers: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("layer"), "n_rows") for n, df in layers.items()])


def pick_layer(layers: dict[str, DataFrame]) -> tuple[str, DataFrame]:
    """The first layer that has rows, else the last."""
    for name, df in layers.items():
        if not df.isEmpty():
            return name, df
    return name, df


def ordered_distinct(df: DataFrame, key: str, value: str, order: str, sep: str = " | ", cap: int = 2000) -> DataFrame:
    """Distinct values of each key in order, joined and cut to `cap` characters.

    A value's first place is found before values are ranked. No value is empty, so `cap` characters hold the first
    cap / (1 + separator) values at most; no more of a key are kept in any task, however many it has.
    """
    most = cap // (len(sep) + 1) + 1
    first = df.where(blank(value).isNotNull()).groupBy(key, value).agg(F.min(order).alias("_at"))
    first = first.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy("_at", value))).where(F.col("_rank") <= most)
    return first.groupBy(key).agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rank", F.col(value).alias("v")))), lambda x: x["v"]), sep), 1, cap).alias(f"{value}_list"))


def request_rows(df: DataFrame, cols, inn: str = "INN") -> DataFrame:
    """Context columns of the rows with a well-formed id."""
    return df.where(valid_id(inn)).select(*[x for x in cols if x in df.columns])


def request_summary(df: DataFrame, inn: str = "INN") -> DataFrame:
    """Rows offered for a request, those that can be asked for, and the distinct ids among these."""
    ok = valid_id(inn)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(ok).alias("with_id"), F.count_distinct(F.when(ok, digits(inn))).alias("n_ids"))


def quality_gate(layers: dict[str, DataFrame], exported: int | DataFrame, min_employees: float, min_revenue: float) -> DataFrame:
    """(check_name, status, details), and an `overall` row. Layers: active, routed, included, excluded, review, and any routing issues.

    One aggregate a layer; a check that cannot be made is a WARN, never a silent pass.
    """
    one = {}
    for name, df in layers.items():
        aggs = [F.count(F.lit(1)).alias(f"{name}_rows")]
        if "record_id" in df.columns:
            aggs.append(F.count_if(blank("record_id").isNull()).alias(f"{name}_no_record"))
        if "inn" in df.columns:
            aggs.append(F.count_if(digits("inn").isNull()).alias(f"{name}_no_inn"))
        if name == "included":
            aggs.append(F.count_if((to_double("employees") < min_employees) & (to_double("revenue_rub") < min_revenue)).alias("bad_included"))
        one[name] = df.agg(*aggs)
    if isinstance(exported, DataFrame):
        one["exported"] = exported.agg(F.count(F.lit(1)).alias("exported_rows"))
    facts = reduce(DataFrame.crossJoin, one.values())  # one row each
    if not isinstance(exported, DataFrame):
        facts = facts.withColumn("exported_rows", F.lit(exported))
    return _checks(facts)


def quality_gate_routed(active: DataFrame, routed: DataFrame, min_employees: float, min_revenue: float, status: str = "status", exported: str = "include") -> DataFrame:
    """quality_gate of layers that are one frame's routes, in a single pass over it; the rows of `exported` are the export."""
    routes = {"included": "include", "excluded": "exclude", "review": "review"}
    aggs = [F.count(F.lit(1)).alias("routed_rows"), F.count_if(digits("inn").isNull()).alias("routed_no_inn"), F.count_if(F.col(status) == exported).alias("exported_rows")]
    for name, value in routes.items():
        aggs += [F.count_if(F.col(status) == value).alias(f"{name}_rows"), F.count_if((F.col(status) == value) & digits("inn").isNull()).alias(f"{name}_no_inn")]
    low = (to_double("employees") < min_employees) & (to_double("revenue_rub") < min_revenue)
    aggs.append(F.count_if((F.col(status) == routes["included"]) & low).alias("bad_included"))
    first = active.agg(F.count(F.lit(1)).alias("active_rows"), F.count_if(digits("inn").isNull()).alias("active_no_inn"))
    return _checks(first.crossJoin(routed.agg(*aggs)))  # one row each


def layer_metrics(df: DataFrame, name: str, record: str = "record_id", inn: str = "inn") -> list[Column]:
    """What the gate and the layer status want to know of a layer, as aggregates."""
    out = [F.count(F.lit(1)).alias(f"{name}_rows")]
    out.append((F.count_if(blank(record).isNull()) if record in df.columns else F.count(F.lit(1))).alias(f"{name}_no_record"))
    out.append((F.count_if(digits(inn).isNull()) if inn in df.columns else F.count(F.lit(1))).alias(f"{name}_no_inn"))
    return out


def route_metrics(min_employees: float, min_revenue: float, status: str = "status", issues: Column | None = None) -> list[Column]:
    """Rows by route, included rows below both thresholds, and rows with a routing issue, as aggregates over all routes."""
    is_ = lambda value: F.col(status) == value
    low = (to_double("employees") < min_employees) & (to_double("revenue_rub") < min_revenue)
    out = [F.count_if(is_(v)).alias(f"{n}_rows") for n, v in (("included", "include"), ("excluded", "exclude"), ("review", "review"))]
    return [*out, F.count_if(is_("include") & low).alias("bad_included"), *([] if issues is None else [F.count_if(issues).alias("issues_rows")])]


def write_observed(df: DataFrame, path: str, metrics: list[Column], partition_by=()) -> dict:
    """Write a layer and return its metrics, gathered while it is written; nothing is scanned a second time."""
    seen = Observation()
    df.observe(seen, *metrics).write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return seen.get


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def quality_gate_observed(spark: SparkSession, metrics: dict, paths: dict[str, str]) -> DataFrame:
    """The gate of layers that were written with write_observed: their metrics together, and whether each path is there."""
    facts = spark.createDataFrame([tuple(metrics.values())], ", ".join(f"{k} long" for k in metrics))
    for name, path in paths.items():
        facts = facts.withColumn(f"{name}_exists", F.lit(path_exists(spark, path)))
    return _checks(facts)


def layer_status_observed(spark: SparkSession, metrics: dict) -> DataFrame:
    """Rows of each layer from the metrics of its write."""
    return spark.createDataFrame([(k.removesuffix("_rows"), v) for k, v in metrics.items() if k.endswith("_rows")], "layer string, n_rows long")


def _checks(facts: DataFrame) -> DataFrame:
    say = lambda name, ok, details, bad="FAIL": F.struct(F.lit(name).alias("check_name"), F.when(ok, "PASS").otherwise(bad).alias("status"), details.alias("details"))
    n = lambda x: F.col(x).cast("string")
    checks = [
        say("active_rows", F.col("active_rows") > 0, F.concat(F.lit("rows="), n("active_rows"))),
        say("partition_sum", F.col("routed_rows") == F.col("included_rows") + F.col("excluded_rows") + F.col("review_rows"), F.concat_ws(" ", n("routed_rows"), n("included_rows"), n("excluded_rows"), n("review_rows"))),
        say("included_thresholds", F.col("bad_included") == 0, F.concat(F.lit("bad="), n("bad_included"))),
        say("export_row_count", F.col("exported_rows") == F.col("included_rows"), F.concat_ws(" ", n("exported_rows"), n("included_rows"))),
    ]
    checks += [say(x.replace("_no_", "_has_"), F.col(x) == 0, F.concat(F.lit("missing="), n(x))) for x in facts.columns if "_no_" in x]
    checks += [say(x, F.col(x), F.lit("")) for x in facts.columns if x.endswith("_exists")]
    if "issues_rows" in facts.columns:
        checks.append(say("routing_issues", F.col("issues_rows") == 0, F.concat(F.lit("rows="), n("issues_rows")), "WARN"))
    facts = facts.select(F.array(*checks).alias("x"))
    overall = F.struct(F.lit("overall").alias("check_name"), F.when(F.exists("x", lambda y: y["status"] == "FAIL"), "FAIL").otherwise("PASS").alias("status"), F.lit("").alias("details"))
    return facts.select(F.explode(F.array_append("x", overall)).alias("x")).select("x.*")
