"""Row identity, keep-first choices, sequence numbers and unions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import SOURCE_COLUMNS
from ..functions.ids import dedup_key, record_id
from ..functions.text import blank
from ..scratch import settle


def ensure_columns(df: DataFrame, cols) -> DataFrame:
    """df with the columns it lacks as null text."""
    return df.withColumns({x: F.lit(None).cast("string") for x in cols if x not in df.columns})


def final_columns(df: DataFrame, cols) -> DataFrame:
    """Exactly these columns in this order."""
    return ensure_columns(df, cols).select(*cols)


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all tasks by a row's place in the input, for costly expressions on short rows: a small file, or a group of
    rows within one, is read by a single task. How many tasks there are goes by the size of df."""
    return df.withColumn("__rm_deal", F.monotonically_increasing_id()).repartition("__rm_deal").drop("__rm_deal")


def keep_first(df: DataFrame, keys, order) -> DataFrame:
    """One row for each key: the first by `order`, which should name a row uniquely."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def dedup_composite(df: DataFrame, scope=("source_file",), order=("source_row_no",), **columns) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): the first row of each composite key within a scope. Rows without an id are all kept.

    One pass over df: rows without an id have no key, so they are dealt over the tasks by a hash of their order and all rank first.
    """
    keys = dedup_key(**columns)
    names = ["key_inn", "key_region", "key_sector", "key_industry", "key_subindustry"]
    blank_id = F.col("key_inn") == ""
    deal = F.when(blank_id, F.pmod(F.xxhash64(*order), F.lit(4096))).otherwise(-1)
    rank = F.row_number().over(Window.partitionBy(*scope, *names, "__rm_deal").orderBy(*order))
    ranked = df.withColumns(dict(zip(names, keys))).withColumn("__rm_deal", deal).withColumn("_rank", F.when(blank_id, 1).otherwise(rank)).drop("__rm_deal", *names)
    return ranked.where("_rank = 1").drop("_rank"), ranked.where("_rank > 1").drop("_rank")


def dedup_by_id(df: DataFrame, key: str, order) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) by id alone; rows without one are kept."""
    known = df.where(blank(key).isNotNull()).withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return known.where("_rank = 1").drop("_rank").unionByName(df.where(blank(key).isNull())), known.where("_rank > 1").drop("_rank")


def best_record(df: DataFrame, key: str, confidence: str, rich, order) -> DataFrame:
    """The best row of each id: by confidence (high, medium, low), then by the number of filled columns, then by order. Rows without an id stay."""
    rank = F.when(F.col(confidence) == "high", 3).when(F.col(confidence) == "medium", 2).when(F.col(confidence) == "low", 1).otherwise(0)
    filled = reduce(lambda a, b: a + b, [blank(x).isNotNull().cast("int") for x in rich])
    return keep_first(df.where(blank(key).isNotNull()), [key], [rank.desc(), filled.desc(), *order]).unionByName(df.where(blank(key).isNull()))


def ensure_record_id(df: DataFrame, source_name: str = "", order=None) -> DataFrame:
    """df with blank record ids and file names filled in; with `order`, blank row numbers too, by the row's place in it."""
    df = ensure_columns(df, ["record_id", "source_file", "source_row_no"])
    df = df.withColumn("source_file", F.coalesce(blank("source_file"), F.lit(source_name)))
    if order:
        df = with_seq(df, order, "_place").withColumn("source_row_no", F.coalesce(blank("source_row_no"), F.col("_place").cast("string"))).drop("_place")
    made = record_id("source_file", "source_row_no", "INN", "Sector", "Industry", "Subindustry")
    return df.withColumn("record_id", F.coalesce(blank("record_id"), made))


def with_seq(df: DataFrame, order, name: str, buckets: int | None = None, settle: Callable[[DataFrame], DataFrame] = settle) -> DataFrame:
    """df numbered from 1 in order, without bringing all rows to one task.

    Ranges of the order, and of a row's place in the input where that is equal, are sorted apart and written with each row's
    place in its range; numbers are these places after the counts of the ranges before. Many rows of one order key are
    spread over ranges like any others. df is numbered once, as `settle` writes it, so its numbers do not change when a
    task is run again.
    """
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("__rm_tie", F.monotonically_increasing_id()).repartitionByRange(buckets, *order, "__rm_tie")
    # within a task these ids ascend by one; their upper bits are the task's number, in order of the ranges
    placed = settle(ranged.sortWithinPartitions(*order, "__rm_tie").withColumn("__rm_at", F.monotonically_increasing_id()).drop("__rm_tie"))
    part, inside = F.shiftright("__rm_at", 33), F.col("__rm_at").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("__rm_part")).agg((F.max(inside) + 1).alias("__rm_n"))
    earlier = Window.orderBy("__rm_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("__rm_part", F.coalesce(F.sum("__rm_n").over(earlier), F.lit(0)).alias("__rm_before"))
    numbered = placed.withColumn("__rm_part", part).join(F.broadcast(before), "__rm_part")  # a row for each range
    return numbered.withColumn(name, F.col("__rm_before") + inside + 1).drop("__rm_part", "__rm_at", "__rm_before")


def with_public_id(df: DataFrame, order, name: str = "id", record: str = "record_id") -> DataFrame:
    """df with a row's record id in `name`, or its place in order where it has none."""
    return with_seq(df, order, "__rm_place").withColumn(name, F.coalesce(blank(record), F.col("__rm_place").cast("string"))).drop("__rm_place")


def union_sources(dfs) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def retry_template(candidates: DataFrame, id_col: str = "inn") -> DataFrame:
    """Empty source records to be filled in by hand, one for each candidate id."""
    blanks = {x: F.lit(None).cast("string") for x in SOURCE_COLUMNS if x != "INN"}
    return candidates.withColumns(blanks).withColumn("INN", F.col(id_col)).select(*SOURCE_COLUMNS, *[x for x in candidates.columns if x != id_col])


def truthy(x) -> Column:
    from ..constants import TRUE_WORDS

    return F.coalesce(F.lower(F.trim(F.col(x).cast("string"))).isin(TRUE_WORDS), F.lit(False))
