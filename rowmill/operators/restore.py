"""Fill lost cells from a reference layer, never overwriting, never changing the number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank
from .rows import keep_first


def restore(target: DataFrame, reference: DataFrame, cols, row_id: str = "record_id", keys=("INN", "RegionRegistration", "Sector", "Industry", "Subindustry"), order=None) -> tuple[DataFrame, DataFrame]:
    """(restored, cells): blank cells of `cols` filled by row id, then by composite key; `cells` lists each one filled.

    The reference keeps its first row of each key before each join. Keys without an id (the first of `keys`) match nothing.
    """
    order = order or [row_id]
    by_id = keep_first(reference.where(blank(row_id).isNotNull()), [row_id], order).select(row_id, *[F.col(x).alias(f"_a_{x}") for x in cols])
    keyed = reference.where(blank(keys[0]).isNotNull())
    by_key = keep_first(keyed, list(keys), order).select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(x).alias(f"_b_{x}") for x in cols])
    on = [F.col(k) == F.col(f"_k_{k}") for k in keys]
    both = target.join(by_id, row_id, "left").join(by_key, on, "left")
    new = {x: F.coalesce(blank(x), blank(f"_a_{x}"), blank(f"_b_{x}")) for x in cols}
    change = F.array_compact(F.array(*[F.when(blank(x).isNull() & new[x].isNotNull(), F.struct(F.lit(x).alias("cell"), new[x].alias("value"), F.when(blank(f"_a_{x}").isNotNull(), row_id).otherwise("composite").alias("by"))) for x in cols]))
    cells = both.select(row_id, F.explode(change).alias("x")).select(row_id, "x.cell", "x.value", "x.by")
    return both.withColumns(new).select(target.columns), cells


def restored_cells(cells: DataFrame) -> DataFrame:
    return cells.groupBy("cell", "by").agg(F.count(F.lit(1)).alias("n_cells"))


def check_same_count(before: DataFrame, after: DataFrame, stage: str) -> DataFrame:
    """One row: did a stage keep the number of rows."""
    a, b = before.agg(F.count(F.lit(1)).alias("n_before")), after.agg(F.count(F.lit(1)).alias("n_after"))
    return a.crossJoin(b).select(F.lit(stage).alias("stage"), "n_before", "n_after", F.when(F.col("n_before") == F.col("n_after"), "PASS").otherwise("FAIL").alias("status"))
