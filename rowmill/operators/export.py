"""Export routing, manifests, collisions, and the strict flat file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import MAP_COLUMNS
from ..functions.money import coord
from ..functions.paths import safe_segment
from ..functions.text import blank, first_nonblank, flat_clean

ROUTES = ["export_region", "export_industry", "export_subindustry"]


def export_routing(df: DataFrame, region: str, industry: str, subindustry: str, district: str | None = None) -> DataFrame:
    """df with export columns, placeholders where a value is missing, the names of what is missing, and the output path."""
    parts = [("region", region, "__REGION_NOT_MAPPED__"), ("industry", industry, "__INDUSTRY_MISSING__"), ("subindustry", subindustry, "__SUBINDUSTRY_MISSING__")]
    if district:
        parts.insert(0, ("federal_district", district, "__FEDERAL_DISTRICT_NOT_MAPPED__"))
    df = df.withColumn("issues", F.array_compact(F.array(*[F.when(blank(x).isNull(), F.lit(f"missing_{n}")) for n, x, _ in parts])))
    df = df.withColumns({f"export_{n}": F.coalesce(blank(x), F.lit(p)) for n, x, p in parts})
    names = [f"export_{n}" for n, _, _ in parts]
    return df.withColumn("export_path", F.concat_ws("/", *[safe_segment(x) for x in names[:-1]], safe_segment(names[-1], ext=".csv")))


def routing_issues(df: DataFrame) -> DataFrame:
    """A row for each issue of each row."""
    return df.withColumn("issue", F.explode("issues"))


def export_manifest(df: DataFrame) -> DataFrame:
    """Rows and routes of each output path. Paths that differ before they are made safe meet in one row, and no row is lost."""
    names = lambda x: F.array_join(F.array_sort(F.collect_set(x)), ";").alias(x)
    return df.groupBy("export_path").agg(F.count(F.lit(1)).alias("n_rows"), *[names(x) for x in ROUTES])


def export_collisions(df: DataFrame) -> DataFrame:
    """Paths that more than one route leads to."""
    return df.groupBy("export_path").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(*ROUTES).alias("n_routes")).where("n_routes > 1")


#: The length at which each column of the flat file is cut.
MAP_LENGTHS = {"id": 60, "title": 220, "address": 320, "description": 1400, "inn": 20, "region": 120, "industry": 180, "subindustry": 200, "website": 180, "description_status": 60}


def flat_export(df: DataFrame, sources: dict[str, list[str]]) -> DataFrame:
    """The 12 columns of the flat file; sources names for each the columns to take the first non-blank of."""
    out = []
    for name in MAP_COLUMNS:
        value = first_nonblank(*sources[name]) if sources.get(name) else F.lit(None).cast("string")
        out.append((F.coalesce(coord(value), F.lit("")) if name in ("lat", "lon") else flat_clean(value, MAP_LENGTHS[name])).alias(name))
    return df.select(*out)


def flat_lines(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws(",", *[F.coalesce(F.col(x), F.lit("")) for x in df.columns]).alias("value"))


def flat_validate(lines: DataFrame, commas: int = 11) -> DataFrame:
    """Lines, lines with another number of commas, and lines with coordinates."""
    f = F.split("value", ",")
    has = (F.coalesce(F.get(f, F.lit(2)), F.lit("")) != "") & (F.coalesce(F.get(f, F.lit(3)), F.lit("")) != "")
    return lines.agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.size(f) - 1 != commas).alias("bad_lines"), F.count_if(has).alias("with_coordinates"))
