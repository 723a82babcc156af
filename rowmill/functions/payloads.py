"""Nested answers of lookup services as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, c

COMPANY = "suggestions array<struct<value:string,data:struct<inn:string,name:struct<full_with_opf:string>,address:struct<value:string,unrestricted_value:string,geo_lat:string,geo_lon:string>,state:struct<status:string>,okved:string>>>"
PLACE = "response struct<GeoObjectCollection:struct<featureMember:array<struct<GeoObject:struct<Point:struct<pos:string>>>>>>"


def company_payload(x) -> Column:
    """struct<inn, name, address, lat, lon, status, okved> of the first suggestion; null fields where there is none."""
    s = F.get(F.from_json(c(x), COMPANY)["suggestions"], F.lit(0))
    d = s["data"]
    return F.struct(
        blank(d["inn"]).alias("inn"),
        F.coalesce(blank(d["name"]["full_with_opf"]), blank(s["value"])).alias("name"),
        F.coalesce(blank(d["address"]["unrestricted_value"]), blank(d["address"]["value"])).alias("address"),
        blank(d["address"]["geo_lat"]).alias("lat"),
        blank(d["address"]["geo_lon"]).alias("lon"),
        blank(d["state"]["status"]).alias("status"),
        blank(d["okved"]).alias("okved"),
    )


def place_payload(x) -> Column:
    """struct<lat, lon, status> of the first place; its position is `lon lat`."""
    parsed = F.from_json(c(x), PLACE)
    pos = F.split(F.get(parsed["response"]["GeoObjectCollection"]["featureMember"], F.lit(0))["GeoObject"]["Point"]["pos"], " ")
    lat, lon = F.get(pos, F.lit(1)), F.get(pos, F.lit(0))
    status = F.when(parsed["response"].isNull(), "parse_error").when(lat.isNull(), "not_found").otherwise("ok")
    return F.struct(lat.alias("lat"), F.when(lat.isNotNull(), lon).alias("lon"), status.alias("status"))


def latest_by(items, date_field: str) -> Column:
    """The element with the latest date; of equal dates the last. Elements without a date do not count."""
    dated = F.filter(c(items), lambda x: blank(x[date_field]).isNotNull())
    return F.array_max(F.transform(dated, lambda x, i: F.struct(x[date_field].alias("d"), i.alias("i"), x.alias("x"))))["x"]
