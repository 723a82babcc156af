"""Entity ids and row identity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import c, norm_text

ID_PATTERN = r"(?<![0-9])([0-9]{10}|[0-9]{12})(?![0-9])"


def digits(x) -> Column:
    """The digits of a value, null if it has none."""
    return F.nullif(F.regexp_replace(c(x).cast("string"), "[^0-9]", ""), F.lit(""))


def match_key(x) -> Column:
    """Digits, at least 10 with zeros in front and at most the last 12; a value without digits has no key and matches nothing."""
    d = digits(x)
    return F.when(F.length(d) < 10, F.lpad(d, 10, "0")).otherwise(F.right(d, F.lit(12)))


def valid_id(x) -> Column:
    return F.coalesce(F.length(digits(x)).isin(10, 12), F.lit(False))


def ids_in_text(x) -> Column:
    """Distinct ids of 10 or 12 digits in a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(c(x), F.lit("")), F.lit(ID_PATTERN), F.lit(1))))


def record_id(file, row_no, inn, sector, industry, subindustry) -> Column:
    """20 hex digits that name a source row: a SHA-1 of its normalised place, id and classification."""
    parts = [norm_text(x) for x in (file, row_no, F.coalesce(digits(inn), F.lit("")), sector, industry, subindustry)]
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 20)


def dedup_key(inn="INN", region="RegionRegistration", sector="Sector", industry="Industry", subindustry="Subindustry") -> list[Column]:
    """The composite key of an entity row."""
    return [F.coalesce(digits(inn), F.lit("")).alias("key_inn"), *[norm_text(x).alias(f"key_{n}") for n, x in (("region", region), ("sector", sector), ("industry", industry), ("subindustry", subindustry))]]


def valid_codes(text, codes) -> Column:
    """Two-digit codes in a text that are known, distinct, in order."""
    known = F.array(*[F.lit(k) for k in codes])
    found = F.regexp_extract_all(F.coalesce(c(text), F.lit("")), F.lit(r"\b[0-9]{2}\b"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda x: F.array_contains(known, x)))


def operation_codes(raw, inn, codes) -> Column:
    """Region codes an entity works in, the code of its id first unless it is named already."""
    listed, own = valid_codes(raw, codes), F.substring(digits(inn), 1, 2)
    known = F.array(*[F.lit(k) for k in codes])
    add = F.array_contains(known, own) & ~F.array_contains(listed, own)
    return F.array_join(F.when(add, F.concat(F.array(own), listed)).otherwise(listed), ",")
