"""Regions: dimension, names in text, districts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import ADDRESS_PATTERNS, REGION_ALIASES, REGION_SHORT_FORMS, REGIONS
from ..functions.ids import digits
from ..functions.text import blank, c, squeeze
from .rows import keep_first


#: Abbreviated kinds of region, which both names and texts may have.
KINDS = {"респ": "республика", "обл": "область", "кр": "край"}


def alias_key(x):
    """Lower case, single spaces, no dashes between words, kinds spelled out."""
    t = F.translate(F.lower(F.coalesce(c(x), F.lit(""))), "ё", "е")
    for short, whole in KINDS.items():
        t = F.regexp_replace(t, rf"(?<![а-яa-z]){short}(?:\.|(?![а-яa-z]))", whole)
    return F.btrim(F.regexp_replace(t, r"(?U)\s+(?:[—–-]\s+)?", " "), F.lit(" .,;"))


def load_regions(spark: SparkSession, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(code, region, district) and (alias, region); a CSV file of region_code, region_name, federal_district and aliases, set apart by |, overrides the built-in rows."""
    seed = spark.createDataFrame([(*r, 0) for r in REGIONS], "code string, region string, district string, layer int")
    named = [(r, r) for _, r, _ in REGIONS] + [(r, x) for r, xs in REGION_ALIASES.items() for x in xs]
    alias = spark.createDataFrame([(x, r, 0) for r, x in named], "alias string, region string, layer int")
    if path:
        own = spark.read.option("header", True).csv(path)
        own = own.select(F.when(F.length(F.trim("region_code")) < 2, F.lpad(F.trim("region_code"), 2, "0")).otherwise(F.trim("region_code")).alias("code"), blank("region_name").alias("region"), blank("federal_district").alias("district"), "aliases").where("code is not null and region is not null")
        seed = seed.unionByName(own.select("code", "region", "district", F.lit(1).alias("layer")))
        more = own.select(F.explode(F.concat(F.array("region"), F.coalesce(F.split("aliases", r"\|"), F.array().cast("array<string>")))).alias("alias"), "region", F.lit(1).alias("layer"))
        alias = alias.unionByName(more)
    last = F.struct("layer", "region")
    dim = seed.groupBy("code").agg(F.max_by(F.struct("region", "district"), last).alias("x")).select("code", "x.region", "x.district")
    alias = alias.withColumn("alias", alias_key("alias")).where("alias <> ''").groupBy("alias").agg(F.max_by("region", last).alias("region"))
    return dim, alias


#: Letters stand together as one token, any other character for itself.
_TOKENS = "[а-яa-z]+|[^а-яa-z]"
_LETTERS = "^[а-яa-z]"


def _grams(tokens, lengths):
    """Runs of `lengths` tokens with no letter before or behind them, each once."""

    def from_(i):
        last = lambda n: i + n - 1
        free = lambda at: ~F.coalesce(F.get(tokens, at), F.lit(" ")).rlike(_LETTERS)
        runs = [F.when((last(n) < F.size(tokens)) & free(i + n), F.array_join(F.slice(tokens, i + 1, n), "")) for n in lengths]
        return F.when(F.when(i > 0, free(i - 1)).otherwise(True), F.array_compact(F.array(*runs))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.size(tokens) - 1), from_)))


def aliases_in(texts: DataFrame, text: str, alias: DataFrame) -> DataFrame:
    """Each row of texts with every alias that stands in its text as whole words, looked up by the text's runs of tokens: an
    equality join, however many aliases there are. A run has as many tokens as some alias has."""
    n_tokens = F.size(F.regexp_extract_all("alias", F.lit(_TOKENS), F.lit(0)))
    lengths = sorted(r[0] for r in alias.select(n_tokens).distinct().collect())  # at most the tokens of the longest alias
    if not lengths:
        return texts.crossJoin(alias).limit(0)
    tokens = texts.withColumn("_tokens", F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0))).where(F.size("_tokens") > 0)
    return tokens.withColumn("alias", F.explode(_grams(F.col("_tokens"), lengths))).drop("_tokens").join(alias, "alias")


def normalize_region(df: DataFrame, col: str, alias: DataFrame, out: str = "region_name", otherwise=None) -> DataFrame:
    """df with the official name in `out`: an exact alias, else the longest alias in the text as a whole word (of equal ones the first by name), else `otherwise`, else the text itself. Only the distinct values are looked up; then the answers join back."""
    values = df.select(F.col(col).alias("_value")).where("_value is not null").distinct().withColumn("_text", alias_key("_value"))
    found = aliases_in(values, "_text", alias.select("alias", F.col("region").alias("_official")))
    best = found.groupBy("_value").agg(F.min_by("_official", F.struct(-F.length("alias"), F.col("alias"))).alias("_best"))  # an exact alias is the longest
    plain = F.nullif(F.btrim(F.regexp_replace(F.translate(F.col(col), "ё", "е"), r"(?U)\s+", " "), F.lit(" .,;")), F.lit(""))
    return df.join(best, F.col(col) == F.col("_value"), "left").withColumn(out, F.coalesce(F.col("_best"), *([] if otherwise is None else [otherwise]), plain)).drop("_value", "_best")


def region_from_id(df: DataFrame, dim: DataFrame, inn: str = "INN") -> DataFrame:
    """df with id_code, id_region and id_district of the first two digits of an id."""
    d = dim.select(F.col("code").alias("_code"), F.col("region").alias("id_region"), F.col("district").alias("id_district"))
    return df.withColumn("id_code", F.substring(digits(inn), 1, 2)).join(d, F.col("id_code") == F.col("_code"), "left").drop("_code")


def region_cascade(df: DataFrame, dim: DataFrame, alias: DataFrame, stated: str = "RegionRegistration", inn: str = "INN") -> DataFrame:
    """df with region (stated, else by id) and district (by region, else by id)."""
    df = region_from_id(normalize_region(df, stated, alias, "_stated"), dim, inn).withColumn("region", F.coalesce("_stated", "id_region"))
    by_name = dim.groupBy(F.col("region").alias("_r")).agg(F.min_by("district", "code").alias("_d"))
    return df.join(by_name, F.col("region") == F.col("_r"), "left").withColumn("district", F.coalesce("_d", "id_district")).drop("_r", "_d", "_stated")


def address_region(x):
    """The region an address names: the first pattern that fits, with single spaces, else its second part between commas if that has over three characters. A postal index in front does not count."""
    t = F.regexp_replace(F.coalesce(c(x), F.lit("")), r"(?U)^\d+\s*,?\s*", "")
    named = [F.nullif(F.regexp_replace(F.trim(F.regexp_extract(t, f"(?iU){p}", 1)), r"(?U)\s+", " "), F.lit("")) for p in ADDRESS_PATTERNS]
    second = F.trim(F.get(F.split(t, ","), F.lit(1)))
    return F.coalesce(*named, F.when(F.length(second) > 3, second))


def title_region(x):
    """A region's words with capitals in front; short forms of districts in full where they stand alone."""
    t = F.initcap(F.lower(squeeze(F.coalesce(c(x), F.lit("")))))
    whole = F.lit(None).cast("string")
    for short, full in REGION_SHORT_FORMS.items():
        whole = F.coalesce(whole, F.when(t == short, F.lit(full)))
    return F.nullif(F.coalesce(whole, t), F.lit(""))


def region_from_address(df: DataFrame, col: str, alias: DataFrame, out: str = "region_from_address") -> DataFrame:
    """df with the region of an address in `out`: the longest alias in it, else what its patterns or its second part name, else the address itself."""
    return normalize_region(df, col, alias, out, title_region(address_region(col)))


def with_district(df: DataFrame, dim: DataFrame, on: str, district: str = "district", missing: str = "__DISTRICT_NOT_MAPPED__") -> tuple[DataFrame, DataFrame]:
    """(df with district, counts of unmapped values). Of several dimension rows of a name the first in order of all columns
    counts, so that no row multiplies; unmapped rows keep a placeholder. The plan broadcasts the dimension if it is small."""
    out = df.join(keep_first(dim.where(F.col(on).isNotNull()), [on], [F.col(x) for x in dim.columns if x != on]), on, "left").withColumn(district, F.coalesce(district, F.lit(missing)))
    return out, out.where(F.col(district) == missing).groupBy(on).agg(F.count(F.lit(1)).alias("n_rows"))
