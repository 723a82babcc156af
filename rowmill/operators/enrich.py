"""Lookups with a cache table and an injected provider; coordinates."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_missing
from ..scratch import settle
from .reports import path_exists
from .rows import keep_first


def enrich_cached(df: DataFrame, key: str, cache: DataFrame, provider: Callable[[DataFrame], DataFrame] | None) -> tuple[DataFrame, DataFrame]:
    """(df with the cache's columns, new cache rows). The provider gets the distinct keys the cache lacks and returns rows like the cache's; failures it leaves out are asked again next time. Of several rows of a key the first in order of all columns counts."""
    misses = df.select(key).where(F.col(key).isNotNull()).distinct().join(cache, key, "left_anti")
    new = provider(misses) if provider else cache.limit(0)
    known = cache.unionByName(new)
    return df.join(keep_first(known.where(F.col(key).isNotNull()), [key], [F.col(x) for x in known.columns if x != key]), key, "left"), new


def map_provider(call, schema: str, size: int = 100, retries: int = 3, pause: float = 0.0, backoff: float = 1.0) -> Callable[[DataFrame], DataFrame]:
    """A provider that calls `call(list of keys) -> list of rows` for every `size` keys, in the tasks.

    A task waits `pause` seconds between calls. A call that raises is made again after `backoff`, twice that, and so on; keys
    of a call that fails to the end are left out, so that the next run asks for them.
    """

    def run(keys: DataFrame) -> DataFrame:
        name, names = keys.columns[0], [x.split()[0] for x in schema.split(", ")]

        def batches(frames):
            import time

            import pandas as pd

            for frame in frames:
                wanted = frame[name].tolist()
                for i in range(0, len(wanted), size):
                    for attempt in range(retries + 1):
                        try:
                            rows = call(wanted[i : i + size])
                        except Exception:  # whatever a service may raise
                            time.sleep(backoff * 2**attempt if attempt < retries else 0)
                            continue
                        yield pd.DataFrame(rows, columns=names)
                        break
                    time.sleep(pause)

        return keys.mapInPandas(batches, schema)

    return run


def read_cache(spark: SparkSession, cache_dir: str, key: str, schema: str) -> DataFrame:
    """The cache as it stands, one row a key: the merged table and what waves have added since."""
    empty = spark.createDataFrame([], schema)
    if not path_exists(spark, cache_dir):
        return empty
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(cache_dir)
    return keep_first(rows, [key], [F.col(x) for x in rows.columns if x != key])


def fill_cache(df: DataFrame, key: str, cache_dir: str, provider: Callable[[DataFrame], DataFrame], schema: str, keys_a_wave: int = 1_000_000) -> int:
    """Ask the provider for the keys of df that the cache lacks, in waves that are each written when they are done; a run that
    breaks off keeps its finished waves, and the next asks for the rest. Returns how many keys were asked for."""
    spark = df.sparkSession
    known = read_cache(spark, cache_dir, key, schema).select(key)
    misses = settle(df.select(key).where(F.col(key).isNotNull()).distinct().join(known, key, "left_anti"))
    n = misses.count()
    waves, run = -(-n // keys_a_wave), uuid.uuid4().hex[:12]
    for w in range(waves):
        provider(misses.where(F.pmod(F.xxhash64(key), F.lit(waves)) == w)).write.parquet(f"{cache_dir}/run={run}/wave={w}")
    return n


def merge_cache(spark: SparkSession, cache_dir: str, key: str, schema: str) -> None:
    """Rewrite the cache as one table with a row for each key. The new table is whole before old ones go, and a key that
    stands in both counts once, so a merge that breaks off loses and doubles nothing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_dir)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    old = [f.getPath() for f in fs.listStatus(path)]
    read_cache(spark, cache_dir, key, schema).write.parquet(f"{cache_dir}/merged={uuid.uuid4().hex[:12]}")
    for p in old:
        fs.delete(p, True)


def fill_coords(df: DataFrame, lookup: DataFrame, address: str = "address") -> tuple[DataFrame, DataFrame]:
    """(df with lat, lon and where they come from, rows left without and why). Stated coordinates stay. Of several
    lookup rows of an address one with coordinates counts, the first in order of its columns."""
    known = ~is_missing("lat") & ~is_missing("lon")
    found = lookup.select(F.col(address).alias("_address"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col("status").alias("_status"))
    found = keep_first(found.where("_address is not null"), ["_address"], [F.col("_lat").isNull(), "_lat", "_lon", "_status"])
    out = df.join(found, (F.col(address) == F.col("_address")) & ~known, "left")
    got = ~known & F.col("_lat").isNotNull()
    out = out.withColumns({"lat": F.when(known, F.col("lat")).when(got, F.col("_lat")), "lon": F.when(known, F.col("lon")).when(got, F.col("_lon")), "geo_source": F.when(known, "stated").when(got, "lookup")})
    why = F.when(is_missing(address), "no_address_for_geocoding").otherwise(F.coalesce("_status", F.lit("not_found")))
    missing = out.where("geo_source is null").withColumn("reason", why).drop("_address", "_lat", "_lon", "_status")
    return out.drop("_address", "_lat", "_lon", "_status"), missing


def assemble(clean: DataFrame, enriched: DataFrame, geo: DataFrame, key: str, order) -> DataFrame:
    """Clean rows with enriched and geo columns; each right side keeps its first row of a key, so that no row multiplies."""
    return clean.join(keep_first(enriched, [key], order), key, "left").join(keep_first(geo, [key], order), key, "left")
