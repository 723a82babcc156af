"""Centroid clustering of integer vectors with scalar lookup tables.

Vectors become integers once and are written to the shared folder. In every round each task tabulates, batch by batch and for
each dimension, the squared difference between every integer that occurs in it and every centroid; the distances of the batch
are gathers from these tables, summed over the dimensions. A task reports one row of sums for each centroid (and limb of 32
bits, so that sums are exact at any size), Spark adds them up, and the driver divides the few sums that remain. What is sent to
the tasks is the centroids alone, k times the dimensions.

Defined cases: vectors that are null, of another length, hold null or non-finite components, or overflow a double once they
are scaled take no part; a null vec_id is hashed as the word null; rows that repeat a vec_id are vectors of their own, told
apart by their components where the start is drawn; with fewer than k vectors there are fewer centroids; equal centroids leave
the later one empty, and an empty centroid stays where it is; an empty table gives an empty result. Components of any size are
compared exactly; distances and inertias that do not fit a long are given as the largest long. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

DIMS, CLUSTERS, ROUNDS, SEED, SCALE = 64, 8, 10, 3, 1024.0
#: Below this, squared differences of up to 128 dimensions add up within 63 bits.
SAFE = 1 << 27
LARGEST = (1 << 63) - 1


def _integers(dims: int, scale: float):
    def run(batches):
        for batch in batches:
            lists = batch.column("embedding")
            at = np.flatnonzero(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False) == dims)
            flat = lists.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(scale * flat.reshape(-1, dims))
            good = np.isfinite(x).all(axis=1)
            values = pa.ListArray.from_arrays(pa.array(np.arange(good.sum() + 1, dtype=np.int32) * dims), pa.array(x[good].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at[good])), values], names=["vec_id", "x"])

    return run


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """The integers of a batch: machine integers where they are small enough, else Python's."""
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    if not x.size or np.abs(x).max() < SAFE:
        return x.astype(np.int64)
    return np.array([[int(v) for v in row] for row in x.tolist()], object)


def _codes(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The integers that occur, ascending, and each row's place among them."""
    if column.dtype != object:
        low = int(column.min())
        width = int(column.max()) - low + 1
        if width <= 8 * len(column):
            there = np.zeros(width, bool)
            there[column - low] = True
            return np.flatnonzero(there) + low, (np.cumsum(there) - 1)[column - low]
    return np.unique(column, return_inverse=True)


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each row, by tables of the integers that occur in a dimension."""
    small = x.dtype != object and max(abs(v) for row in centroids for v in row) < SAFE
    kind = np.int64 if small else object
    x, c = x.astype(kind), np.array(centroids, kind)
    total = np.zeros((len(x), len(c)), kind)
    for d in range(x.shape[1] if len(x) else 0):
        values, code = _codes(x[:, d])
        table = (values.astype(kind)[:, None] - c[None, :, d]) ** 2
        total += table[code]
    best = total.argmin(axis=1) if len(x) else np.zeros(0, np.int64)
    return best.astype(np.int64), total[np.arange(len(x)), best]


def _limbs(values: list[int]) -> list[list[int]]:
    """Integers as lists of 32-bit limbs, lowest first; the highest has the sign."""
    out = []
    while any(not -(1 << 31) <= v < 1 << 31 for v in values):
        out.append([v & 0xFFFFFFFF for v in values])
        values = [v >> 32 for v in values]
    return [*out, values]


def _sums(centroids: list[list[int]], dims: int):
    """For each centroid of a task: how many vectors are nearest to it, and their sums."""

    def run(batches):
        counts, sums = [0] * len(centroids), [[0] * dims for _ in centroids]
        for batch in batches:
            x = _matrix(batch, dims)
            best, _ = nearest(x, centroids)
            for c in np.unique(best).tolist():
                mine = x[best == c]
                counts[c] += len(mine)
                sums[c] = [a + int(b) for a, b in zip(sums[c], mine.sum(axis=0))]
        rows = [(c, i, n if i == 0 else 0, limb) for c, n in enumerate(counts) if n for i, limb in enumerate(_limbs(sums[c]))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], names=["cluster", "limb", "n", "s"])

    return run


def _assigned(centroids: list[list[int]], dims: int):
    def run(batches):
        for batch in batches:
            best, distance = nearest(_matrix(batch, dims), centroids)
            distance = pa.array([min(int(v), LARGEST) for v in distance.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best.astype(np.int32)), distance], names=["vec_id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, scratch: Scratch, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS, scale: float = SCALE) -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance) of every vector that takes part, final centroids)."""
    kept = scratch.settle(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_integers(dims, scale), "vec_id long, x array<double>"))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    centroids = [[int(v) for v in r.x] for r in kept.select(drawn.alias("drawn"), "x").orderBy("drawn", "x").limit(k).collect()]
    for _ in range(rounds if centroids else 0):
        parts = kept.mapInArrow(_sums(centroids, dims), "cluster int, limb int, n long, s array<long>")
        rows = parts.groupBy("cluster", "limb").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", F.lit(d))) for d in range(dims)]).alias("s")).collect()
        for c in {r.cluster for r in rows}:
            mine = [r for r in rows if r.cluster == c]
            n = sum(r.n for r in mine)
            centroids[c] = [sum(r.s[d] << 32 * r.limb for r in mine) // n for d in range(dims)]
    if not centroids:
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    return scratch.settle(kept.mapInArrow(_assigned(centroids, dims), "vec_id long, cluster int, distance long")), centroids


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """assigned with the inertia of its cluster and of all, and a digest of its centroid; a row for each centroid is joined."""
    spark = assigned.sparkSession
    sums = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    told = [(c, min(sums.get(c, 0), LARGEST), min(sum(sums.values()), LARGEST), digest[c]) for c in range(len(centroids))]
    told = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark, "centroids")))


def _oracle() -> str:
    """The rounds one after another. The sums of a cluster are floored by taking the remainder off."""
    steps = [
        f"""v as materialized (select row_number() over () as i, vec_id, list_transform(embedding, lambda x: floor({SCALE:.0f} * x::double)::bigint) as e from embeddings
            where len(embedding) = {DIMS} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {DIMS})""",
        f"c0 as materialized (select row_number() over (order by sha256('{SEED}:' || coalesce(vec_id::varchar, 'null')), e) - 1 as c, e from v qualify c < {CLUSTERS})",
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} as materialized (select i, any_value(vec_id) as vec_id, any_value(ve) as e, arg_min(c, (d, c)) as c, min(d)::bigint as d
            from (select v.i, v.vec_id, v.e as ve, k.c, list_sum(list_transform(list_zip(v.e, k.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d from v cross join c{r} k) group by i)""")
        if r < ROUNDS:
            steps.append(f"""s{r} as (select c, p, sum(x)::bigint as s, count(*) as n from (select c, unnest(e) as x, generate_subscripts(e, 1) as p from a{r}) group by c, p),
            c{r + 1} as materialized (select k.c, coalesce(m.e, k.e) as e from c{r} k left join (select c, list((s - ((s % n) + n) % n) // n order by p) as e from s{r} group by c) m on m.c = k.c)""")
    last = f"""select vec_id, a.c::int as cluster, d as distance, (sum(d) over (partition by a.c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, sha256(array_to_string(k.e, ',')) as centroid_sha256
        from a{ROUNDS} a join c{ROUNDS} k on a.c = k.c"""
    return f"with {', '.join(steps)} {last}"


QUERIES = {"op11_centroids": op11_centroids}
ORACLE = {"op11_centroids": _oracle()}
