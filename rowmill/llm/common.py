"""Helpers the corpus operators share: scratch tables in the cluster's shared folder, byte hashing, connected components."""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import shared_root

#: A side is broadcast only when it is counted or summed first and lies below this many bytes; beyond it the join shuffles.
BROADCAST_BYTES = 24_000_000
#: A task of a packed table reads about this many bytes.
TASK_BYTES = 8 << 20


def _delete(spark: SparkSession, *paths: str) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_LEFT: list[str] = []


def clear(spark: SparkSession) -> None:
    """Delete every scratch table of this session; results that still read one must be written before."""
    _delete(spark, *_LEFT)
    _LEFT.clear()


@atexit.register
def _at_exit() -> None:
    spark = SparkSession.getActiveSession() if _LEFT and SparkContext._active_spark_context else None
    if spark is not None:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            clear(spark)


class Scratch:
    """Tables written once to the shared folder, so that lineage ends there and a lost executor costs one reread.

    Steps drop tables that nothing reads any more; what a result still reads goes at the end of the session.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0
        _LEFT.append(self.root)

    def settle(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._rowmill_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        _delete(self.spark, *(t._rowmill_path for t in tables))


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its counted rows fit the bound; otherwise as it is."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def packed(df: DataFrame, size: int) -> DataFrame:
    """df, the result of a shuffle of about `size` counted bytes, in no more tasks than these need. A shuffle deals the smallest
    table over all its partitions, and each costs a task and a file in every step; large tables stay as they are."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-int(size) // TASK_BYTES)))


# ---- bytes of a batch of texts -------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Spans of more bytes than this are hashed by blake2b, one at a time.
LONG = 256
#: Masks of the first n bytes of a little-endian word of 8.
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(32)
    return h


def slices(column: pa.Array, limit: int = 1 << 20):
    """(first row, last row + 1, bytes, offsets from 0) of runs of whole texts with about `limit` bytes each; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a, n = 0, len(column)
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n, a + 20_000)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def word_spans(data: np.ndarray, offs: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of every text, and for each text the number of words before it (one more entry at the end)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    w = ~space[data]
    edge = np.unique(offs[(offs > 0) & (offs < n)])
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = w[:-1]
    before[edge] = False
    starts = np.flatnonzero(w & ~before)
    before[:-1] = w[1:]
    before[-1] = False
    before[edge - 1] = False
    ends = np.flatnonzero(w & ~before) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, folded: bool = True) -> np.ndarray:
    """A 64-bit hash of each span of bytes, by default with A-Z as a-z.

    Eight bytes at a time pass through `mix`, which is one to one and not linear, so that no family of texts collides the
    way Thue-Morse strings do under every polynomial modulo 2**64. Spans of equal length up to 8 bytes never collide.
    """
    data = _LOWER[data] if folded else data
    words = np.lib.stride_tricks.sliding_window_view(np.r_[data, np.zeros(8, np.uint8)], 8)
    size = (ends - starts).astype(np.int64)
    h = mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    at = np.flatnonzero((size > 0) & (size <= LONG))
    for j in range(0, LONG, 8):
        if not len(at):
            break
        block = np.ascontiguousarray(words[starts[at] + j]).view(np.uint64).ravel() & FIRST_BYTES[np.minimum(size[at] - j, 8)]
        h[at] = mix(h[at] * np.uint64(0xA24BAED4963EE407) ^ block)
        at = at[size[at] > j + 8]
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def int_lists(values: np.ndarray, offs: np.ndarray, kind=None) -> pa.Array:
    """An Arrow list array over flat values."""
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(values if kind is None else values.astype(kind)))


# ---- connected components ------------------------------------------------------------------------------------------


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, most: int) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node reachable;
    there are about `most` edges.

    Alternates large-star and small-star steps, each a grouped minimum and a join, until nothing changes; every round is
    written to the shared folder. No neighbour list is ever gathered. Minima of few edges are broadcast; others are tables of
    their own, so that Spark can split the side where one node has most of the edges.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b") % 1_000_003), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())

    e = scratch.settle(packed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), most * 64))
    now = state(e)
    while now[0]:
        size = now[0] * 64
        few = size <= BROADCAST_BYTES
        minima = F.broadcast if few else scratch.settle
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = minima(packed(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), size))
        large = packed(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), size)
        large = large if few else scratch.settle(large)
        least = minima(packed(large.groupBy("a").agg(F.min("b").alias("m")), size))
        step = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
        nxt = scratch.settle(packed(step.where("a <> b").distinct(), size))
        # settled when every node has one parent and no parent has a parent, that is when the edge set stays the same
        before, now = now, state(nxt)
        scratch.drop(e, *(() if few else (large, low, least)))
        e = nxt
        if now == before:
            break
    roots = packed(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct(), now[0] * 64)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
