"""Exact top-k inner products by histogram selection.

Every query is scored against every row in blocks of matrix products. The k-th best score of each query is located by
histograms: each task counts scores by bin, the counts are summed over all tasks, the bin that holds the k-th score becomes
the next range. Then one pass keeps the scores at or above it, with ties going to the smaller id. Queries run in blocks of
bounded size, so a block's vectors fit any worker; a task reports at most k bins and its k best ties for each query.

Scores are exact below 2**53; beyond that the products of so large components are rounded, and they tie or order as rounded.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part, neither do null ids; only
vectors of equal length are compared; a query never meets a row with its own id; repeated query rows are each answered;
fewer than k candidates give them all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

BLOCK, BINS, SCALE = 4096, 512, 256.0


def _matrix(batch: pa.RecordBatch):
    """Of a batch, for each vector length: ids and integer vectors as doubles (exact below 2**53)."""
    ids, lists = batch.column("vec_id").cast(pa.int64()), batch.column("embedding")
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    ok = pc.is_valid(ids).to_numpy(zero_copy_only=False) & (lengths > 0)
    ids = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths[ok]):
        at = np.flatnonzero(ok & (lengths == d))
        flat = lists.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        x = np.floor(SCALE * flat.reshape(-1, d))
        good = np.isfinite(x).all(axis=1)
        yield ids[at[good]], x[good]


def _scores(block: dict, batches):
    """(query positions, ids, scores) in pieces; a row with the query's own id scores -inf."""
    for batch in batches:
        for first in range(0, batch.num_rows, 2048):
            for ids, x in _matrix(batch.slice(first, 2048)):
                for at, qids, q in block.get(x.shape[1], ()):
                    s = q @ x.T
                    order = np.argsort(ids, kind="stable")
                    lo, hi = np.searchsorted(ids[order], qids, "left"), np.searchsorted(ids[order], qids, "right")
                    for i in np.flatnonzero(hi > lo):
                        s[i, order[lo[i] : hi[i]]] = -np.inf
                    yield at, ids, s


def _histogram(shared, n: int):
    def run(batches):
        block, low, high, width, need = shared.value
        counts: dict[int, np.ndarray] = {}
        for at, _, s in _scores(block, batches):
            with np.errstate(invalid="ignore"):
                b = np.floor((s - low[at][:, None]) / width[at][:, None])
            inside = (b >= 0) & (s < high[at][:, None])
            rows, cols = np.nonzero(inside)
            flat = np.bincount(rows * BINS + b[rows, cols].astype(np.int64), minlength=len(at) * BINS).reshape(len(at), BINS)
            key = int(at[0])
            counts[key] = counts[key] + flat if key in counts else flat
        for key, flat in counts.items():
            above = np.cumsum(flat[:, ::-1], axis=1)[:, ::-1] - flat
            rows, cols = np.nonzero((flat > 0) & (above < need[key : key + len(flat)][:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(rows + key), pa.array(cols), pa.array(flat[rows, cols])], names=["q", "b", "n"])

    return run


def _above(shared):
    def run(batches):
        block, low, need = shared.value
        for at, ids, s in _scores(block, batches):
            rows, cols = np.nonzero((s >= low[at][:, None]) & np.isfinite(s))
            if not len(rows):
                continue
            score, vec = s[rows, cols].astype(np.int64), ids[cols]
            tie = s[rows, cols] == low[at][rows]
            order = np.lexsort((vec, tie, rows))
            rows, score, vec, tie = rows[order], score[order], vec[order], tie[order]
            group = rows * 2 + tie
            start = np.r_[0, np.flatnonzero(np.diff(group)) + 1]
            rank = np.arange(len(rows)) - np.repeat(start, np.diff(np.r_[start, len(rows)]))
            keep = ~tie | (rank < need[at][rows])
            yield pa.RecordBatch.from_arrays([pa.array((rows + at[0])[keep]), pa.array(vec[keep]), pa.array(score[keep])], names=["q", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best integer inner products of each query over all rows of vectors."""
    spark = vectors.sparkSession
    vectors, queries = vectors.select("vec_id", "embedding"), queries.select("vec_id", "embedding")
    # queries are dealt by their place, so that rows that repeat an id do not meet in one block
    queries = Scratch(spark, "top-k").settle(queries.withColumn("_b", F.monotonically_increasing_id()))
    n_blocks = -(-queries.count() // BLOCK) or 1
    reach = vectors.select(F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + (F.lit(SCALE) * F.coalesce(F.when(F.abs(x) < 1e30, x.cast("double")), F.lit(0.0)) + F.lit(1.0)) ** 2 + F.lit(4.0)))).first()[0] or 0.0
    schema = "query_id long, rank int, vec_id long, score long"
    out = None
    blocks = queries.withColumn("_b", F.pmod(F.xxhash64("_b"), F.lit(n_blocks)))
    for i in range(n_blocks):
        rows = blocks.where(F.col("_b") == i).drop("_b").toArrow()
        block, names, n = {}, [], 0
        for batch in rows.to_batches():
            for ids, x in _matrix(batch):
                for a in range(0, len(ids), 1024):
                    part = x[a : a + 1024]
                    block.setdefault(x.shape[1], []).append((np.arange(n, n + len(part)), ids[a : a + 1024], part))
                    names += ids[a : a + 1024].tolist()
                    n += len(part)
        if not n:
            continue
        norms = np.zeros(n)
        for parts in block.values():
            for at, _, q in parts:
                norms[at] = np.sqrt((q * q).sum(axis=1))
        bound = np.ceil(norms * np.sqrt(reach)) + 1
        low, high, width, need = -bound, bound + 1, np.ceil((2 * bound + 1) / BINS), np.full(n, k)
        kept_low, kept_need, open_ = np.full(n, -np.inf), np.full(n, k), np.ones(n, bool)
        while open_.any():
            shared = spark.sparkContext.broadcast((block, np.where(open_, low, np.inf), high, width, need))
            # at most k bins a query and task come out; summed, a block's counts are bounded by BLOCK x BINS
            got = vectors.mapInArrow(_histogram(shared, n), "q long, b long, n long").groupBy("q", "b").agg(F.sum("n").alias("n")).toPandas()
            hist = np.zeros((n, BINS), np.int64)
            hist[got.q, got.b] = got.n
            above = np.cumsum(hist[:, ::-1], axis=1)[:, ::-1] - hist
            hit = (above < need[:, None]) & (above + hist >= need[:, None]) & open_[:, None]
            found = hit.any(axis=1)
            b = hit.argmax(axis=1)
            i_ = np.arange(n)
            exact = above[i_, b] + hist[i_, b] == need
            low = np.where(found, low + b * width, low)
            high = np.where(found, np.minimum(high, low + width), high)
            need = np.where(found, need - above[i_, b], need)
            closed = open_ & (~found | exact | (width == 1))
            kept_low[closed & found] = low[closed & found]
            kept_need[closed] = need[closed]
            open_ &= ~closed
            width = np.where(open_, np.ceil(width / BINS), width)
        shared = spark.sparkContext.broadcast((block, kept_low, kept_need))
        best = vectors.mapInArrow(_above(shared), "q long, vec_id long, score long")
        ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
        listed = spark.createDataFrame(list(enumerate(map(int, names))), "q long, query_id long")
        part = ranked.join(F.broadcast(listed), "q").select("query_id", "rank", "vec_id", "score")
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], schema)


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows, rows.where("vec_id % 50 = 0"), 5)


QUERIES = {"op6_top_k": op6_top_k}
ORACLE = {
    "op6_top_k": """
    with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
               where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
    p as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::bigint as score
          from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(q.e) = len(c.e)),
    r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from p)
    select query_id, rank, vec_id, score from r where rank <= 5"""
}
