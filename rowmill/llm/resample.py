"""Resampling towards a target distribution by hashed n-gram importance weights.

Texts are cut at newlines, which separate words, and equal lines are counted as one: Spark groups them, the features of each
distinct line are hashed once and count as often as the line occurs. Runs of words that cross a newline, of which single words
have none, are counted from the texts and added. From the bucket counts of the corpus and of the target comes a gain for each
bucket; a second scan sums the gains of every document. Documents are drawn by Gumbel noise: the highest weight plus noise of
the id. Ranks come from ranges sorted apart and offset by their counts.

Defined cases: null text has no words, weight 0 and is never drawn; a null id is hashed as the word null; rows that repeat an id
share its noise and rank one after another; without documents of enough words nothing is drawn; without target texts every
bucket's target count is 0; an empty table gives an empty result; extra columns do not matter. Bucket counts are exact below
2**53 a task. Only the counts of the buckets, whose number is a parameter, reach the driver and the tasks. One text is held in
memory at a time.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rows import with_seq
from .common import _LOWER, Scratch, slices, word_spans

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024

#: Bytes that separate words once A-Z are a-z: ASCII but for digits and letters.
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[:0x30] = _SEPARATOR[0x3A:0x61] = _SEPARATOR[0x7B:0x80] = True
#: Words of more bytes are hashed one at a time.
LONG = 64


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def _extend(crc: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The crc32 of each byte string once data[start:end] is put after it."""
    out, size = crc ^ np.uint32(0xFFFFFFFF), ends - starts
    at = np.flatnonzero(size <= LONG)
    for j in range(LONG):
        at = at[size[at] > j]
        if not len(at):
            break
        c = out[at]
        out[at] = _CRC[(c ^ data[starts[at] + j]) & 0xFF] ^ (c >> 8)
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(crc[i]))
    return out


def _runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, part: np.ndarray, longest: int, buckets: int):
    """(first word, bucket) of all runs of 1 to `longest` consecutive words of one part."""
    at, crc, space = np.arange(len(starts)), np.zeros(len(starts), np.uint32), np.array([32], np.uint8)
    for n in range(longest):
        if n:
            more = at + n < len(starts)
            more[more] = part[at[more]] == part[at[more] + n]
            at, crc = at[more], crc[more]
            crc = _extend(crc, space, np.zeros(len(at), np.int64), np.ones(len(at), np.int64))
        crc = _extend(crc, data, starts[at + n], ends[at + n])
        yield n + 1, at, (crc % buckets).astype(np.int64)


def _histogram(hist: np.ndarray):
    at = np.flatnonzero(hist)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(hist[at])], names=["bucket", "n"])


def _of_lines(longest: int, buckets: int):
    """Bucket counts of distinct lines, each as often as it occurs."""

    def run(batches):
        hist = np.zeros(buckets, np.int64)
        for batch in batches:
            times = batch.column("times").to_numpy(zero_copy_only=False)
            for a, b, data, offs in slices(batch.column("line")):
                data = _LOWER[data]
                starts, ends, first = word_spans(data, offs, _SEPARATOR)
                line = np.repeat(np.arange(b - a), np.diff(first))
                for _, at, bucket in _runs(data, starts, ends, line, longest, buckets):
                    hist += np.bincount(bucket, times[a + line[at]], buckets).astype(np.int64)
        yield _histogram(hist)

    return run


def _across_lines(longest: int, buckets: int):
    """Bucket counts of the runs that begin in one line and end in another."""

    def run(batches):
        hist = np.zeros(buckets, np.int64)
        for batch in batches:
            for a, b, data, offs in slices(batch.column("text")):
                data = _LOWER[data]
                starts, ends, first = word_spans(data, offs, _SEPARATOR)
                text, line = np.repeat(np.arange(b - a), np.diff(first)), np.cumsum(data == 10)[starts]
                for n, at, bucket in _runs(data, starts, ends, text, longest, buckets):
                    hist += np.bincount(bucket[line[at] != line[at + n - 1]], minlength=buckets)
        yield _histogram(hist)

    return run


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How often the features of each bucket stand in the column `text`."""
    lines = texts.select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''").groupBy("line").agg(F.count(F.lit(1)).alias("times"))
    found = lines.mapInArrow(_of_lines(longest, buckets), "bucket long, n long")
    if longest > 1:
        found = found.union(texts.select("text").mapInArrow(_across_lines(longest, buckets), "bucket long, n long"))
    hist = np.zeros(buckets, np.int64)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most `buckets` rows
        hist[r.bucket] = r.n
    return hist


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket: floor of 1000 times the logarithm of its smoothed share in the target by that in the corpus."""
    k, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def _weights(shared, longest: int):
    def run(batches):
        gain = shared.value
        for batch in batches:
            for a, b, data, offs in slices(batch.column("text")):
                data = _LOWER[data]
                starts, ends, first = word_spans(data, offs, _SEPARATOR)
                text = np.repeat(np.arange(b - a), np.diff(first))
                features, weight = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
                for _, at, bucket in _runs(data, starts, ends, text, longest, len(gain)):
                    upto = np.searchsorted(text[at], np.arange(b - a + 1))
                    features += np.diff(upto)
                    weight += np.diff(np.r_[0, np.cumsum(gain[bucket])][upto])
                kept = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in kept], *[pa.array(v) for v in (np.diff(first), features, weight)]], names=[*kept, "n_words", "n_features", "weight"])

    return run


def resample(docs: DataFrame, target: DataFrame, scratch: Scratch, longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, carry=()) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document, and the columns to carry (longs); the rank of those not drawn is null."""
    spark = docs.sparkSession
    gain = spark.sparkContext.broadcast(gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets)))
    longs = ", ".join(f"{c} long" for c in ("doc_id", *carry, "n_words", "n_features", "weight"))
    weighed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, "text").mapInArrow(_weights(gain, longest), longs)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    scored = scratch.settle(weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))))
    able = F.col("n_words") >= least_words
    drawn = scored.agg(F.count_if(able).alias("n")).first().n * percent // 100
    placed = with_seq(scored, [(~able).asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "rank", settle=scratch.settle)
    return placed.withColumn("rank", F.when(able & (F.col("rank") <= drawn), F.col("rank"))).select("doc_id", *carry, "n_words", "n_features", "weight", "score", "rank")


def draw(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The documents drawn, with all their columns."""
    scratch = Scratch(docs.sparkSession, "resample")
    numbered = scratch.settle(docs.withColumn("__rm_row", F.monotonically_increasing_id()))
    rows = resample(numbered, target, scratch, carry=("__rm_row",), **options).where("rank is not null")
    return numbered.join(rows.select("__rm_row"), "__rm_row", "left_semi").drop("__rm_row")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target, Scratch(spark, "resample")).select("doc_id", "n_features", "weight", "score", "rank")


WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _oracle() -> str:
    """crc32 is made of its table, which eight steps a byte give, for every distinct word."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    step = "case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end"
    table = "select range::bigint as i, range::bigint as c from range(256)"
    for _ in range(8):
        table = f"select i, {step} as c from ({table})"
    return rf"""with d as (select row_number() over () as i, doc_id, regexp_extract_all({lower}, '{WORDS}') as ws from documents),
    dw as (select i, unnest(ws) as w from d), bw as (select unnest(regexp_extract_all({lower}, '{WORDS}')) as w from benchmark),
    tab as (select list(c order by i) as t from ({table})),
    words as (select w, hex(encode(w)) as hx from (select w from dw union select w from bw)),
    crc as (select w, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, length(hx) // 2), lambda p: ('0x' || substr(hx, p * 2 + 1, 2))::bigint)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % {BUCKETS} as b
        from words cross join tab),
    s as (select b, count(*) as n from dw join crc using (w) group by b), t as (select b, count(*) as n from bw join crc using (w) group by b),
    tot as (select (select count(*) from dw)::double as s_all, (select count(*) from bw)::double as t_all),
    gain as (select s.b, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * (s_all + {BUCKETS}) / ((s.n + 1)::double * (t_all + {BUCKETS}))))::bigint as g from s left join t using (b) cross join tot),
    x as (select i, sum(g)::bigint as weight from dw join crc using (w) join gain using (b) group by i),
    y as (select d.i, doc_id, len(ws)::bigint as n_features, coalesce(weight, 0) as weight, ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::varchar, 'null')), 1, 8))::bigint as h from d left join x using (i)),
    z as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score from y),
    r as (select *, row_number() over (partition by n_features >= {LEAST_WORDS} order by score desc, doc_id nulls last) as place, count(*) filter (n_features >= {LEAST_WORDS}) over () * {PERCENT} // 100 as n_drawn from z)
    select doc_id, n_features, weight, score, case when n_features >= {LEAST_WORDS} and place <= n_drawn then place end as rank from r"""


QUERIES = {"op13_resample": op13_resample}
ORACLE = {"op13_resample": _oracle()}
