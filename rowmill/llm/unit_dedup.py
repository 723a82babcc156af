"""Remove repeated lines, sentences and paragraphs: normalise units, group their digests globally, keep the earliest.

A unit is a line or a paragraph (lines up to an empty one) of any length, or a sentence within a line (text up to `.`, `!` or
`?` before white space), so that a passage set into a paragraph is found by the sentences it holds. A sentence of at least
`min_words` words counts alone; in scripts without spaces each character is a word. Shorter ones recur inside clean prose, so
within a line they count with their neighbours: the run of sentences that starts, or ends, with the short one and has
`min_words` words. Units are equal when they are equal after lower-casing and with white space squeezed, runs when their
sentences are. The earliest occurrence in order of doc_id and offset stays; every other is removed, whatever its length. The
byte offsets of what is removed refer to the original text; repeats with only white space between them are one region.
`least_words` above 1 spares smaller regions.

Defined cases: null text is empty and loses nothing; a unit repeated within one document loses its later occurrences; rows
equal in id and text are one document and both keep what it keeps; null ids rank first; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .spans import cut, row_key

MIN_WORDS, LEAST_WORDS = 8, 1
_BLANK = re.compile(rb"\n[ \t\r\f\v]*\n\s*")
_END = re.compile(rb"[.!?\xe3\xef](?:(?<=[.!?])\s+|(?<=\xe3)\x80\x82\s*|(?<=\xef)\xbc[\x81\x9f]\s*)")
#: Kana, Han, Thai, Lao, Burmese and Khmer are written without spaces.
_UNSPACED = re.compile("[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\U00020000-\U0003ffff]")


def _normal(piece: bytes) -> bytes:
    """The piece in lower case with single spaces."""
    if piece.isascii():
        return b" ".join(piece.lower().split())
    return " ".join(piece.decode("utf-8", "replace").lower().split()).encode()


def _count(text: bytes) -> int:
    """Words of a normalised text, or characters of scripts without spaces."""
    n = text.count(b" ") + 1 if text else 0
    return n if text.isascii() else max(n, len(_UNSPACED.findall(text.decode())))


def _split(raw: bytes):
    """Lines and paragraphs of several lines, and the sentences of all lines (a line that is not cut is one), each as (start, end, words, normalised text)."""
    at, lines, sentences = 0, [], []
    for line in raw.split(b"\n"):
        text = _normal(line)
        one = (at, at + len(line), _count(text), text)
        lines.append(one)
        begin = 0
        for m in _END.finditer(line):
            stop = m.start() + (1 if line[m.start()] < 128 else 3)
            text = _normal(line[begin:stop])
            sentences.append((at + begin, at + stop, _count(text), text))
            begin = m.end()
        if begin:
            text = _normal(line[begin:])
            one = (at + begin, at + len(line), _count(text), text)
        sentences.append(one)
        at += len(line) + 1
    starts = [u[0] for u in lines]
    at, paragraphs = 0, []
    for m in (*_BLANK.finditer(raw), None):
        end = m.start() if m else len(raw)
        if raw.find(b"\n", at, end) >= 0:
            text = b" ".join(u[3] for u in lines[bisect_right(starts, at) - 1 : bisect_right(starts, end)] if u[3])
            paragraphs.append((at, end, _count(text), text))
        at = m.end() if m else end
    return lines + paragraphs, [u for u in sentences if u[2]]


def units(raw: bytes, min_words: int) -> list[tuple[int, int, bytes]]:
    """(start, end, digest) of each paragraph and line, of each sentence with enough words, and of each run around one with fewer."""
    whole, sentences = _split(raw)
    found = {u for u in whole if u[2]} | {u for u in sentences if u[2] >= min_words}
    before = [0, *accumulate(u[2] for u in sentences)]
    runs = set()
    for i, u in enumerate(sentences):
        if u[2] < min_words:
            after, first = bisect_left(before, before[i] + min_words), bisect_right(before, before[i + 1] - min_words) - 1
            if after <= len(sentences):
                runs.add((i, after))
            if first >= 0:
                runs.add((first, i + 1))
    out = [(a, b, hashlib.blake2b(text, digest_size=16).digest()) for a, b, _, text in found]
    for i, j in runs:
        text = b"\n".join([u[3] for u in sentences[i:j]])
        out.append((sentences[i][0], sentences[j - 1][1], hashlib.blake2b(text, digest_size=16, person=b"run").digest()))
    return out


_PLACES = pa.schema([("doc_id", pa.int64()), ("k", pa.binary()), ("start", pa.int32()), ("end", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64())])


def _units(min_words: int, digests_only: bool):
    """Places and digests of all units, or for the count their first digest halves alone."""

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                found = [units((t or "").encode(), min_words) for t in part.column("text").to_pylist()]
                h = np.frombuffer(b"".join([u[2] for x in found for u in x]), np.int64).reshape(-1, 2)
                if digests_only:
                    values, n = np.unique(h[:, 0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n)], names=["d1", "n"])
                else:
                    row = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
                    places = [pa.array([u[at] for x in found for u in x], pa.int32()) for at in (0, 1)]
                    columns = [part.column("doc_id").take(row), part.column("k").take(row), *places, pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())]
                    yield pa.RecordBatch.from_arrays(columns, schema=_PLACES)

    return run


def _regions(least_words: int):
    """Spans of one text with white space alone between them as one, if they have enough words."""

    def choose(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for a, b in spans:
            if out and not raw[out[-1][1] : a].strip():
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
        return [(a, b) for a, b in out if _count(_normal(raw[a:b])) >= least_words]

    return choose


def drop_repeated_units(docs: DataFrame, min_words: int = MIN_WORDS, least_words: int = LEAST_WORDS, with_text: bool = True) -> DataFrame:
    """CUT_COLUMNS of every row: what is left of it, and the removed byte spans.

    Half digests are counted first, 8 bytes a unit with partial sums in each task. Only units whose half digest occurs twice
    are placed; the earliest place of each whole digest is a partial minimum as well, so a unit that half of all documents
    share costs one row a task. The joins are on digests with tables of counts, so Spark may split the places of a hot one.
    """
    scratch = Scratch(docs.sparkSession, "units")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("k"), F.col("text").cast("string").alias("text"))
    counts = scratch.settle(keyed.mapInArrow(_units(min_words, True), "d1 long, n long").groupBy("d1").agg(F.sum("n").alias("n")).where("n > 1").select("d1"))
    places = keyed.mapInArrow(_units(min_words, False), "doc_id long, k binary, start int, end int, d1 long, d2 long")
    places = scratch.settle(places.join(counts, "d1"))
    place = F.struct("doc_id", "k", "start")
    first = scratch.settle(places.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("d1", "d2", "first"))
    again = places.join(first, ["d1", "d2"]).where(~F.struct("doc_id", "k", "start").eqNullSafe(F.col("first"))).select("k", "start", "end").distinct()
    spans = again.groupBy("k").agg(F.collect_list(F.col("start").cast("long")).alias("starts"), F.collect_list(F.col("end").cast("long")).alias("ends"))
    return cut(docs, spans, with_text, _regions(least_words))


def op10_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_units(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False).drop("kept")


QUERIES = {"op10_unit_dedup": op10_unit_dedup}
ORACLE: dict = {}
