"""Remove every byte covered by a string of LENGTH bytes that also starts elsewhere, by a hash-compared suffix sort.

Not all suffixes travel. A window of LENGTH bytes is represented by an anchor, the k-gram of least hash in it (the leftmost,
if equal). Equal windows have equal anchors at equal distance, so only windows of one anchor and distance can be equal. The
windows of a text that share an anchor occurrence form a run; a run and the bytes it spans are a context.

1. Anchors are counted; those that occur once cannot lie in a repeated window.
2. Contexts of the others are grouped by a 128-bit cryptographic digest of their bytes with partial counts: a context that
   occurs twice is repeated as a whole, so a passage that many documents share costs a row a task, and is never brought together.
3. What is left are contexts that occur once under an anchor with other contexts, where repeats begin or end. Their bytes are
   gathered by anchor, one copy of each distinct context, and the suffixes at all their window starts are mergesorted. Two
   suffixes are compared by their common extension, found by binary search over prefix polynomial hashes in about log
   LENGTH steps; neighbours in the order that agree on LENGTH bytes are repeated, once their bytes are compared as well.
4. An anchor with more than GROUP distinct contexts would be an unbounded group for one task. Its windows are dealt over all
   tasks by 128-bit digest and counted there: the same spans come out, without a sort.

Defined cases: null text is empty; texts shorter than LENGTH lose nothing; matches within one text and overlapping ones
count; every row of an equal id and text is another place; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, mix, slices
from .spans import cut, pack, row_key, unpack

LENGTH, GRAM, GROUP = 200, 40, 4000
_WINDOW = LENGTH - GRAM + 1
_SEGMENT = 2 << 20
#: A random odd 64-bit value for each byte; prefix hashes are polynomials of them modulo 2**64. They only order and propose:
#: strings of up to LENGTH bytes are far too short for the texts that collide under every base, and equality is checked by bytes.
BYTE_VALUES = np.random.default_rng(20240607).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and _BASE**-i for i <= n, kept between batches."""
    if len(_POWERS[0]) <= n:
        size = max(n + 1, 1 << 20)
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def _prefix(data: np.ndarray) -> np.ndarray:
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(len(data))[0][: len(data)], out=h[1:])
    return h


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    pad = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    pad[:n] = x
    blocks = pad.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def runs(data: np.ndarray, offs: np.ndarray):
    """Of the texts in data: text number, anchor hash, first window in it and in data, number of windows, anchor distance of each run."""
    out = []
    for s in range(0, max(len(data) - LENGTH + 1, 0), _SEGMENT):
        piece = data[s : s + _SEGMENT + LENGTH - 1]
        n = len(piece)
        if n < LENGTH:
            break
        h, down = _prefix(piece), powers(n)[1]
        grams = mix((h[GRAM:] - h[:-GRAM]) * down[: n - GRAM + 1])
        least = _sliding_min((grams & ~np.uint64(0xFFFFFF)) | np.arange(len(grams), dtype=np.uint64), _WINDOW)
        at = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        doc = np.searchsorted(offs, np.arange(s, s + len(at)), "right") - 1 if len(offs) > 2 else np.zeros(len(at), np.int64)
        ok = np.arange(s, s + len(at)) + LENGTH <= offs[doc + 1]
        new = ok.copy()
        new[1:] &= ~ok[:-1] | (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
        last = ok.copy()
        last[:-1] &= ~ok[1:] | new[1:]
        lo, hi = np.flatnonzero(new), np.flatnonzero(last)
        out.append((doc[lo], grams[at[lo]], lo + s - offs[doc[lo]], lo + s, hi - lo + 1, at[lo] - lo))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 6


def _digests(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """128 bits of a cryptographic hash of each piece of raw."""
    view, blake = memoryview(raw), hashlib.blake2b
    flat = b"".join(blake(view[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist()))
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.arange(len(starts) + 1, dtype=np.int32) * 16), pa.py_buffer(flat)])


def _anchors(only_hash: bool):
    def run(batches):
        for batch in batches:
            keys = batch.column("k")
            for a, b, data, offs in slices(batch.column("text")):
                doc, h, lo, at, w, j = runs(data, offs)
                if only_hash:
                    values, n = np.unique(h, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.uint64).view(np.int64)), pa.array(n)], names=["h", "n"])
                else:
                    k = keys.slice(a, b - a).take(pa.array(doc))
                    place = (lo.astype(np.int64) << 16) | (w.astype(np.int64) << 8) | j.astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.uint64).view(np.int64)), k, pa.array(place), _digests(data.tobytes(), at, at + w + LENGTH - 1)], names=["h", "k", "place", "d"])

    return run


class Suffixes:
    """Suffixes of a buffer, compared by prefix hashes over at most LENGTH bytes."""

    def __init__(self, data: np.ndarray):
        self.data, self.h, self.down = data, _prefix(data), powers(len(data))[1]

    def common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros(len(p), np.int64), np.full(len(p), LENGTH)
        hp, hq, dp, dq = self.h[p], self.h[q], self.down[p], self.down[q]
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi + 1) >> 1
            same = (self.h[p + mid] - hp) * dp == (self.h[q + mid] - hq) * dq
            lo, hi = np.where(open_ & same, mid, lo), np.where(open_ & ~same, mid - 1, hi)

    def compare(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        n = self.common(p, q)
        at = np.minimum(n, LENGTH - 1)
        return np.where(n == LENGTH, 0, self.data[p + at].astype(np.int64) - self.data[q + at])

    def sort(self, at: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Suffixes at, in order within each segment; start and size give every element's segment."""
        at, r = at.copy(), 1
        here = np.arange(len(at))
        while len(size) and r < size.max():
            o = here - start
            run = o // r
            other = (run ^ 1) * r
            busy = np.flatnonzero((size > r) & (other < size))
            left, base = (run[busy] & 1) == 0, start[busy] + other[busy]
            lo, hi = np.zeros(len(busy), np.int64), np.minimum(r, size[busy] - other[busy])
            while True:
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) >> 1
                c = self.compare(at[base[open_] + mid], at[busy[open_]])
                before = np.where(left[open_], c < 0, c <= 0)
                lo[open_], hi[open_] = np.where(before, mid + 1, lo[open_]), np.where(before, hi[open_], mid)
            to = here.copy()
            to[busy] = start[busy] + (run[busy] // 2) * 2 * r + (o[busy] - run[busy] * r) + lo
            moved = np.empty_like(at)
            moved[to] = at
            at, r = moved, r * 2
        return at

    def equal(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether LENGTH bytes agree, byte by byte."""
        views = np.lib.stride_tricks.sliding_window_view(self.data, LENGTH)
        return np.concatenate([(views[p[i : i + 8192]] == views[q[i : i + 8192]]).all(axis=1) for i in range(0, len(p), 8192)] or [np.zeros(0, bool)])


def repeated_windows(data: np.ndarray, base: np.ndarray, w: np.ndarray, j: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, window, repeated) for all windows of contexts: base is where a context's bytes begin, group its anchor."""
    context = np.repeat(np.arange(len(w)), w)
    rel = np.arange(len(context)) - np.repeat(np.cumsum(w) - w, w)
    kind = group[context] * 256 + (j[context] - rel)
    order = np.argsort(kind, kind="stable")
    kinds = kind[order]
    new = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]])
    size = np.diff(np.r_[new, len(kinds)])
    start, size = np.repeat(new, size), np.repeat(size, size)
    more = size > 1
    flags = np.zeros(len(context), bool)
    if more.any():
        order, kept = order[more], np.flatnonzero(more)
        start, size = np.searchsorted(kept, start[more]), size[more]
        at = base[context[order]] + rel[order]
        s = Suffixes(data)
        ranked = s.sort(at, start, size)
        same_segment = start[1:] == start[:-1]
        i = np.flatnonzero(same_segment)
        i = i[s.common(ranked[i], ranked[i + 1]) == LENGTH]
        true = s.equal(ranked[i], ranked[i + 1])
        hit = np.zeros(len(ranked), bool)
        hit[i[true]] = hit[i[true] + 1] = True
        if not true.all():  # hashes collided: the segments concerned are compared as bytes
            for b in np.unique(start[i[~true]]).tolist():
                seen: dict = {}
                for p in range(b, b + int(size[b])):
                    seen.setdefault(data[ranked[p] : ranked[p] + LENGTH].tobytes(), []).append(p)
                for places in seen.values():
                    hit[places] = len(places) > 1
        flags[order] = np.isin(at, ranked[hit])
    return context, rel, flags


def _spans_of(keys, lo, context, rel, flags):
    """(k, start, end) of each maximal run of repeated windows."""
    on = np.flatnonzero(flags)
    if not len(on):
        return None
    new = np.r_[True, (np.diff(on) > 1) | (np.diff(context[on]) > 0)]
    first = on[new]
    last = on[np.r_[np.flatnonzero(new)[1:] - 1, len(on) - 1]]
    c = context[first]
    return pa.RecordBatch.from_arrays([keys.take(pa.array(c)), pa.array(lo[c] + rel[first]), pa.array(lo[c] + rel[last] + LENGTH)], names=["k", "start", "end"])


def _sorted(batches):
    """Spans of contexts that occur once, from rows (h, k, place, n, bytes) that arrive ordered by h."""

    def solve(rows):
        h = rows.column("h").to_numpy()
        place, n = rows.column("place").to_numpy(), rows.column("n").to_numpy()
        raw = rows.column("bytes").to_pylist()
        base = np.r_[0, np.cumsum([len(x) for x in raw])]
        w, j, lo = (place >> 8) & 0xFF, place & 0xFF, place >> 16
        group = np.cumsum(np.r_[0, (np.diff(h) != 0).astype(np.int64)])
        context, rel, flags = repeated_windows(np.frombuffer(b"".join(raw), np.uint8), base[:-1], w, j, group)
        return _spans_of(rows.column("k"), lo, context, rel, flags & (n[context] == 1))

    held: list = []
    for batch in batches:
        for a in range(0, batch.num_rows, 2000):
            held.append(batch.slice(a, 2000))
            rows = pa.Table.from_batches(held).combine_chunks()
            if rows.num_rows < 2000:
                continue
            h = rows.column("h").to_numpy()
            cut_at = int(np.searchsorted(h, h[-1]))  # the last anchor may go on in the next batch
            if cut_at:
                got = solve(rows.slice(0, cut_at).combine_chunks().to_batches()[0])
                if got is not None:
                    yield got
                held = rows.slice(cut_at).to_batches()
    if held:
        rows = pa.Table.from_batches(held).combine_chunks()
        if rows.num_rows:
            got = solve(rows.to_batches()[0])
            if got is not None:
                yield got


def _bytes_of(batches):
    """(h, k, place, n, bytes) of the contexts listed with each packed text."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            raw, k = unpack(row, 0), row.column("k")[0].as_py()
            items = row.column("items")[0].as_py()
            for a in range(0, len(items), 20000):
                part = items[a : a + 20000]
                pieces = [raw[x["place"] >> 16 : (x["place"] >> 16) + ((x["place"] >> 8) & 0xFF) + LENGTH - 1] for x in part]
                columns = [pa.array([x["h"] for x in part], pa.int64()), pa.array([k] * len(part), pa.binary()), pa.array([x["place"] for x in part], pa.int64()), pa.array([x["n"] for x in part], pa.int64()), pa.array([x["many"] for x in part], pa.bool_()), pa.array(pieces, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "k", "place", "n", "many", "bytes"])


def _windows(batches):
    """(k, start, w1, w2) of every window of contexts under crowded anchors."""
    for batch in batches:
        for x in batch.to_pylist():
            lo, w = x["place"] >> 16, (x["place"] >> 8) & 0xFF
            d = np.frombuffer(b"".join(hashlib.blake2b(x["bytes"][i : i + LENGTH], digest_size=16).digest() for i in range(w)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array([x["k"]] * w, pa.binary()), pa.array(lo + np.arange(w)), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())], names=["k", "start", "w1", "w2"])


def repeated_spans(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(k, starts, ends): byte spans of docs (text) to remove, by row key. Spans may overlap."""
    texts = docs.select(row_key().alias("k"), F.col("text").cast("string").alias("text"))
    # what is joined to places is a table of its own each time, so that Spark can split the places of a hot key
    twice = scratch.settle(texts.mapInArrow(_anchors(True), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"))
    live = scratch.settle(texts.mapInArrow(_anchors(False), "h long, k binary, place long, d binary").join(twice, "h"))
    shape = F.col("place").bitwiseAND(F.lit(0xFFFF))
    contexts = live.groupBy("h", "d", shape.alias("shape")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "place")).alias("p"))
    contexts = scratch.settle(contexts.select("h", "d", "shape", "n", "p.k", "p.place"))
    whole = live.withColumn("shape", shape).join(contexts.where("n > 1").select("h", "d", "shape"), ["h", "d", "shape"])
    lo = F.shiftright("place", 16)
    whole = whole.select("k", lo.alias("start"), (lo + F.shiftright("place", 8).bitwiseAND(F.lit(0xFF)) + (LENGTH - 1)).alias("end"))
    edges = contexts.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("n") == 1).alias("single")).where("m > 1 and single > 0")
    asked = contexts.join(scratch.settle(edges.select("h", (F.col("m") > GROUP).alias("many"))), "h")
    asked = asked.groupBy("k").agg(F.collect_list(F.struct("h", "place", "n", "many")).alias("items"))
    packed = pack(docs.select(F.lit(None).cast("long").alias("doc_id"), row_key().alias("k"), F.col("text").cast("string").alias("text")))
    found = scratch.settle(packed.join(asked, "k").mapInArrow(_bytes_of, "h long, k binary, place long, n long, many boolean, bytes binary"))
    few = found.where("not many").repartition("h").sortWithinPartitions("h").select("h", "k", "place", "n", "bytes")
    spans = few.mapInArrow(_sorted, "k binary, start long, end long")
    many = scratch.settle(found.where("many").select("k", "place", "bytes").mapInArrow(_windows, "k binary, start long, w1 long, w2 long").distinct())
    again = many.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2")
    crowded = many.join(scratch.settle(again), ["w1", "w2"]).select("k", "start", (F.col("start") + LENGTH).alias("end"))
    out = whole.union(spans).union(crowded)
    return out.groupBy("k").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))


def drop_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """CUT_COLUMNS of every row of docs (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "repeats")
    return cut(docs, repeated_spans(docs, scratch), with_text)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
ORACLE: dict = {}
