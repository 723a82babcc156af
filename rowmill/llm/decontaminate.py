"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into passages of `WIDTH` words that start every `STEP` words. A passage is a TF-IDF vector over the
benchmark's words, with document counts from all documents. A randomised SVD of the matrix of all passages finds the latent
space: every task multiplies its passages by a random matrix and back, the products are summed over the corpus, and from them
the leading singular values and right singular vectors follow (the single-view form for A'A: shift, Cholesky factor, small
SVD). Passages and benchmark items are compared by cosine in that space; of a candidate, the part along the item must reach
`HELD` of the item's length. Words in more than a fifth of the documents tell passages apart badly and weigh nothing there;
items of which less than `WEIGHING` of the words weigh anything skip the gate, so a passage that most documents hold, or one
of common words, is found all the same. A candidate is confirmed on the words themselves, all of them: the longest common
subsequence with the passage and its neighbours must cover `COVER` of the item's words, and `ANSWER` of its last words, where
the answer stands.

Items of over `WIDTH` words are cut into pieces of about equal length, each looked up by itself; those found with at least
`PIECE` of their words count together against the whole item's length and the whole item's last words. The benchmark is taken
in blocks by a hash of id and text that hold about `ITEMS` passages, so what each task holds (vocabulary x `RANK` numbers) is
bounded. Documents are read three times a block and never shuffled. Before the subsequence is computed, word signatures tell
how many of an item's words the neighbourhood lacks; each one lacking shortens the subsequence by one.

Defined cases: null or empty texts and items match nothing; items of fewer than `SHORTEST` words are too short to tell and
match nothing; a document is reported once for each item, with its best passages; items equal in id and text are one; of
passages that share equally many words the first is reported; rows that repeat are each reported; an empty table on either
side gives no rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, packed, slices, small, span_hashes, word_spans
from .spans import row_key
from .toxicity import _SPLIT, fold

WIDTH, STEP, RANK, ITEMS, SHORTEST, SIGNATURE = 64, 32, 64, 4000, 6, 1024
COSINE, HELD, COVER, PIECE, ANSWER, STOP, WEIGHING = 0.1, 0.3, 0.7, 0.5, 0.5, 0.2, 0.5
#: Columns of the random matrix beyond the rank.
OVERSAMPLE = 16
#: What a task makes at a time: rows of table for so many words, pairs of passage and item, signatures of half passages, rows of a result.
HITS, PAIRS, HALVES, ROWS = 1 << 14, 1 << 18, 4096, 4096


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and where each text's begin (one more at the end)."""
    low = fold(data)
    starts, ends, first = word_spans(low, offs, _SPLIT)
    return span_hashes(low, starts, ends), first


def _lookup(vocab: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in h that are in vocab (sorted), and their places there."""
    table = np.zeros(1 << 16, bool)
    table[(vocab & np.uint64(0xFFFF)).astype(np.int64)] = True
    at = np.flatnonzero(table[(h & np.uint64(0xFFFF)).astype(np.int64)])
    place = np.minimum(np.searchsorted(vocab, h[at]), len(vocab) - 1)
    ok = vocab[place] == h[at]
    return at[ok], place[ok]


def _counts(shared):
    def run(batches):
        vocab = shared.value
        n, texts = np.zeros(len(vocab), np.int64), 0
        for batch in batches:
            for _, _, data, offs in slices(batch.column("text")):
                h, first = words_of(data, offs)
                at, term = _lookup(vocab, h)
                doc = np.searchsorted(first, at, "right") - 1
                n += np.bincount(np.unique(doc.astype(np.int64) * len(vocab) + term) % len(vocab), minlength=len(vocab))
                texts += len(offs) - 1
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.flatnonzero(n), -1]), pa.array(np.r_[n[n > 0], texts])], names=["term", "n"])

    return run


class _Passages:
    """Passages of a run of texts, as half passages of STEP words whose sums make up the passages."""

    def __init__(self, vocab, idf, h, first):
        at, term = _lookup(vocab, h)
        keep = idf[term] > 0
        self.at, self.term = at[keep], term[keep]
        self.blocks = np.maximum(1, -(-np.diff(first) // STEP))
        self.base = np.r_[0, np.cumsum(self.blocks)]
        self.doc = np.searchsorted(first, self.at, "right") - 1
        self.block = self.base[self.doc] + (self.at - first[self.doc]) // STEP
        self.last = np.zeros(int(self.base[-1]) + 1, bool)
        self.last[self.base[1:] - 1] = True
        self.weight = idf[self.term]
        new = np.flatnonzero(np.r_[True, np.diff(self.block) > 0]) if len(self.block) else np.zeros(0, np.int64)
        self.new, self.rows = new, self.block[new]

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Of each half passage's hits, then of each passage: itself and the next one of the same text."""
        out = np.zeros((int(self.base[-1]) + 1, x.shape[1]), x.dtype)
        if len(self.rows):
            out[self.rows] = np.add.reduceat(x, self.new, axis=0)
        out[:-1] += np.where(self.last[:-1, None], 0, out[1:])
        return out

    def vectors(self, table: np.ndarray) -> np.ndarray:
        """Of each passage, the weighted sum of its terms' rows of table."""
        out = np.zeros((int(self.base[-1]) + 1, table.shape[1]), table.dtype)
        bounds, a = np.r_[self.new, len(self.term)], 0
        while a < len(self.new):
            b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + HITS, "right")) - 1)
            some = slice(bounds[a], bounds[b])
            x = table[self.term[some]]
            x *= self.weight[some, None].astype(table.dtype)
            out[self.rows[a:b]] = np.add.reduceat(x, self.new[a:b] - bounds[a], axis=0)
            a = b
        out[:-1] += np.where(self.last[:-1, None], 0, out[1:])
        return out

    def norms(self) -> np.ndarray:
        return np.sqrt(self.sums((self.weight**2)[:, None])[:, 0])


def _sketch(shared):
    def run(batches):
        vocab, idf, omega = shared.value
        w = np.zeros((len(vocab), omega.shape[1]), np.float64)
        for batch in batches:
            for _, _, data, offs in slices(batch.column("text")):
                p = _Passages(vocab, idf, *words_of(data, offs))
                if not len(p.term):
                    continue
                norm = np.maximum(p.norms(), 1e-9)[:, None].astype(np.float32)
                y = p.vectors(omega) / norm**2
                back = y.copy()  # what every hit of a half passage gets: from its passage and the one before
                back[1:] += np.where(p.last[:-1, None], 0, y[:-1])
                order = np.argsort(p.term, kind="stable")
                for a in range(0, len(order), HITS):
                    some = order[a : a + HITS]
                    t = p.term[some]
                    new = np.flatnonzero(np.r_[True, np.diff(t) > 0])
                    x = back[p.block[some]]
                    x *= p.weight[some, None].astype(np.float32)
                    w[t[new]] += np.add.reduceat(x, new, axis=0)
        rows = np.flatnonzero(w.any(axis=1))
        for a in range(0, len(rows), ROWS):
            some = rows[a : a + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * w.shape[1]), pa.array(w[some].ravel()))], names=["term", "y"])

    return run


def _signatures(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """For each row, the set of its word hashes as SIGNATURE bits. Rows ascend."""
    out = np.zeros((rows, SIGNATURE // 64), np.uint64)
    for a in range(0, rows, HALVES):
        lo, hi = np.searchsorted(row, (a, a + HALVES))
        bits = np.zeros((min(HALVES, rows - a), SIGNATURE), bool)
        bits[row[lo:hi] - a, (h[lo:hi] >> np.uint64(20)).astype(np.int64) % SIGNATURE] = True
        out[a : a + HALVES] = np.packbits(bits, axis=1).view(np.uint64)
    return out


def common_length(masks: dict, m: int, words) -> int:
    """Length of the longest common subsequence, bit-parallel over the m words of the pattern."""
    full = (1 << m) - 1
    v = full
    for w in words:
        x = masks.get(w)
        if x:
            u = v & x
            v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


def _masks(words) -> dict:
    out: dict = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


class Item(NamedTuple):
    """A benchmark item's number in its block and id, its words and how many of the last are its answer, both in all and in this piece."""

    number: int
    item_id: int | None
    words: list[int]
    tail: int
    total: int
    answer: int


def _pieces_of(rows) -> list[Item]:
    """Pieces of at most WIDTH words, of about equal length, of the items (item_id, text)."""
    out = []
    for number, (item, text) in enumerate(rows):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        h, _ = words_of(raw, np.array([0, len(raw)]))
        n = len(h)
        if n >= SHORTEST:
            answer, m = max(3, n // 5), -(-n // WIDTH)
            for i in range(m):
                a, b = i * n // m, (i + 1) * n // m
                out.append(Item(number, item, h[a:b].tolist(), max(0, b - max(a, n - answer)), n, answer))
    return out


def latent_space(sketch: np.ndarray, omega: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading right singular vectors, as columns, and singular values of A, from sketch = A'A omega."""
    nu = np.finfo(np.float64).eps * max(np.linalg.norm(sketch), 1e-30) * np.sqrt(len(sketch))
    shifted = sketch + nu * omega
    core = omega.T @ shifted
    core = (core + core.T) / 2
    values, vectors = np.linalg.eigh(core)
    good = values > max(values.max(), 0) * 1e-12
    if not good.any():
        return np.zeros((len(sketch), 0)), np.zeros(0)
    half = shifted @ (vectors[:, good] / np.sqrt(values[good]))
    u, s, _ = np.linalg.svd(half, full_matrices=False)
    s = np.sqrt(np.maximum(s**2 - nu, 0))
    keep = np.flatnonzero(s > s[0] * 1e-7)[:rank] if len(s) else np.zeros(0, np.int64)
    return u[:, keep], s[keep]


def _confirmed(shared):
    def run(batches):
        vocab, idf, basis, items, vectors, norms, latent = shared.value
        masks = [(_masks(x.words), _masks(x.words[len(x.words) - x.tail :]), len(x.words), x.tail) for x in items]
        item_bits = _signatures(np.concatenate([np.array(x.words, np.uint64) for x in items]), np.repeat(np.arange(len(items)), [len(x.words) for x in items]), len(items))
        least = np.array([int(np.ceil((COVER if x.total == len(x.words) else PIECE) * len(x.words))) for x in items])
        spare = np.array([len(x.words) for x in items]) - least
        light = np.array([np.mean(idf[np.searchsorted(vocab, np.array(x.words, np.uint64))] > 0) < WEIGHING for x in items])
        at_once = max(1, PAIRS // len(items))
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("k")
            for a, _, data, offs in slices(batch.column("text")):
                out = []
                h, first = words_of(data, offs)
                p = _Passages(vocab, idf, h, first)
                if not len(p.term) and not light.any():
                    continue
                size = p.norms()
                doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
                near = _signatures(h, p.base[doc] + (np.arange(len(h)) - first[doc]) // STEP, int(p.base[-1]) + 1)
                near = np.pad(near, ((1, 2), (0, 0)))
                near = near[:-3] | near[1:-2] | near[2:-1] | near[3:]  # of a half passage, the one before and the two after
                z = p.vectors(basis)
                length = np.maximum(np.sqrt((z * z).sum(axis=1)), 1e-9)
                z /= length[:, None]
                rows = np.arange(int(p.base[-1])) if light.any() else np.flatnonzero(size > 0)
                best: dict = {}
                for r in range(0, len(rows), at_once):
                    some = rows[r : r + at_once]
                    cos = z[some] @ vectors.T
                    # what else a passage holds dilutes the cosine; its part along an item that it covers stays
                    along = cos * length[some][:, None] >= HELD * latent[None, :]
                    gate = (cos >= COSINE) & along & (size[some][:, None] > 0) & (size[some][:, None] >= 0.4 * norms[None, :])
                    i, j = np.nonzero(gate | light[None, :])
                    # every word of an item that is missing takes one from the common subsequence
                    few = np.concatenate([np.bitwise_count(item_bits[j[c : c + HITS]] & ~near[some[i[c : c + HITS]]]).sum(axis=1) <= spare[j[c : c + HITS]] for c in range(0, len(i), HITS)] or [np.zeros(0, bool)])
                    i, j = i[few], j[few]
                    doc = np.searchsorted(p.base, some[i], "right") - 1
                    for b, q, d, c in zip(some[i].tolist(), j.tolist(), doc.tolist(), cos[i, j].tolist()):
                        lo = int(first[d]) + (b - int(p.base[d]) - 1) * STEP
                        lo, hi = max(lo, int(first[d])), min(lo + WIDTH + 2 * STEP, int(first[d + 1]))
                        words = h[lo:hi].tolist()
                        every, last, m, k = masks[q]
                        n = common_length(every, m, words)
                        if n >= least[q]:
                            tail = common_length(last, k, words) if k else 0
                            pieces = best.setdefault((d, items[q].number), {})
                            if q not in pieces or (n, tail) > pieces[q][:2]:
                                pieces[q] = (n, tail, c, lo - int(first[d]), hi - int(first[d]))
                for (d, _), pieces in best.items():
                    one, (n, tail, c, lo, hi) = items[next(iter(pieces))], zip(*pieces.values())
                    if sum(n) >= COVER * one.total and sum(tail) >= ANSWER * one.answer:
                        out.append((ids[a + d].as_py(), keys[a + d].as_py(), one.item_id, sum(n) / one.total, max(c), min(lo), max(hi)))
                if not out:
                    continue
                cols = list(zip(*out))
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "k", "item_id", "covered", "cosine", "first_word", "last_word"])

    return run


LEAK_COLUMNS = "doc_id long, k binary, item_id long, covered double, cosine double, first_word long, last_word long"


def leaks(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> DataFrame:
    """LEAK_COLUMNS: each row of docs (doc_id, text) that holds an item of benchmark (item_id, text), or a paraphrase of it."""
    spark = docs.sparkSession
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("k"), F.col("text").cast("string").alias("text"))
    only = docs.select(F.col("text").cast("string").alias("text"))
    passages = bench.agg(F.sum(F.ceil((F.length("text") + 1) / (4 * WIDTH)))).first()[0] or 0
    n_blocks = max(1, -(-int(passages) // ITEMS))
    out = None
    for i in range(n_blocks):
        rows = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == i).collect()  # about ITEMS passages
        items = _pieces_of(sorted(((r.item_id, r.text) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1])))
        if not items:
            continue
        vocab = np.unique(np.concatenate([np.array(x.words, np.uint64) for x in items]))
        shared = spark.sparkContext.broadcast(vocab)
        counted = packed(only.mapInArrow(_counts(shared), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")), len(vocab) * 16).toPandas().set_index("term").n
        total = int(counted.get(-1, 0))
        n = np.zeros(len(vocab))
        n[counted.index[counted.index >= 0]] = counted[counted.index >= 0]
        idf = np.where(n <= max(2, STOP * total), np.log((total + 1) / (n + 1)) + 0.1, 0.0)
        omega = np.random.default_rng(11).standard_normal((len(vocab), rank + OVERSAMPLE)).astype(np.float32)
        width = omega.shape[1]
        shared = spark.sparkContext.broadcast((vocab, idf, omega))
        sums = only.mapInArrow(_sketch(shared), "term long, y array<double>").groupBy("term").agg(F.array(*[F.sum(F.col("y")[j]) for j in range(width)]).alias("y"))
        got = packed(sums, len(vocab) * width * 8).toPandas()  # one row for each benchmark word of the block
        w = np.zeros((len(vocab), width))
        if len(got):
            w[got.term.to_numpy()] = np.stack(got.y.to_numpy())
        terms = [np.searchsorted(vocab, np.array(x.words, np.uint64)) for x in items]
        for t in terms:  # items count as passages, so that words no document has are in the space as well
            x = idf[t] / max(np.sqrt((idf[t] ** 2).sum()), 1e-9)
            np.add.at(w, t, x[:, None] * (x @ omega[t])[None, :])
        basis = latent_space(w, omega.astype(np.float64), rank)[0].astype(np.float32)
        vectors, norms, latent = np.zeros((len(items), basis.shape[1]), np.float32), np.zeros(len(items)), np.zeros(len(items))
        for q, t in enumerate(terms):
            v = (basis[t] * idf[t][:, None]).sum(axis=0)
            latent[q] = np.linalg.norm(v)
            vectors[q], norms[q] = v / max(latent[q], 1e-9), np.sqrt((idf[t] ** 2).sum())
        shared = spark.sparkContext.broadcast((vocab, idf, basis, items, vectors, norms, latent))
        part = texts.mapInArrow(_confirmed(shared), LEAK_COLUMNS)
        out = part if out is None else out.union(part)
    if out is None:
        return spark.createDataFrame([], LEAK_COLUMNS)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold benchmark items."""
    scratch = Scratch(docs.sparkSession, "leaks")
    out = scratch.settle(leaks(docs, benchmark).select(F.col("k").alias("__rm_key")).distinct())
    return docs.withColumn("__rm_key", row_key()).join(small(out, out.count(), 24), "__rm_key", "left_anti").select(docs.columns)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("k")


QUERIES = {"op1_decontaminate": op1_decontaminate}
ORACLE: dict = {}
