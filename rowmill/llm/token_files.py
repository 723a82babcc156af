"""Token ids in grammar-compressed files, with random access.

Documents are dealt by ranges of doc_id, and of a hash of the text where ids repeat, and sorted, so the files hold them in
ascending order. Each task encodes whole texts, ends each with an id, and closes a shard once it holds `SHARD` ids. A shard is
compressed by Re-Pair: in each round the most frequent pairs of neighbouring symbols get nonterminals and are replaced from
left to right, and rounds go on while one shortens the shard by a share of `GAIN`. A shard is one row of
a Parquet file: the remaining symbols, the rules (left, right), every rule's expansion length, and for each document its id
and number of ids. Cumulated expansion lengths tell which symbols hold a range of ids, so one document is decoded without
the rest of its shard.

Encoding: white space that follows a non-space, and a sign that follows an ASCII letter or digit, begin a new pre-token in this
kind of byte-level BPE, so pieces cut there encode alike alone and in place. Pieces met before are looked up by hash and
compared byte by byte; new ones go to the library many at a time. Pieces that begin with white space and end without it stand
one after another there, as in a text, and the lengths of the tokens tell where each ends; the others are set apart by a
special token. The table of pieces is bounded
in pieces and bytes; when it is full, those met again since stay and the others go. A text with white space outside ASCII, or with a special token's
string, and a piece of over `LONG` bytes go to the tokenizers library each time and are not kept.

Defined cases: null and empty texts give the end id alone; null ids come first; rows that repeat an id are each written, in
order of a hash of their text; an empty table gives an empty file set and no rows.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import FIRST_BYTES, LONG, Scratch, slices, small, span_hashes

SHARD, GAIN, RULES_A_ROUND, LEAST = 1 << 20, 0.01, 2048, 12
_TABLE, _SECOND, PIECES, PIECE_BYTES, AT_ONCE = 1 << 21, 32, 500_000, 16 << 20, 500
_BREAK = np.zeros(256, bool)
_BREAK[[32, 9, 10, 11, 12, 13]] = True
_ALNUM, _SIGN = np.zeros(256, bool), np.zeros(256, bool)
_ALNUM[np.r_[48:58, 65:91, 97:123]] = True
_SIGN[np.r_[33:39, 40:48, 58:65, 91:97, 123:127]] = True  # an apostrophe may join what it stands between


def _spans(at: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Every position of spans that begin at `at`, one span after another."""
    return np.repeat(at - np.cumsum(lens) + lens, lens) + np.arange(int(lens.sum()))


class Encoder:
    """Whole texts to ids, with a table of the pieces met so far in this worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.base = self.lib.get_vocab_size(with_added_tokens=True)
        added = self.lib.get_added_tokens_decoder()
        self.special = [t.content.encode() for t in added.values()]
        # a token that sets texts apart: always matched as it stands, and no end of it is its beginning
        whole = [(i, t.content) for i, t in sorted(added.items()) if not (t.normalized or t.lstrip or t.rstrip or t.single_word) and not any(t.content.endswith(t.content[:n]) for n in range(1, len(t.content)))]
        self.apart = whole[0] if whole else None
        # bytes of each token: the byte-level alphabet has a character for each byte
        vocab = self.lib.get_vocab(with_added_tokens=False)
        self.bytes = np.zeros(max([*vocab.values(), *added, 0]) + 1, np.int64)
        self.bytes[list(vocab.values())] = list(map(len, vocab))
        self.joins = not any(set(s) & set(np.flatnonzero(_BREAK).tolist()) for s in self.special)  # no special token's string arises between pieces
        self.clear()

    def clear(self) -> None:
        # where other bits of the hash are a piece's second place; one that has lost both to later pieces counts as new
        self.slot, self.second = np.zeros(_TABLE, np.int32), np.zeros(_TABLE, np.int32)
        self.hash, self.at, self.len, self.raw_at, self.raw_len = (np.zeros(1 << 16, t) for t in (np.uint64, *[np.int64] * 4))
        self.ids = np.zeros(1 << 18, np.uint16 if self.base <= 1 << 16 else np.uint32)
        self.raw = np.zeros(1 << 20, np.uint8)
        self.met = np.zeros(1 << 16, np.int32)
        self.n, self.used, self.raw_used = 0, 0, 0
        self._store(np.zeros(1, self.ids.dtype), np.ones(1, np.int64))  # piece 0: the id that ends a document

    def _store(self, ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Numbers of new pieces that have so many of the ids each."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(lens) > len(self.at):
            self.hash, self.at, self.len, self.raw_at, self.raw_len, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.hash, self.at, self.len, self.raw_at, self.raw_len, self.met))
        new = np.arange(self.n, self.n + len(lens))
        self.len[new], self.at[new] = lens, self.used + np.cumsum(lens) - lens
        self.met[new] = 0
        self.ids[self.used : self.used + len(ids)] = ids
        self.n, self.used = self.n + len(lens), self.used + len(ids)
        return new

    def _library(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, which stand in data one after another, and how many each has. No piece holds a special token's string."""
        ends = np.cumsum(size)
        starts = ends - size
        free = _BREAK[data[starts]] & ~_BREAK[data[ends - 1]] & self.joins
        at, other = np.flatnonzero(free), np.flatnonzero(~free)
        got = self._joined(data[_spans(starts[at], size[at])], size[at]) if len(at) else None
        if got is None:
            at, other, got = np.zeros(0, np.int64), np.arange(len(size)), (np.zeros(0, self.ids.dtype), np.zeros(0, np.int64))
        raw = data.tobytes()
        rest = self._set_apart([raw[a:b] for a, b in zip(starts[other].tolist(), ends[other].tolist())]) if len(other) else (np.zeros(0, self.ids.dtype), np.zeros(0, np.int64))
        lens = np.zeros(len(size), np.int64)
        lens[at], lens[other] = got[1], rest[1]
        first = np.cumsum(lens) - lens
        ids = np.empty(int(lens.sum()), self.ids.dtype)
        ids[_spans(first[at], lens[at])] = got[0]
        ids[_spans(first[other], lens[other])] = rest[0]
        return ids, lens

    def _joined(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """The same of pieces that begin with white space and end without; None if the tokens' lengths don't tell them apart."""
        ends, raw = np.cumsum(size), data.tobytes()
        cuts = [*(ends - size)[::AT_ONCE].tolist(), len(raw)]
        ids = np.concatenate([np.array(g.ids, self.ids.dtype) for g in self.lib.encode_batch_fast([raw[a:b].decode("utf-8") for a, b in zip(cuts, cuts[1:])], add_special_tokens=False)])
        upto = np.cumsum(self.bytes[ids])
        last = np.searchsorted(upto, ends)
        if not len(ids) or upto[-1] != ends[-1] or not np.array_equal(upto[last], ends):
            return None
        return ids, np.diff(np.r_[-1, last])

    def _set_apart(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same of any pieces, with a special token after each."""
        if self.apart is None:
            got = [np.array(g.ids, self.ids.dtype) for g in self.lib.encode_batch_fast([p.decode("utf-8") for p in pieces], add_special_tokens=False)]
            return np.concatenate(got), np.array([len(g) for g in got])
        number, name = self.apart
        texts = [name.encode().join(pieces[a : a + AT_ONCE]).decode("utf-8") + name for a in range(0, len(pieces), AT_ONCE)]
        ids = np.concatenate([np.array(g.ids, self.ids.dtype) for g in self.lib.encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.flatnonzero(ids == number)
        return np.delete(ids, ends), np.diff(np.r_[-1, ends]) - 1

    def _keep_met(self) -> None:
        """Start the table anew with the pieces that were met again, the most frequent half of it at most."""
        met = self.met[1 : self.n]
        least = 1 if np.count_nonzero(met) <= PIECES // 2 else int(np.partition(met, -PIECES // 2)[-PIECES // 2]) + 1
        old = np.flatnonzero(met >= least) + 1
        old = old[np.cumsum(self.raw_len[old]) <= PIECE_BYTES // 2]
        lens, raw_lens, hashes = self.len[old], self.raw_len[old], self.hash[old]
        ids, raw = self.ids[_spans(self.at[old], lens)], self.raw[_spans(self.raw_at[old], raw_lens)]
        self.clear()
        if len(old):
            self._enter(hashes, self._store(ids, lens), raw, raw_lens)

    def _add(self, hashes: np.ndarray, raw: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Numbers of new pieces that are kept for later texts."""
        new = self._store(*self._library(raw, lens))
        self._enter(hashes, new, raw, lens)
        return new

    def _enter(self, hashes: np.ndarray, new: np.ndarray, raw: np.ndarray, lens: np.ndarray) -> None:
        """Make pieces findable by hash and comparable by bytes."""
        while self.raw_used + len(raw) + 8 > len(self.raw):
            self.raw = np.concatenate([self.raw, np.zeros_like(self.raw)])
        self.raw[self.raw_used : self.raw_used + len(raw)] = raw
        self.hash[new], self.raw_len[new], self.raw_at[new] = hashes, lens, self.raw_used + np.cumsum(lens) - lens
        self.raw_used += len(raw)
        for slot, shift in ((self.slot, 0), (self.second, _SECOND)):
            slot[(hashes >> np.uint64(shift) & np.uint64(_TABLE - 1)).astype(np.int64)] = new

    def _known(self, slot: np.ndarray, h: np.ndarray, shift: int) -> np.ndarray:
        """The piece of each hash that a table has, or 0."""
        piece = slot[(h >> np.uint64(shift) & np.uint64(_TABLE - 1)).astype(np.int64)].astype(np.int64)
        piece[self.hash[piece] != h] = 0
        return piece

    def _same(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each span of data is its piece, byte by byte."""
        size = ends - starts
        ok = (piece > 0) & (self.raw_len[piece] == size)
        # words of 8 bytes that begin at any byte
        mine = np.ndarray(len(data), "<u8", np.r_[data, np.zeros(8, np.uint8)], strides=(1,))
        kept = np.ndarray(len(self.raw) - 7, "<u8", self.raw, strides=(1,))
        at, j = np.flatnonzero(ok), 0
        while len(at):
            differs = mine[starts[at] + j] ^ kept[self.raw_at[piece[at]] + j]
            ok[at[(differs & FIRST_BYTES[np.minimum(size[at] - j, 8)]) != 0]] = False
            j += 8
            at = at[ok[at] & (size[at] > j)]
        return ok

    def _odd(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Which texts hold white space outside ASCII or a special token's string."""
        hits = []
        for lead, rest in ((0xC2, {0x85, 0xA0}), (0xE1, None), (0xE2, None), (0xE3, None)):
            at = np.flatnonzero(data == lead)
            at = at[at < len(data) - 1]
            second, third = data[at + 1], data[np.minimum(at + 2, len(data) - 1)]
            if lead == 0xC2:
                ok = (second == 0x85) | (second == 0xA0)
            elif lead == 0xE1:
                ok = (second == 0x9A) & (third == 0x80)
            elif lead == 0xE2:
                ok = (second == 0x80) & ((third <= 0x8A) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF)) | (second == 0x81) & (third == 0x9F)
            else:
                ok = (second == 0x80) & (third == 0x80)
            hits.append(at[ok])
        raw = data.tobytes()
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                hits.append(np.array([at]))
                at = raw.find(s, at + 1)
        odd = np.zeros(len(offs) - 1, bool)
        odd[np.searchsorted(offs, np.concatenate(hits), "right") - 1] = True
        return odd

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each ended by 0, and the number of ids of each."""
        n = len(data)
        if n:
            space = _BREAK[data]
            cut = np.empty(n, bool)
            cut[0] = True
            cut[1:] = space[1:] & ~space[:-1] | _SIGN[data[1:]] & _ALNUM[data[:-1]]
            odd = self._odd(data, offs)
            for i in np.flatnonzero(odd):
                cut[offs[i] : offs[i + 1]] = False
            cut[offs[:-1][offs[:-1] < n]] = True
            starts = np.flatnonzero(cut)
            ends = np.r_[starts[1:], n]
            apart = odd[np.searchsorted(offs, starts, "right") - 1] | (ends - starts > LONG)
            h = span_hashes(data, starts, np.where(apart, starts, ends), folded=False)
            piece = self._known(self.slot, h, 0)
            miss = np.flatnonzero((piece == 0) & ~apart)
            raw, new_from = data.tobytes(), self.n
            if len(miss):
                values, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
                known = self._known(self.second, values, _SECOND)
                new = np.flatnonzero(known == 0)
                for a in range(0, len(new), 20_000):
                    part = new[a : a + 20_000]
                    at = miss[first[part]]
                    known[part] = self._add(values[part], data[_spans(starts[at], ends[at] - starts[at])], ends[at] - starts[at])
                piece[miss] = known[back]
            state = self.n, self.used
            other = np.flatnonzero(apart | ~self._same(data, starts, ends, piece))  # the last are pieces of equal hash
            if len(other):
                got = [np.array(g.ids, self.ids.dtype) for g in self.lib.encode_batch_fast([raw[starts[i] : ends[i]].decode("utf-8") for i in other], add_special_tokens=False)]
                piece[other] = self._store(np.concatenate(got), np.array([len(g) for g in got]))
            self.met[: self.n] += np.bincount(piece, minlength=self.n).astype(np.int32)
            self.met[new_from : self.n] -= 1  # a piece is met again from its second place on
        else:
            starts, piece, state = np.zeros(0, np.int64), np.zeros(0, np.int64), (self.n, self.used)
        ends_at = np.searchsorted(starts, offs[1:])
        piece = np.insert(piece, ends_at, 0)
        lens = self.len[piece]
        total = np.cumsum(lens)
        ids = self.ids[np.repeat(self.at[piece] - total + lens, lens) + np.arange(int(total[-1]) if len(total) else 0)]
        upto = total[ends_at + np.arange(len(ends_at))]
        self.n, self.used = state  # what is not kept is overwritten
        if self.n > PIECES or self.raw_used > PIECE_BYTES:
            self._keep_met()
        return ids, np.diff(np.r_[0, upto])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def compress(ids: np.ndarray, base: int, gain: float = GAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules as pairs, expansion length of each rule); symbols from `base` up are nonterminals."""
    seq = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    lengths = np.ones(base, np.int64)
    bits = np.uint32((1 << 18) - 1)
    stands = np.zeros(int(bits) + 1, np.uint64)
    before = np.inf
    while len(seq) >= 2 and len(seq) <= (1 - gain) * before:
        before = len(seq)
        bucket = ((seq[:-1] * np.uint32(0x9E3779B1)) ^ (seq[1:] * np.uint32(0x85EBCA6B)))
        bucket = ((bucket ^ (bucket >> np.uint32(15))) & bits).astype(np.intp)
        counts = np.bincount(bucket, minlength=int(bits) + 1)
        least = max(LEAST, int(np.partition(counts, -RULES_A_ROUND)[-RULES_A_ROUND]))
        at = np.flatnonzero((counts >= least)[bucket])
        if not len(at):
            break
        # one pair of each bucket is counted by it; only the others are sorted
        key, code = seq[at].astype(np.uint64) << np.uint64(32) | seq[at + 1].astype(np.uint64), bucket[at]
        stands[code] = key
        other = np.flatnonzero(stands[code] != key)
        rest, back = np.unique(key[other], return_inverse=True)
        code[other] = len(stands) + back
        pairs = np.r_[stands, rest]
        n = np.bincount(code, minlength=len(pairs))
        chosen = np.flatnonzero(n >= LEAST)
        if len(chosen) > RULES_A_ROUND:
            chosen = chosen[np.lexsort((pairs[chosen], -n[chosen]))[:RULES_A_ROUND]]
        if not len(chosen):
            break
        chosen = chosen[np.argsort(pairs[chosen])]
        number = np.full(len(pairs), -1, np.int64)
        number[chosen] = np.arange(len(chosen))
        name = number[code]
        at, name = at[name >= 0], name[name >= 0]
        # of matches that overlap, every other one from the left is replaced
        run = np.r_[True, np.diff(at) > 1]
        start = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        take = (np.arange(len(at)) - start) % 2 == 0
        at, name = at[take], name[take]
        first = base + sum(map(len, rules))
        made = np.stack([pairs[chosen] >> np.uint64(32), pairs[chosen] & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
        rules.append(made)
        lengths = np.r_[lengths, lengths[made[:, 0]] + lengths[made[:, 1]]]
        seq[at] = first + name
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), lengths[base:]


def expansions(rules: np.ndarray, lengths: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Every symbol's ids, flat, and where each begins."""
    at = np.r_[0, np.cumsum(np.r_[np.ones(base, np.int64), lengths])]
    flat = np.zeros(int(at[-1]), np.uint32)
    flat[:base] = np.arange(base)
    i, top = 0, rules.max(axis=1) if len(rules) else np.zeros(0, np.uint32)
    while i < len(rules):  # rules of one round stand for symbols of earlier rounds only
        later = np.flatnonzero(top[i:] >= base + i)
        j = i + int(later[0]) if len(later) else len(rules)
        flat[at[base + i] : at[base + j]] = expand(rules[i:j].ravel(), flat, at)
        i = j
    return flat, at


def expand(seq: np.ndarray, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    seq = seq.astype(np.int64)
    lens = at[seq + 1] - at[seq]
    total = np.cumsum(lens)
    return flat[np.repeat(at[seq] - total + lens, lens) + np.arange(int(total[-1]) if len(total) else 0)]


SHARD_COLUMNS = "part int, shard int, base int, width int, n_ids bigint, doc_ids array<bigint>, doc_lens array<bigint>, symbols binary, rules binary, lengths binary"
_SHARD = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("base", pa.int32()), ("width", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int64())), ("symbols", pa.binary()), ("rules", pa.binary()), ("lengths", pa.binary())])


def _shards(path: str, shard_ids: int):
    def run(batches):
        enc, part, n = encoder(path), TaskContext.get().partitionId(), 0
        ids, lens, docs, held = [], [], [], 0

        def close():
            nonlocal n, held
            all_ids = np.concatenate(ids)
            seq, rules, lengths = compress(all_ids, enc.base)
            width = 2 if enc.base + len(rules) <= 1 << 16 else 4
            row = (part, n, enc.base, width, len(all_ids), sum(docs, []), np.concatenate(lens).tolist(), seq.astype(f"<u{width}").tobytes(), rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes())
            n, held = n + 1, 0
            for x in (ids, lens, docs):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _SHARD)], schema=_SHARD)

        for batch in batches:
            doc_ids = batch.column("doc_id")
            for a, b, data, offs in slices(batch.column("text")):
                got, counts = enc.encode(data, offs)
                ids.append(got)
                lens.append(counts)
                docs.append(doc_ids.slice(a, b - a).to_pylist())
                held += len(got)
                if held >= shard_ids:
                    yield close()
        if docs:
            yield close()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, shard_ids: int = SHARD) -> None:
    """Write docs (doc_id, text) as shards under path, in ascending order of doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the hash orders the rows of one id, and splits them where an id, or none, has many
    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc())
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.mapInArrow(_shards(tokenizer, shard_ids), SHARD_COLUMNS).write.option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards under path with `first_id`, the number of ids in all shards before."""
    shards = spark.read.schema(SHARD_COLUMNS).parquet(path)
    per_shard = shards.select("part", "shard", "n_ids")
    parts = per_shard.groupBy("part").agg(F.sum("n_ids").alias("n"), F.count(F.lit(1)).alias("m"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", "m", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_first"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = per_shard.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part").select("part", "shard", (F.col("part_first") + F.col("inside")).alias("first_id"))
    return shards.join(small(placed, per_shard.count(), 24), ["part", "shard"])


def _shard(row: dict):
    seq = np.frombuffer(row["symbols"], f"<u{row['width']}")
    rules, lengths = np.frombuffer(row["rules"], "<u4").reshape(-1, 2), np.frombuffer(row["lengths"], "<u4").astype(np.int64)
    return seq, rules, lengths


def _digests(batches):
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    _ENCODERS.clear()  # files are read once they are whole; a worker that wrote some needs its table no more
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            seq, rules, lengths = _shard(row)
            ids = expand(seq, *expansions(rules, lengths, row["base"])).astype("<u4")
            lens = np.array(row["doc_lens"], np.int64)
            ends = np.cumsum(lens)
            view = memoryview(ids).cast("B")
            crc = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lens.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["first_id"] + ends - lens), pa.array(lens), pa.array(crc, pa.int64())], names=names)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    return read_shards(spark, path).mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def ids_between(row: dict, first: int, last: int) -> np.ndarray:
    """Ids first <= i < last of one shard, from only the symbols that hold them."""
    seq, rules, lengths = _shard(row)
    size = np.r_[np.ones(row["base"], np.int64), lengths]
    ends = np.cumsum(size[seq])
    a, b = np.searchsorted(ends, first, "right"), np.searchsorted(ends, last, "left") + 1
    flat, at = expansions(rules, lengths, row["base"])
    got = expand(seq[a:b], flat, at)
    skip = first - (int(ends[a - 1]) if a else 0)
    return got[skip : skip + last - first]


def tokens_of(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of each document with this id, by random access into its shard."""
    out = []
    for r in spark.read.schema(SHARD_COLUMNS).parquet(path).where(F.array_contains("doc_ids", F.lit(doc_id))).toLocalIterator():
        row = r.asDict()
        ends = np.cumsum(row["doc_lens"])
        out += [ids_between(row, int(e - n), int(e)).tolist() for d, n, e in zip(row["doc_ids"], row["doc_lens"], ends) if d == doc_id]
    return out


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def token_files(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write docs to a new place in the shared folder and read the digests back."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    path = f"{scratch.root}/files"
    write_tokens(docs, path, tokenizer or tokenizer_path())
    return read_digests(spark, path)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_token_files": op9_token_files}
ORACLE: dict = {}
