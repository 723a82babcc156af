"""Cut byte spans out of documents and report what is left."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A 128-bit key for a row's id and text. Rows equal in both share it, and share their result."""
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    return F.unhex(F.md5(F.concat(name, F.lit(":"), F.coalesce(F.col(text).cast("string"), F.lit("")))))


def merged(spans) -> list[tuple[int, int]]:
    """Sorted spans with overlaps and touching ends joined."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


PACKED = "doc_id bigint, k binary, n_bytes bigint, z binary"


def _pack(batches):
    for batch in batches:
        raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
        z = [pa.compress(r, codec="zstd", asbytes=True) if r else b"" for r in raw]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k"), pa.array(map(len, raw), pa.int64()), pa.array(z, pa.binary())], names=["doc_id", "k", "n_bytes", "z"])


def pack(docs: DataFrame) -> DataFrame:
    """PACKED rows of docs (doc_id, k, text): texts compressed before they are shuffled."""
    return docs.select("doc_id", "k", "text").mapInArrow(_pack, PACKED)


def unpack(batch: pa.RecordBatch, i: int) -> bytes:
    n = batch.column("n_bytes")[i].as_py()
    return pa.decompress(batch.column("z")[i].as_py(), n, codec="zstd", asbytes=True) if n else b""


_CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
CUT_COLUMNS = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept string, starts array<bigint>, ends array<bigint>"


def _cut(with_text: bool, choose):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            starts, ends = batch.column("starts"), batch.column("ends")
            rows = {n: [] for n in _CUT.names}
            for i, d in enumerate(ids):
                raw = unpack(batch, i)
                spans = merged(zip(starts[i].as_py() or (), ends[i].as_py() or ()))
                spans = choose(raw, spans) if choose else spans
                at, parts = 0, []
                for a, b in spans:
                    parts.append(raw[at:a])
                    at = b
                left = b"".join(parts) + raw[at:]
                values = (d, len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace") if with_text else None, [a for a, _ in spans], [b for _, b in spans])
                for n, v in zip(_CUT.names, values):
                    rows[n].append(v)
            yield pa.RecordBatch.from_pydict(rows, _CUT)

    return run


def cut(docs: DataFrame, spans: DataFrame, with_text: bool = True, choose=None) -> DataFrame:
    """CUT_COLUMNS of each row of docs (doc_id, text); spans (k, starts, ends) lists the byte spans to remove by row key; of a text's
    merged spans, choose(bytes, spans) gives those that go.

    Texts are joined to their spans by key, which shuffles each text once.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key().alias("k"))
    return pack(keyed).join(spans, "k", "left").select("doc_id", "n_bytes", "z", "starts", "ends").mapInArrow(_cut(with_text, choose), CUT_COLUMNS)
