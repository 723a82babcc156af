"""Clusters against a plain loop over whole numbers."""

import hashlib
import math
import random

import duckdb
import pytest

from rowmill.llm import centroids as cl
from rowmill.llm.common import Scratch

SCHEMA = "vec_id long, embedding array<double>, cluster string, x int"


def plain(rows, k, rounds, dims, scale=1024.0):
    kept = []
    for i, e in rows:
        if e is not None and len(e) == dims and all(v is not None and math.isfinite(v) and math.isfinite(scale * v) for v in e):
            kept.append((i, [math.floor(scale * v) for v in e]))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cs = [list(x) for _, x in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(cs)) for _, x in kept]

    for _ in range(rounds):
        best = assign()
        for j in range(len(cs)):
            mine = [x for (_, x), (_, c) in zip(kept, best) if c == j]
            if mine:
                cs[j] = [sum(col) // len(mine) for col in zip(*mine)]
    best = assign()
    top = (1 << 63) - 1
    per = {j: min(sum(min(d, top) for d, c in best if c == j), top) for j in range(len(cs))}
    return sorted((-1 if i is None else i, c, min(d, top), per[c], min(sum(min(d, top) for d, _ in best), top), hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, best))


def got(spark, rows, k, rounds, dims):
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA).repartition(3)
    out = cl.with_inertia(*cl.cluster(df, Scratch(spark, "test"), k=k, rounds=rounds, dims=dims))
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in map(tuple, out.collect()))


@pytest.mark.parametrize("size", [0, 1, 3, 200])
def test_plain_rounds(spark, size):
    rng = random.Random(size)
    rows = [(i, [rng.gauss(i % 5, 0.3) for _ in range(6)]) for i in range(size)]
    assert got(spark, rows, 8, 10, 6) == plain(rows, 8, 10, 6)


def test_odd_vectors(spark):
    """Nulls, other lengths, repeated ids and rows, ties, a third of all rows alike, negative halves."""
    rng = random.Random(5)
    rows = [(i, [rng.choice([-0.7, -0.0005, 0.0, 0.5]) for _ in range(4)]) for i in range(60)] + [(7, [0.1, 0.2, 0.3, 0.4])] * 40
    rows += [(None, [0.5] * 4), (None, [0.25] * 4), (100, None), (101, []), (102, [1.0] * 3), (103, [None, 1.0, 1.0, 1.0]), (104, [float("nan")] * 4), (105, [float("inf"), 0.0, 0.0, 0.0]), (106, [1.7e308] * 4)]
    assert got(spark, rows, 5, 10, 4) == plain(rows, 5, 10, 4)


def test_large_components(spark):
    """Sums and differences beyond 63 bits are exact; what does not fit a long is its largest value."""
    rows = [(i, [(-1) ** i * 2.0 ** (20 + 3 * i), 3.0 * i, 2.0**60]) for i in range(30)]
    assert got(spark, rows, 4, 6, 3) == plain(rows, 4, 6, 3)


def test_tables_equal_differences():
    import numpy as np

    x = np.random.default_rng(1).integers(-5, 5, (50, 7))
    c = [[int(v) for v in row] for row in x[:3]]
    best, distance = cl.nearest(x, c)
    full = ((x[:, None, :] - np.array(c)[None]) ** 2).sum(axis=2)
    assert (best == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    assert (cl.nearest(x.astype(object), c)[0] == best).all()


def test_given_rows(spark, sf):
    rows = duckdb.sql(f"select vec_id, embedding from '{sf}/embeddings.parquet'").fetchall()
    want = plain(rows, 8, 10, 64)
    assert sorted(map(tuple, cl.op11_centroids(spark, sf).collect())) == want
