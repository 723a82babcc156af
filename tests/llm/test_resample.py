"""Counts, gains and draws against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from rowmill.llm import resample as rs
from rowmill.llm.common import Scratch

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest, buckets):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, longest, buckets, percent=10, least=20):
    s, t = Counter(), Counter()
    for c, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            c.update(features(x, longest, buckets)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (s_all + buckets) / ((s[b] + 1.0) * (t_all + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        words, found = features(x, longest, buckets)
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append([i, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): n for n, r in enumerate(able[: len(able) * percent // 100], 1)}
    return sorted(((-1 if r[0] is None else r[0], *r[1:], rank.get(id(r), 0)) for r in rows))


def texts(rng, n):
    pool = ["the", "Of", "a1", "été", "漢字", "x" * 90, "\n", " -- ", "\r\n", "B"]
    return [rng.choice([None, "", "\n", "A_b"]) if i % 17 == 0 else "".join(rng.choice(pool) + rng.choice([" ", "\n", "_"]) for _ in range(rng.randint(1, 60))) for i in range(n)]


@pytest.mark.parametrize("longest,buckets", [(1, 10_000), (2, 97), (3, 1000)])
def test_plain(spark, longest, buckets):
    rng = random.Random(longest)
    docs = list(enumerate(texts(rng, 150))) + [(500 + i, "same line again\n" * 9 + "end") for i in range(80)]
    docs += [(7, "Repeated id " * 10)] * 3 + [(None, "no id at all " * 8), (None, None), (900, "very long " * 40_000)]
    target = texts(rng, 20)
    df = spark.createDataFrame([(i, x, "w", 1) for i, x in docs], "doc_id long, text string, weight string, rank int").repartition(4)
    aim = spark.createDataFrame([(x,) for x in target], "text string")
    out = rs.resample(df, aim, Scratch(spark, "test"), longest=longest, buckets=buckets)
    got = sorted((-1 if r[0] is None else r[0], *r[1:5], r[5] or 0) for r in map(tuple, out.collect()))
    want = plain(docs, target, longest, buckets)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert sorted((r[5], r[0], r[4]) for r in got) == sorted((r[5], r[0], r[4]) for r in want)


def test_hot_line_and_ties(spark):
    """A third of the rows with one id and text: ranks are 1, 2, 3 ... without gaps."""
    docs = [(1, "one hot text " * 20)] * 200 + [(i, f"word{i} " * 30) for i in range(2, 402)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    out = rs.resample(df, df.limit(5), Scratch(spark, "test"), percent=60)
    ranks = sorted(r.rank for r in out.collect() if r.rank)
    assert ranks == list(range(1, 361))


def test_empty_and_draw(spark):
    df = spark.createDataFrame([(i, f"word{i} other{i % 7} " * 15, "s") for i in range(40)], "doc_id long, text string, weight string")
    assert rs.resample(df.limit(0), df, Scratch(spark, "test")).count() == 0
    out = rs.resample(df, df.limit(0), Scratch(spark, "test"))
    drawn = rs.draw(df, df.limit(0))
    assert drawn.columns == df.columns
    assert {r.doc_id for r in drawn.collect()} == {r.doc_id for r in out.where("rank is not null").collect()} and drawn.count() == 4


def test_given_rows(spark, sf, duck):
    from helpers import rows_of

    assert rows_of(rs.op13_resample(spark, sf).toPandas()) == rows_of(duck.execute(rs.ORACLE["op13_resample"]).df())
