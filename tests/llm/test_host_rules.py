"""Measures against a plain count, verdicts on planted hosts."""

import random
import re

import pytest

from rowmill.llm import host_rules as hr
from rowmill.llm.common import Scratch

SCHEMA = "doc_id long, text string, source string, host string, kept int, n_words string"


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered))


def judged(spark, rows):
    df = spark.createDataFrame([(i, t, s, "h", 0, "n") for i, t, s in rows], SCHEMA).repartition(3)
    return [r.asDict() for r in hr.judge(df, Scratch(spark, "test")).collect()]


def test_measures(spark):
    rng = random.Random(2)
    texts = [None, "", " ", "\n", "\n\n", "a", "a b c a b c", "a a a a", "x\nx\n x\nx", "é ü  漢字 <b>", "a\rb\x0bc\x0cd", "#|" * 9 + "\n" + "#|" * 9, "w " * 30_000, "long" * 2_000_00]
    texts += [" ".join(rng.choice(["a", "b", "ç", "d\n", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    got = {r["doc_id"]: tuple(r[m] for m in hr.MEASURES) for r in judged(spark, [(i, t, "s") for i, t in enumerate(texts)])}
    for i, t in enumerate(texts):
        if i != 12:
            assert got[i] == measures(t), (i, t)
    assert got[12] == (30_000, 30_000, 0, 1, 0, 30_000)


def prose(i, n=80):
    return " ".join(f"word{(i * 7919 + j * 31) % 9973}" for j in range(n))


def test_hosts(spark):
    """A host of junk goes as a whole; a small host with one bad document, a hot host, and rows without a host do not."""
    rows = [(i, prose(i), "hot" if i % 3 == 0 else f"h{i % 10}") for i in range(300)]
    rows += [(1000 + i, prose(i) if i < 4 else "spam " * 5, "junk") for i in range(60)]
    rows += [(2000, "bad", "tiny"), (2001, prose(1), "tiny"), (2002, prose(2), None), (2003, None, None), (2003, None, None), (None, prose(3), "h1"), (2004, "", "h2")]
    out = judged(spark, rows)
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], r)
    assert all(by[i]["kept"] for i in range(300)) and not any(by[1000 + i]["kept"] for i in range(60))
    assert by[1000]["host_failed"] and not by[1000]["base_failed"]
    assert by[2001]["kept"] and by[2002]["kept"] and by[None]["kept"] and not by[2000]["kept"] and not by[2003]["kept"] and not by[2004]["kept"]


def test_keep_good_and_empty(spark):
    df = spark.createDataFrame([(1, prose(1), "a", "h", 0, "n"), (1, "short", "a", "h", 0, "n"), (None, prose(2), None, "h", 0, "n")], SCHEMA)
    kept = hr.keep_good(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "None"]
    assert hr.judge(df.limit(0), Scratch(spark, "test")).count() == 0


@pytest.mark.parametrize("name", ["op12_host_rules"])
def test_given_rows(spark, sf, duck, name):
    from helpers import rows_of

    assert rows_of(hr.QUERIES[name](spark, sf).toPandas()) == rows_of(duck.execute(hr.ORACLE[name]).df())
