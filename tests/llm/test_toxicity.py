"""Features against a plain version, and what is learned at every number of labels."""

import math
import random
import re

import numpy as np
import pytest

from rowmill.llm import toxicity as tx
from rowmill.llm.common import Scratch


def plain(text, lexicons):
    raw = (text or "").encode()
    words = [m[0] for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw)]
    low = [w.decode("utf-8", "replace").lower() for w in words]
    n, size = max(len(words), 1), max(len(raw), 1)
    letters = lambda w: sum(chr(b).isalpha() and b < 128 or b >= 128 for b in w)
    insult, you = [w in tx.INSULTS for w in low], [w in tx.SECOND for w in low]
    is_letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
    out = [
        math.log1p(len(words)), sum(insult) / n, math.log1p(sum(insult)), sum(you) / n, sum(65 <= b <= 90 for b in raw) / size,
        sum(letters(w) >= 3 and sum(65 <= b <= 90 for b in w) == letters(w) for w in words) / n, raw.count(b"!") / n, raw.count(b"?") / n,
        sum(32 < b < 128 and not chr(b).isalnum() for b in raw) / size, sum(letters(w) >= 2 and any(48 <= b <= 57 for b in w) for w in words) / n,
        sum(raw[i] in b"@$*#!%+" and is_letter(raw[i - 1]) and is_letter(raw[i + 1]) for i in range(1, len(raw) - 1)) / n,
        sum(raw[i] == raw[i - 1] == raw[i - 2] and is_letter(raw[i]) for i in range(2, len(raw))) / size,
    ]
    for lexicon in lexicons:
        stem = lambda w: "~" + w.encode()[: tx.STEM].decode("utf-8", "ignore") if len(w.encode()) > tx.STEM else None
        weight = [max(lexicon.get(w, 0.0), lexicon.get(stem(w), 0.0)) for w in low]
        kinds = {w if w in lexicon else stem(w) for w, x in zip(low, weight) if x}
        near = 0.0
        for i in range(len(low)):
            if weight[i] or insult[i]:
                near += max([1 / (1 + abs(i - j)) for j in range(len(low)) if you[j] and abs(i - j) <= 5], default=0.0)
        out += [sum(weight) / n, sum(x > 0 for x in weight) / n, max(weight, default=0.0), math.log1p(len(kinds)), near / n]
    return out


def hashed(lexicon):
    entries = []
    for w, x in lexicon.items():
        h = tx.hashes_of([w.removeprefix("~")])[0]
        entries.append((h ^ np.uint64(0x5DEECE66D) if w[0] == "~" else h, x))
    entries.sort()
    return np.array([e[0] for e in entries], np.uint64), np.array([e[1] for e in entries], float)


def test_features(spark):
    rng = random.Random(4)
    bits = ["you", "YOU", "idiot", "Idiot", "grumblefoo", "grumblebar", "bad", "BAD", "worse", "x1y", "a$b", "sooo", "!!!", "?", "été", "ÉTÉ", "crétin", "42", "the", "of", "\n", "tu", "c*u*t", "WORDS"]
    texts = [None, "", " ", "!", "you", "idiot", "a", "aaa", "$$$", "you " * 3000 + "idiot"]
    texts += ["".join(rng.choice(bits) + rng.choice([" ", " ", "", ", "]) for _ in range(rng.randint(1, 40))) for _ in range(200)]
    lexicons = [{"bad": 2.0, "~grumble": 1.5, "été": 0.5}, {"worse": 3.0, "grumblebar": 4.0}, {}]
    model = tx.Toxicity(spark, [hashed(x) for x in lexicons])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: [r[f] for f in tx.FEATURES] for r in model.features(df).collect()}
    for i, t in enumerate(texts):
        if i != 9:
            assert got[i] == pytest.approx(plain(t, lexicons), abs=1e-12), t
    assert got[9][:2] == [math.log1p(3001), 1 / 3001]


def corpus(n, every):
    rng = random.Random(7)
    clean = ["garden", "river", "stone", "winter", "reading", "letter", "morning", "paper"]
    rows, labels = [], []
    for i in range(n):
        bad = i % every == 0
        words = [rng.choice(clean) for _ in range(30)] + (["you", "idiot", "vilethings"] if bad else ["you", "kindly"])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad), 1))
    return rows, labels


@pytest.mark.parametrize("n_labels", [0, 8, 300])
def test_trees_at_every_number_of_labels(spark, n_labels):
    """Trees and curves are there with no labels, few, or hundreds, and clean texts are left alone."""
    rows, labels = corpus(400, 8)
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels[:n_labels], "doc_id long, toxic int, quality int")
    model, features = tx.fit(docs, known, Scratch(spark, "test"))
    assert len(model.turns) == tx.FOLDS
    got = {r.doc_id: (r.score >= tx.CUT, r.score) for r in model.score(features).collect()}
    assert all(0 <= s <= 1 for _, s in got.values())
    assert sum(got[i][0] for i in range(0, 400, 8)) >= 48 and not any(got[i][0] for i in range(400) if i % 8)


def test_odd_tables(spark):
    """One label only, every document held out, repeated and unknown ids, ties, null ids and texts, clashing columns."""
    rows, labels = corpus(60, 6)
    docs = spark.createDataFrame([(i, t, 1.0, "k") for i, t in rows] + [(None, None, 1.0, "k"), (3, "", 1.0, "k"), (3, "", 1.0, "k"), (500, "long " * 100_000, 1.0, "k")], "doc_id long, text string, score double, k string")
    some = spark.createDataFrame([(i, 0, 1) for i in range(40)] + [(9999, 1, 1), (None, 1, 1), (5, None, 1)], "doc_id long, toxic int, quality int")
    got = tx.toxicity(docs, some).collect()
    assert len(got) == 64 and len({r.score for r in got if r.doc_id == 3 and r.k == got[0].k}) <= 1
    assert len({r.score for r in got if r.doc_id in (3, None)} | {0}) >= 1
    out = docs.where(tx.fold_of(docs.doc_id) == 2)
    assert {(r.held_out, r.score) for r in tx.toxicity(out, some).collect()} == {(True, 0.0)}
    assert tx.toxicity(docs.limit(0), some).count() == 0 and tx.drop_toxic(docs, some.limit(0)).columns == docs.columns
