"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Features are densities a text of any length can have: hits of a lexicon learned from the labelled rows (words, and stems of
the first bytes of longer words), hits of a short built-in lexicon, second-person words and their closeness to hits,
capitals, shouting, punctuation, and obfuscation such as digits or symbols inside words.

Labelled training rows are dealt in three folds by hash, and three scorers are learned in turn: the lexicon is counted over one
fold, all of it, Spark ML's trees are fitted on the next, where chance hits of the lexicon do not look like evidence, and the
isotonic curve maps the trees' margins to rates on the third. So every labelled row serves as each, and a score is the mean of
the three. At most `FIT_ROWS` labelled rows fit trees and curves.

There are trees at every number of labels. What few labels cannot tell comes from a prior: up to `PRIOR_ROWS` unlabelled
documents with built-in insults and as many without take part in trees and curves as toxic and clean, with the weight of
`PRIOR` labelled rows in all, which weighs nothing once there are many labels.

Labels, lang, source and doc_id never enter a score. Rows whose crc32(doc_id as text) mod 4 is 2 are never learned from.

Defined cases: null and empty texts have all densities 0 and are scored like any other; texts with equal features have equal
scores; rows that repeat an id take the highest label of that id; labels of unknown documents are left out; where every
document is held out nothing can be learned and scores are 0; an empty table gives no rows. One text is held in memory at a
time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices, small, span_hashes, word_spans
from .spans import row_key

#: Bounds of the model: at most so many labelled rows fit the trees and the calibration, and the lexicon has so many entries,
#: the best by their log-odds over all words and stems. A word that fewer toxic texts have than LEAST is no evidence.
FIT_ROWS, LEXICON, LEAST = 24_000, 600, 3
#: Documents of the prior of either kind, at most, and the labelled rows that its toxic and its clean ones weigh.
PRIOR_ROWS, PRIOR = 64, (8.0, 24.0)
FOLDS = 3
STEM, CUT = 7, 0.3
#: Insults in the corpus' languages, and second-person words.
INSULTS = "idiot moron stupid trash scum loser worthless pathetic disgusting clown dumb garbage filth freak jerk imbecile bastard idiota imbécil estúpido basura asqueroso trottel dumm abschaum widerlich crétin débile ordure minable".split()
SECOND = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split()
#: Features that do not depend on the learned lexicon, and those that do.
COMMON = ["log_words", "insults", "insult_any", "second", "capitals", "shouting", "exclaims", "questions", "symbols", "obfuscated", "masked", "long_runs"]
LEARNED = ["lexicon", "lexicon_words", "lexicon_top", "lexicon_kinds", "near_second"]


def columns_of(turn: int) -> list[str]:
    return COMMON + [f"{c}_{turn}" for c in LEARNED]


FEATURES = COMMON + [f"{c}_{t}" for t in range(FOLDS) for c in LEARNED]
_SPLIT = np.ones(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _SPLIT[_a:_b] = False
_LETTER = ~_SPLIT
_LETTER[48:58] = False


def fold(data: np.ndarray) -> np.ndarray:
    """Upper-case Latin-1 letters of UTF-8 text in lower case; A-Z are folded by the hash."""
    up = np.zeros(len(data), bool)
    if len(data) > 1:
        up[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    return np.where(up, data + 0x20, data).astype(np.uint8) if up.any() else data


def hashes_of(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw])
    return np.sort(span_hashes(fold(data), np.r_[0, ends[:-1]], ends))


def _tokens(data, offs):
    """Word starts, ends, per-text offsets, and hashes of words and stems (0 where a word is no longer than a stem)."""
    low = fold(data)
    starts, ends, first = word_spans(low, offs, _SPLIT)
    words = span_hashes(low, starts, ends)
    stems = span_hashes(low, starts, np.minimum(ends, starts + STEM)) ^ np.uint64(0x5DEECE66D)
    return starts, ends, first, words, np.where(ends - starts > STEM, stems, np.uint64(0))


def _vocabulary(batches):
    """Per task: (fold, h, toxic, n), the number of texts of each fold and label that have a word or stem."""
    for batch in batches:
        kind = batch.column("fold").to_numpy(zero_copy_only=False) * 2 + batch.column("toxic").to_numpy(zero_copy_only=False)
        for a, b, data, offs in slices(batch.column("text")):
            _, _, first, words, stems = _tokens(data, offs)
            doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
            d, x = np.r_[doc, doc], np.r_[words, stems]
            d, x = d[x != 0], x[x != 0]
            order = np.lexsort((d, x))
            d, x = d[order], x[order]
            new = np.r_[True, (x[1:] != x[:-1]) | (d[1:] != d[:-1])] if len(x) else np.zeros(0, bool)
            d, x = d[new], x[new]
            for t in range(2 * FOLDS):
                values, n = np.unique(x[kind[a:b][d] == t], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), t // 2)), pa.array(values.view(np.int64)), pa.array(np.full(len(n), t % 2)), pa.array(n)], names=["fold", "h", "toxic", "n"])


def _learned(entries, weights, words, stems, insult, you, doc, m):
    """The features of LEARNED, of one lexicon: counts a text, the highest weight, distinct hits, and closeness to the second person."""

    def weight(h):
        if not len(entries):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(entries, h), len(entries) - 1)
        return np.where(entries[at] == h, weights[at], 0.0)

    per = lambda x: np.bincount(doc, x, m)
    of_words = weight(words)
    w = np.maximum(of_words, weight(stems))
    top, kinds = np.zeros(m), np.zeros(m)
    np.maximum.at(top, doc[w > 0], w[w > 0])
    hd, hh = doc[w > 0], np.where(of_words > 0, words, stems)[w > 0]
    if len(hd):
        order = np.lexsort((hh, hd))
        hd, hh = hd[order], hh[order]
        kinds = np.bincount(hd[np.r_[True, (hd[1:] != hd[:-1]) | (hh[1:] != hh[:-1])]], minlength=m)
    spots, h, near = np.flatnonzero(you), np.flatnonzero((w > 0) | insult), np.zeros(len(words))
    if len(spots) and len(h):
        at = np.searchsorted(spots, h)
        for c in (np.maximum(at - 1, 0), np.minimum(at, len(spots) - 1)):
            gap = np.abs(spots[c] - h)
            near[h] = np.maximum(near[h], np.where((gap <= 5) & (doc[spots[c]] == doc[h]), 1.0 / (1 + gap), 0))
    return per(w), per(w > 0), top, np.log1p(kinds), per(near)


def _features(shared):
    def run(batches):
        lexicons, insults, second = shared.value
        member = lambda h, s: s[np.minimum(np.searchsorted(s, h), len(s) - 1)] == h
        cum = lambda flag: np.r_[0, np.cumsum(flag)]
        for batch in batches:
            for a, b, data, offs in slices(batch.column("text")):
                m = b - a
                starts, ends, first, words, stems = _tokens(data, offs)
                count = np.diff(first)
                doc = np.repeat(np.arange(m), count)
                per = lambda x: np.bincount(doc, x, m)
                n, size = np.maximum(count, 1), np.maximum(np.diff(offs), 1)
                insult, you = member(words, insults), member(words, second)
                upper = cum((data >= 65) & (data <= 90))
                letter, digit = cum(_LETTER[data]), cum((data >= 48) & (data <= 57))
                each = lambda c: c[offs[1:]] - c[offs[:-1]]
                wl, wu, wd = letter[ends] - letter[starts], upper[ends] - upper[starts], digit[ends] - digit[starts]
                inner, same, text = np.zeros(len(data), bool), np.zeros(len(data), bool), np.zeros(len(data), bool)
                text[offs[1:-1][offs[1:-1] < len(data)]] = True  # where a text begins
                if len(data) > 2:
                    sym = np.isin(data[1:-1], np.frombuffer(b"@$*#!%+", np.uint8))
                    inner[1:-1] = sym & _LETTER[data[:-2]] & _LETTER[data[2:]] & ~text[1:-1] & ~text[2:]
                    same[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & _LETTER[data[2:]] & ~text[2:] & ~text[1:-1]
                punct = lambda c: each(cum(data == ord(c)))
                cols = [
                    np.log1p(count), per(insult) / n, np.log1p(per(insult)), per(you) / n, each(upper) / size, per((wl >= 3) & (wu == wl)) / n, punct("!") / n, punct("?") / n,
                    each(cum(_SPLIT[data] & (data > 32))) / size, per((wl >= 2) & (wd >= 1)) / n, each(cum(inner)) / n, each(cum(same)) / size,
                ]
                for entries, weights in lexicons:
                    total, hits, top, kinds, near = _learned(entries, weights, words, stems, insult, you, doc, m)
                    cols += [total / n, hits / n, top, kinds, near / n]
                part = batch.slice(a, m)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("k"), *[pa.array(np.asarray(c, np.float64)) for c in cols]], names=["doc_id", "k", *FEATURES])

    return run


def fold_of(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4))


def learn_lexicons(train: DataFrame, scratch: Scratch, entries: int = LEXICON) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each fold, sorted hashes and log-odds of the words and stems that mark toxic texts of train (text, toxic, fold).

    Counts and log-odds of all words are made in Spark; the driver gets the best `entries` of each fold.
    """
    sizes = {(r.fold, r.toxic): r["count"] for r in train.groupBy("fold", "toxic").count().collect()}
    of = lambda t: F.coalesce(F.sum(F.when(F.col("toxic") == t, F.col("n"))), F.lit(0))
    counted = train.select("text", "toxic", "fold").mapInArrow(_vocabulary, "fold long, h long, toxic long, n long").groupBy("fold", "h").agg(of(1).alias("bad"), of(0).alias("good"))
    counted = scratch.settle(counted.where(F.col("bad") >= LEAST))
    out = []
    for fold in range(FOLDS):
        bad, good = sizes.get((fold, 1), 0), sizes.get((fold, 0), 0)
        rate = F.log((F.col("bad") + 0.5) / (bad + 1))
        seen = counted.where(F.col("fold") == fold).withColumn("odds", rate - F.log((F.col("good") + 0.5) / (good + 1)))
        # what one clean text could undo by chance is no evidence
        seen = seen.withColumn("sure", rate - F.log((F.col("good") + 2.0) / (good + 4))).where("sure > 1.5")
        best = seen.orderBy(F.desc(F.col("sure") * F.sqrt("bad")), "h").limit(entries).toPandas()
        h = best.h.to_numpy(np.int64).view(np.uint64)
        order = np.argsort(h)
        out.append((h[order], best.odds.to_numpy(np.float64)[order]))
    return out


class Toxicity:
    """A fitted scorer."""

    def __init__(self, spark: SparkSession, lexicons):
        self.spark, self.turns = spark, []  # of each turn: its number, trees and curve
        self.shared = spark.sparkContext.broadcast((lexicons, hashes_of(INSULTS), hashes_of(SECOND)))

    @staticmethod
    def keyed(docs: DataFrame) -> DataFrame:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("k"), F.col("text").cast("string").alias("text"))

    def features(self, docs: DataFrame) -> DataFrame:
        schema = "doc_id long, k binary, " + ", ".join(f"{c} double" for c in FEATURES)
        return self.keyed(docs).mapInArrow(_features(self.shared), schema)

    @staticmethod
    def margin(rows: DataFrame, turn: int, trees) -> DataFrame:
        rows = VectorAssembler(inputCols=columns_of(turn), outputCol="x").transform(rows)
        made = trees.transform(rows).withColumn("margin", vector_to_array("rawPrediction")[1])
        return made.drop("x", "rawPrediction", "probability", "prediction")

    def score(self, rows: DataFrame) -> DataFrame:
        """(doc_id, k, score) of rows of features."""
        total = F.lit(0.0)
        for turn, trees, curve in self.turns:
            rows = curve.transform(self.margin(rows, turn, trees)).withColumnRenamed("calibrated", f"score_{turn}").drop("margin")
            total = total + F.col(f"score_{turn}")
        return rows.select("doc_id", "k", F.least(F.lit(1.0), F.greatest(F.lit(0.0), total / max(len(self.turns), 1))).alias("score"))


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> tuple[Toxicity, DataFrame]:
    """A scorer learned from the labelled rows outside the held-out fold, and the features of all docs."""
    spark = docs.sparkSession
    learns = F.coalesce(fold_of(F.col("doc_id")) != 2, F.lit(False))
    known = labels.where("toxic in (0, 1)").where(learns)
    # a hash of the id deals rows to folds; the id itself is no input
    known = scratch.settle(known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")))
    n = known.count()
    train = Toxicity.keyed(docs).join(small(known, n, 32), "doc_id").select("text", "toxic", "fold")
    model = Toxicity(spark, learn_lexicons(train, scratch))
    rows = scratch.settle(model.features(docs))
    share = min(1.0, FIT_ROWS / max(n, 1))
    u = lambda name: F.pmod(F.xxhash64("doc_id", F.lit(name)), F.lit(1_000_000)) / 1_000_000.0
    labelled = rows.join(small(known.where(u("toxicity") < share), n, 32), "doc_id").withColumn("weight", F.lit(1.0))
    # the prior: unlabelled documents, by built-in hits
    free = rows.where(learns).join(small(known.select("doc_id"), n, 32), "doc_id", "left_anti").withColumn("toxic", (F.col("insult_any") > 0).cast("int"))
    count = {r.toxic: r["count"] for r in free.groupBy("toxic").count().collect()}
    take = [min(1.0, PRIOR_ROWS / count.get(t, 1)) for t in (0, 1)]
    weight = [PRIOR[1 - t] / max(1.0, take[t] * count.get(t, 0)) for t in (0, 1)]
    by = lambda x: F.when(F.col("toxic") == 1, x[1]).otherwise(x[0])
    prior = free.where(u("prior") < by(take)).withColumns({"fold": F.lit(-1), "weight": by(weight)})
    dealt = scratch.settle(labelled.unionByName(prior).withColumn("label", F.col("toxic").cast("double")))
    if dealt.isEmpty():
        return model, rows
    for turn in range(FOLDS):
        of = lambda step, t=turn: dealt.where(F.col("fold").isin(-1, (t + step) % FOLDS))
        fit_rows = VectorAssembler(inputCols=columns_of(turn), outputCol="x").transform(of(1)).select("x", "label", "weight")
        if fit_rows.isEmpty() or of(2).isEmpty():
            continue
        gbt = GBTClassifier(labelCol="label", featuresCol="x", weightCol="weight", maxDepth=3, maxIter=12, stepSize=0.3, maxBins=32, minInstancesPerNode=4, seed=7)
        # the sample is bounded by FIT_ROWS rows of numbers, so it stays in memory; a lost executor recomputes it from the table
        trees = gbt.fit(fit_rows.coalesce(4))
        held = model.margin(of(2), turn, trees).select("margin", "label", "weight")
        curve = IsotonicRegression(featuresCol="margin", labelCol="label", weightCol="weight", predictionCol="calibrated").fit(held.coalesce(4))
        model.turns.append((turn, trees, curve))
    return model, rows


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, k, held_out, score, predicted) of every row of docs."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    model, rows = fit(docs, labels, scratch)
    scored = model.score(rows)
    return scored.select("doc_id", "k", F.coalesce(fold_of(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows predicted toxic."""
    scratch = Scratch(docs.sparkSession, "rejected")
    out = scratch.settle(toxicity(docs, labels).where("predicted = 1").select("k").distinct())
    return docs.withColumn("__rm_key", row_key()).join(small(out.withColumnRenamed("k", "__rm_key"), out.count(), 24), "__rm_key", "left_anti").select(docs.columns)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("k")


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLE: dict = {}
