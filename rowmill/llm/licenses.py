"""Licence scan by diagonal voting, in DataFrame functions alone.

Every text's words give rolling word k-grams. Their hashes join the k-grams of the licence templates; a match at word i of
the text and word j of the template votes for the diagonal i - j. Votes are summed by text, template and diagonal. A
diagonal that holds all k-grams of a template is the template word for word: these are the base matches of the short
phrases. For long templates neighbouring diagonals are merged, so that a few inserted or lost words only bend the line. A
merged span is verified: of each place of the template its first vote counts, and only while the places in the text ascend
with those in the template, so that a fragment said twenty times is one vote. The span counts if `ENOUGH` of the template's
k-grams and `DENSE` of the span's are such votes. Joined k-grams are compared word by word, so no hash collision votes.

The template table is fixed text of this module, so broadcasting it is bounded. Voting rows are few: only k-grams that occur
in a template survive the join, which the planner runs in the scan's own stage, without a shuffle of words.

Defined cases: null text has no words; rows equal in id and text get the same answer; texts shorter than k words match
nothing; overlapping and repeated places all count; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch
from .spans import row_key

K, SLACK, ENOUGH, DENSE = 3, 4, 0.6, 0.4
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrase and label of the base scan.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Opening or granting words of well-known licence notices, with this operator's labels.
NOTICES = {
    "gpl": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "apache-2-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl-2-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-nc-notice": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
}


def lowered(text: Column) -> Column:
    """A-Z to a-z. lower() does that and more, but no other character turns into an ASCII letter save the Kelvin sign and dotted I; texts with those take the exact mapping."""
    exact = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(text.rlike("[\u212A\u0130]"), exact).otherwise(F.lower(text))


def _grams(w: Column, n: Column) -> Column:
    """The K-grams of an array of n words, in order."""
    return F.arrays_zip(*[F.slice(w, F.lit(i + 1), n - (K - 1)).alias(f"t{i + 1}") for i in range(K)])


def templates(spark: SparkSession) -> DataFrame:
    """(label, base, n_grams, tpos, t1, t2, t3, gram)"""
    rows = [f"('{label}', true, '{text}')" for text, label in BASE.items()] + [f"('{label}', false, '{text}')" for label, text in NOTICES.items()]
    t = spark.sql(f"select label, base, split(text, ' ') as w from values {', '.join(rows)} as t(label, base, text)")
    n = F.size("w")
    t = t.select("label", "base", (n - (K - 1)).alias("n_grams"), F.posexplode(_grams(F.col("w"), n)).alias("tpos", "g"))
    return t.select("label", "base", "n_grams", "tpos", "g.*").withColumn("gram", F.xxhash64("t1", "t2", "t3"))


def votes(docs: DataFrame) -> DataFrame:
    """(k, label, base, n_grams, tpos, pos) of each k-gram of a text that a template holds."""
    words = F.array_remove(F.split(lowered(F.col("text")), SEPARATOR), "")
    w = docs.select("k", words.alias("w")).where(F.size("w") >= K)
    n = F.size("w")
    grams = w.select("k", F.posexplode(_grams(F.col("w"), n)).alias("pos", "g"))
    grams = grams.select("k", "pos", F.col("g.t1").alias("a"), F.col("g.t2").alias("b"), F.col("g.t3").alias("c")).withColumn("gram", F.xxhash64("a", "b", "c"))
    hit = grams.join(F.broadcast(templates(docs.sparkSession)), "gram").where("a = t1 and b = t2 and c = t3")
    return hit.select("k", "label", "base", "n_grams", "tpos", "pos").distinct()


def spans(docs: DataFrame) -> DataFrame:
    """(k, label, base, first, last, score): verified spans in words, for docs with a row key k."""
    cast = Scratch(docs.sparkSession, "licenses").settle(votes(docs))  # read twice below; the texts are split once
    cast = cast.withColumn("diag", F.col("pos") - F.col("tpos"))
    line = cast.where("base").groupBy("k", "label", "base", "n_grams", "diag").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("lo"), (F.max("pos") + K).alias("hi"))
    whole = line.where(F.col("n") == F.col("n_grams")).select("k", "label", "base", F.col("lo").alias("first"), F.col("hi").alias("last"), F.lit(1.0).alias("score"))
    near = Window.partitionBy("k", "label").orderBy("diag")
    gap = F.col("diag") - F.lag("diag").over(near)
    bent = cast.where(~F.col("base")).withColumn("new", F.when(gap.isNull() | (gap > SLACK), 1).otherwise(0))
    bent = bent.withColumn("line", F.sum("new").over(near))
    bent = bent.groupBy("k", "label", "base", "n_grams", "line", "tpos").agg(F.min("pos").alias("pos"))
    before = Window.partitionBy("k", "label", "line").orderBy("tpos").rowsBetween(Window.unboundedPreceding, -1)
    bent = bent.withColumn("before", F.max("pos").over(before)).where("before is null or pos > before")
    bent = bent.groupBy("k", "label", "base", "n_grams", "line").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"), (F.max("pos") + K).alias("last"))
    score = F.col("n") / F.col("n_grams")
    dense = F.col("n") >= DENSE * (F.col("last") - F.col("first") - (K - 1))
    return whole.union(bent.where(dense & (score >= ENOUGH)).select("k", "label", "base", "first", "last", score.alias("score")))


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text), as op7 defines it."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("k", row_key())
    found = spans(docs).groupBy("k").agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
    )
    rows = docs.select("doc_id", "k", F.regexp_count(lowered(F.col("text")), F.lit(WORD)).cast("long").alias("n_words")).join(found, "k", "left")
    return rows.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_license_scan": op7_license_scan}
ORACLE: dict = {}
