"""Null ids, repeated rows, very long texts and clashing columns in operators whose other tests lack them."""

import glob

import pytest

from rowmill.llm import common, decontaminate, html_text, licenses, ngram_join, suffix_dedup, topk

SCHEMA = "doc_id long, text string, k string, n_words int, item_id long, component_id string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, 2, "c") for i, t in rows], SCHEMA).repartition(3)


def words(n, stem="word"):
    return " ".join(f"{stem}{j}" for j in range(n))


def test_decontaminate(spark):
    item = words(30, "item") + " the answer is seven hundred and four"
    bench = spark.createDataFrame([(7, item), (7, item), (None, words(25, "other") + " so it is indeed"), (8, None), (9, "")], "item_id long, text string")
    rows = [(None, f"{words(40)} {item} {words(40)}"), (None, f"{words(40)} {item} {words(40)}"), (1, words(90)), (2, None), (3, ""), (4, words(120_000, "long") + " " + item)]
    kept = decontaminate.drop_leaks(table(spark, rows), bench).collect()
    assert sorted(((r.doc_id or 0), (r.text or "")[:8]) for r in kept) == [(1, "word0 wo"), (2, ""), (3, "")]
    assert len(decontaminate.drop_leaks(table(spark, rows), bench).columns) == 6


def test_ngram_join(spark):
    text = words(40)
    rows = [(None, text), (None, text), (None, text + " end"), (5, text + " more"), (None, None), (None, ""), (6, words(5, "x")), (6, words(5, "x")), (6, words(90, "y")), (9, words(60_000, "z")), (10, words(60_000, "z") + " tail")]
    got = sorted(((r.doc_id or -1), r.n_shingles, -1 if r.component_id is None else r.component_id) for r in ngram_join.join_classes(table(spark, rows)).collect())
    assert got == sorted([(-1, 36, 5), (-1, 36, 5), (-1, 37, 5), (5, 37, 5), (-1, 0, -1), (-1, 0, -1), (6, 1, 6), (6, 1, 6), (6, 86, 6), (9, 59_996, 9), (10, 59_997, 9)])


def test_ngram_join_with_groups_of_several_components(spark, monkeypatch):
    """With one shared bucket enough for a group, groups hold many components; links between groups are still all found."""
    monkeypatch.setattr(ngram_join, "VOTES", 1)
    rows = []
    for f in range(40):
        base = [f"f{f}w{j}" if j % 3 else f"common{j}" for j in range(60)]
        for v in range(5):
            text = list(base)
            for e in range(v * 2):
                text[(e * 17 + f * 5 + v) % 60] = f"e{f}v{v}n{e}"
            rows.append((f * 10 + v, " ".join(text)))
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(56)} for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: r.component_id for r in ngram_join.join_classes(table(spark, rows)).collect()}
    assert got == {i: find(i) for i in sets}


def test_ngram_join_of_few_rows_over_many_partitions(spark, monkeypatch):
    """Small tables take tasks and files by their size, whatever the number of shuffle partitions; rounds cost so many times that."""
    made = []
    settle = common.Scratch.settle

    def counted(self, df):
        out = settle(self, df)
        made.append(len(glob.glob(f"{out._rowmill_path.removeprefix('file://')}/part-*")))
        return out

    monkeypatch.setattr(common.Scratch, "settle", counted)
    rows = [(i, words(40, f"f{i // 4}x") + f" end{i % 4}") for i in range(400)]
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "32")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {r.doc_id: r.component_id for r in ngram_join.join_classes(table(spark, rows)).collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got == {i: i // 4 * 4 for i, _ in rows}
    assert len(made) > 30 and max(made) <= 4 * spark.sparkContext.defaultParallelism


def test_suffix_dedup(spark):
    text = words(60)
    got = sorted(((r.doc_id or -1), r.n_bytes, r.n_removed) for r in suffix_dedup.drop_repeats(table(spark, [(None, text), (None, text), (None, None), (1, text[:199]), (2, words(40_000, "q"))])).collect())
    n, big = len(text), len(words(40_000, "q"))
    assert got == sorted([(-1, n, n), (-1, n, n), (-1, 0, 0), (1, 199, 0), (2, big, 0)])


def test_licenses(spark):
    text = words(30) + " Under the MIT License, and " + words(20_000, "z") + " cc-by-nc"
    rows = [(None, text), (None, text), (3, None), (3, ""), (4, "under the mit license" * 1)]
    got = sorted(((r.doc_id or -1), r.n_words, r.n_base, r.base_labels) for r in licenses.scan(table(spark, rows)).collect())
    assert got == sorted([(-1, 20_038, 2, "cc-by-nc,mit")] * 2 + [(3, 0, 0, ""), (3, 0, 0, ""), (4, 4, 1, "mit")])


@pytest.mark.parametrize("html", ["<p>" + "a " * 500_000, "<" * 200_000, "&amp;" * 100_000])
def test_long_pages(spark, html):
    df = spark.createDataFrame([(None, None, html, "t"), (None, None, html, "t")], "page_id long, url string, html string, text string")
    got = html_text.extract(df).collect()
    assert len(got) == 2 and got[0] == got[1] and got[0].n_chars == len(got[0].text)


def test_top_k_of_repeated_queries(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 1.0]), (3, [1.0, 1.0]), (None, [9.0, 9.0]), (4, [1.0]), (5, [float("nan"), 1.0])]
    df = spark.createDataFrame([(i, e, 1, 2) for i, e in rows], "vec_id long, embedding array<double>, score int, q int")
    got = sorted(map(tuple, topk.top_k(df, df.where("vec_id = 1"), 2).collect()))
    assert got == [(1, 1, 2, 65536), (1, 1, 2, 65536), (1, 2, 3, 65536), (1, 2, 3, 65536)]
