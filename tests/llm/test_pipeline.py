"""The pipeline and its stages against plain versions."""

import struct
import zlib

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from rowmill.llm import mixing, ngram_join, token_files  # noqa: E402


def test_stages(spark, sf):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, steps = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        steps.append((name, docs))
        docs = stage(spark, docs, sf)
        if name != "token_files":
            assert docs.columns == columns
            docs = spark.createDataFrame(docs.toPandas(), docs.schema)
    before = dict(steps)
    ids = {n: sorted(r.doc_id for r in d.select("doc_id").collect()) for n, d in before.items()}
    assert set(ids["ngram_join"]) <= set(ids["toxicity"]) and len(ids["ngram_join"]) > 0.85 * len(ids["toxicity"])
    # one document of each group stays
    classes = ngram_join.join_classes(before["ngram_join"]).collect()
    assert ids["decontaminate"] == sorted(r.doc_id for r in classes if r.n_shingles == 0 or r.doc_id == r.component_id)
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = [r.text for r in before["mix_sources"].collect()]
    assert not [t for t in kept for b in bench if b in t]
    plan = {r.doc_id: r for r in mixing.plan_mix(before["mix_sources"], mixing.Scratch(spark, "t")).collect()}
    assert ids["token_files"] == sorted(d for d, r in plan.items() if r.size for _ in range(-(-r.taken // r.size)))
    lib = Tokenizer.from_file(token_files.tokenizer_path())
    want = []
    for r in before["token_files"].collect():
        x = lib.encode(r.text or "", add_special_tokens=False).ids + [0]
        want.append((r.doc_id, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))))
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in docs.collect()) == sorted(want)


def test_run(spark, sf):
    got = corpus_pipeline.run(spark, sf).toPandas()
    assert list(got.columns) == ["doc_id", "start", "n_tokens", "ids_crc32"] and len(got)
    got = got.sort_values("start")
    assert (got.start.to_numpy()[1:] == (got.start + got.n_tokens).to_numpy()[:-1]).all()


def test_stages_on_odd_rows(spark, sf):
    """Nulls in every column, repeated rows and ids, empty texts, and a column whose name the operators use."""
    text = "some words of a document that is kept whole because nothing is wrong with it at all"
    rows = [(1, text, "en", "a", 3), (1, text, "en", "a", 3), (None, text + " again", None, None, None), (None, text + " again", None, None, None), (2, None, "en", "a", 0), (3, "", None, "b", 0), (1, "another text under an id that is taken already, which is fine", "en", "b", 9), (4, "x" * 3000, "en", None, 3000)]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, k string")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf)
        assert name == "token_files" or got.columns == docs.columns
        n = got.count()
        assert stage(spark, docs.limit(0), sf).count() == 0
        if name in ("toxicity", "decontaminate", "token_files"):
            assert n == len(rows)
        elif name == "ngram_join":  # one of the two equal rows, one of the two without an id
            assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == sorted({(i or 0, t or "") for i, t, *_ in rows if t != text + " again"} | ({(0, text + " again")} if n == 6 else set()))
