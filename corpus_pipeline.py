"""A training-corpus pipeline of five stages over `documents`.

1. toxicity: documents predicted toxic go.
2. ngram_join: of each group of near-duplicates the document with the smallest id stays.
3. decontaminate: documents that hold a benchmark item or a paraphrase of it go.
4. mix: documents are taken as often as their source's target weight asks for, the one at its threshold in part (3 copies at most).
5. token_files: what is left is written as token shards and read back as digests.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result as Parquet to the shared folder and
rereads it as the next stage's docs. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowmill.llm.common import Scratch
from rowmill.llm.decontaminate import drop_leaks
from rowmill.llm.mixing import mix
from rowmill.llm.ngram_join import keep_one
from rowmill.llm.token_files import token_files
from rowmill.llm.toxicity import drop_toxic


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_join", ngram_stage),
    ("decontaminate", decontaminate_stage),
    ("mix_sources", mix_stage),
    ("token_files", token_stage),
]

#: Trees, latent spaces and tokenizers have no SQL; tests/llm holds the operators against plain versions and each stage to its operator.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.settle(docs)
    return docs
