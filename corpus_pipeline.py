"""A training corpus from documents: five stages, each on all that the one before kept.

    1. quality: the rule ensemble drops documents that it scores below its threshold
    2. language: documents without letters, or in none of the learned languages, go
    3. near_duplicates: of documents linked by shingle similarity, the one of smallest id stays
    4. secrets: every secret span of a text is masked
    5. packing: token ids in windows

All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import jaccard_join, language_id, packing, rule_ensemble, secret_scan
from siltstone.llm.common import documents
from siltstone.sources.shared import written

#: Near copies: shingles of so many words, and the least Jaccard similarity of their sets.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: Bytes of pieces that a worker of the last stage remembers: it lives on with the memory of the stages before.
PACK_MEMO = 24 << 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rule_ensemble.kept_by_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.kept_by_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each_group(docs, NEAR_WORDS, NEAR_PERCENT)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.masked(docs, *secret_scan.train(secret_scan.samples(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), memo=PACK_MEMO)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", pack)]
#: SQL can't express the models and the tokenizer: tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
