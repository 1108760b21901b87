"""The named queries over the text operators, with their parameters, and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontaminate, langid, line_dedup, minhash, pipeline, quality, substring_dedup, topk, toxicity
from .common import table

TOKENIZER = "word_bpe_49k.json"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"), fuzzy_words=8)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=50)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), modulus=5, remainder=0)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), modulus=5, remainder=0, accept=0.3)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.format_conversations(rows.unionByName(extra))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=12, agree=10)


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return topk.search(docs, docs.filter("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"), k=10)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(table(spark, sf_dir, "documents"), modulus=3, remainder=1)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_line_dedup, op2_substring_dedup, op3_toxicity, op4_bpe, op5_quality, op6_minhash, op7_chat, op8_decontaminate, op9_topk, op10_langid)
    return {f.__name__: f for f in own} | {"pipeline": pipeline.run}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    sql = dict(oracles.ORACLES)
    if pipeline.ORACLE_SQL:
        sql["pipeline"] = pipeline.ORACLE_SQL
    return sql
