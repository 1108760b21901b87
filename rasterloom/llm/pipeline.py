"""The training-text pipeline: toxicity, line dedup, near-dedup, decontamination, tokenization.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that the next one reads back from
Parquet as its docs; all but the last return the columns of documents.

Defined results: null and empty texts pass all stages and end with no tokens; rows with a null
id pass the two dedup stages unchanged and are judged by the others like any row; of repeated rows
(same id, same text) all stay or all go, and rows that share an id but not a text are judged
one by one by the toxicity and decontamination stages, together by near-dedup; an empty table
gives no rows; further columns of documents are carried to the last stage, which returns its own."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, line_dedup, minhash, toxicity
from .common import shared_folder, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"), source=table(spark, sf_dir, "documents"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.remove_duplicate_lines(docs, fuzzy_words=8)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one_each(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("bpe", tokenize),
]

#: Fitted models and byte-pair merges are beyond SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written and read again, and removed when Python ends."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        docs = written(out, os.path.join(folder, f"{k}_{name}"))
