"""A corpus pipeline: documents to token ids, in five stages.

Every stage takes what its predecessor kept, written as Parquet and read again.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versotext.llm import decontaminate, jaccard_join, language, sentencepiece_scan, toxicity
from versotext.llm.text import ensure_checkpoint_dir, remainder, remove_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters go, null and empty ones too, and those without a language of probability 0.5 or more.

    Rows with a null id and repeated rows are judged by their text like any other; extra columns stay.
    Where no row has a language to learn from, every text with letters stays.
    """
    model = language.train(docs, remainder(F.col("doc_id"), 3) != 1)
    return language.keep_identified(docs, model)


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of 0.5 or more go; labels of held-out ids are never learned from.

    Null and empty texts stay, rows with a null id and repeated rows are judged by their text; extra
    columns stay. Without labels of both kinds the score is the share of toxic ones, 0.5 without any,
    and then every text goes or stays alike: without any label all of them stay.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_civil(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (5-word shingles, Jaccard 0.8) the smallest id stays.

    Texts without words link with nothing and stay, as do rows with a null id; of rows that repeat an id one
    stays, the one with the smallest text. Extra columns stay.
    """
    return jaccard_join.keep_one_of_each(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 80 % of a benchmark item's 5-word shingles go.

    Null and empty texts and rows with a null id stay; of an id that repeats all rows go if one holds an
    item. Extra columns stay.
    """
    held = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(held.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, their number, and the text decoded from them; null texts count as empty, every row gives a row."""
    return sentencepiece_scan.encode_with_text(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language_id),
    ("toxicity", civil),
    ("jaccard_join", one_of_each),
    ("decontamination", uncontaminated),
    ("sentencepiece", encoded),
]

#: SQL can't express the learned stages and the path search; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared checkpoint folder and read again.

    A stage's files are removed when its successor's are written; those of the last one are the result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove_folder(spark, before)
        before = f"{folder}/{name}"
    return docs
