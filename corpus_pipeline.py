"""A training corpus from raw documents: quality, near-duplicates, personal data, mixing, tokens.

Each stage takes what the one before kept and returns the columns of documents, but for the last, which returns tokens. In every stage
null and empty texts are texts without words: the classifier scores them as such, they are nobody's near copy, hold no personal data
and are mixed in 0 times. Long texts go through whole. Null ids stay, rows that repeat an id and their text are near copies of
each other, empty tables stay empty, and further columns are carried along, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from dqspark.llm import bpe, mixing, neardup, pii, quality
from dqspark.llm.common import Workspace, table

#: Near copies share this part of their shingles of five words.
SIMILARITY = 0.8

#: The trained filter, near-duplicate trees, the random field and seeded sampling have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on all labels, takes to be of quality."""
    net = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.keep(docs, net)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    return neardup.distinct_documents(docs, SIMILARITY)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixing.repeated(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids of every text."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("tokens", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage but the last is written to the shared folder and read again."""
    work, before = Workspace(spark, "pipeline"), None
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir), name)
        work.release()
        if before:
            work.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
