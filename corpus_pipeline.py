"""Corpus pipeline: stages over ``documents``, each written and read again as the next one's input.

1. language: documents the classifier rejects (no letter, or no learnt language fits) go.
2. near_copies: of documents that link by word shingles, one stays: the first by id.
3. mixing: documents repeat as often as the mix of their source takes them.
4. sentence_pieces: (doc_id, token_ids, n_tokens, restored) of each row.

All but the last return the columns of their input, whatever other columns it has.  Rows
without an id are rows like others; an empty table gives an empty result; what each
stage does with nulls, empty and long texts, ties and repeats stands in its operator's
module.  A stage's table goes once the next one is written.  Stages that send texts to Python
set fewer rows at a time for the session (``lean``).  A trained classifier, a
transitive closure and seeded sampling are beyond SQL: ``ORACLE_SQL`` is None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skylattice.llm import language, mixing, ngram_join, sentence_pieces
from skylattice.llm.common import discard, lean, stored


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark)
    return language.identified(docs)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs)


def sentence_pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark)
    return sentence_pieces.encode_documents(docs)


STAGES = [
    ("language", language_stage),
    ("near_copies", near_copies_stage),
    ("mixing", mixing_stage),
    ("sentence_pieces", sentence_pieces_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES[:-1]):
        given, docs = docs, stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if at:
            discard(given)
    return STAGES[-1][1](spark, docs, sf_dir)
