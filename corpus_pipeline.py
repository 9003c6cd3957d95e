"""A corpus pipeline: language, near-duplicates, personal data, mixing, tokens. Each stage takes the documents that the one before
kept, written as Parquet and read again.

In every stage a null text counts as empty, texts are taken whole, however long, a null doc_id is a document like any other, and an empty table
gives an empty result. Columns beyond those of ``documents`` don't matter, whatever their names.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from rallyframe.llm import jaccard, langid, mixing, pieces, pii  # noqa: E402
from rallyframe.llm.queries import prepare, table  # noqa: E402
from rallyframe.llm.stored import store  # noqa: E402

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null texts and texts without a letter go. Repeated rows share their fate."""
    prepare(spark)
    return langid.known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that links by 5-word shingles at a similarity of 0.8;
    rows that repeat an id and a text stay once, null ids only if their group holds no other id."""
    prepare(spark)
    return jaccard.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind; null texts stay null."""
    prepare(spark)
    masked = pii.mask_pii(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them: a row per pass over a document, with the taken words. Documents without words go; a null
    source is a source."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and token ids of every row, repeated ones too."""
    prepare(spark)
    return pieces.encode_documents(docs, carry=("lang", "source"))


STAGES: list[tuple[str, Stage]] = [
    ("language id", language), ("n-gram Jaccard join", near_duplicates), ("personal data", personal_data),
    ("mixing to target weights", source_mix), ("SentencePiece", tokens)]

# automata, seeded draws and tokens are beyond SQL; tests/llm checks the stages against brute force
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = store(docs, "stage")
    return docs
