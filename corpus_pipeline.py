"""The corpus pipeline: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from voxlake.llm import bpe, exact_dedup, mixing, near_dedup, quality_cnn
from voxlake.llm.scratch import bound_batches, materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Each row is judged by its own whole text: a null or empty text has
    a score like any other, very long texts are read to their end, repeated rows stay or go together, an empty table stays
    empty, and without labels of both kinds all rows stay. Other columns, whatever their names, are returned as they are."""
    bound_batches(spark)
    return quality_cnn.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: white space aside, that with the most characters, then the smallest id
    (null last). Null and empty texts are equal to each other; of repeated rows one stays; very long texts are compared in
    full; an empty table stays empty. Other columns, whatever their names, are returned as they are."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that with the least id (null last). Texts without words are near copies
    of equal ones only; texts of one to four words are one shingle; very long texts count all their shingles; of repeated rows
    one stays; an empty table stays empty. Other columns, whatever their names, are returned as they are."""
    return near_dedup.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it, three times at most. A null source is a source, the last one;
    a document without words is never taken; sources of equal size go by name; repeated rows are documents of their own; an
    empty table stays empty. Other columns, whatever their names, are returned as they are."""
    return mixing.resample(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token counts and the digests of ids and of the decoded bytes, one row for each row. A null text is empty and has
    no tokens; very long texts are encoded in full; ids may be null or repeat; an empty table gives no rows; other columns
    are left out."""
    bound_batches(spark)
    vocabulary = bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(bpe.decode(bpe.encode(docs, vocabulary), vocabulary))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("near-duplicate removal", drop_near_copies),
    ("source mixing", mix_sources),
    ("byte-level BPE", tokenise),
]

#: A learned classifier, hashed samples and byte pair merges aren't SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents; each stage's output is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
