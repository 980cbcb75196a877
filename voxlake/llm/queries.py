"""The queries of this subpackage, for __spark_entry__.py, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from voxlake.llm import bpe, exact_dedup, line_dedup, mixing, near_dedup, ngram_join, quality_cnn, sharding, source_audit, spelling, url_cascade, vptree, warc
from voxlake.llm.scratch import bound_batches, fresh_dir

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule and verdict of every page's url, by the cascade of the usual rules."""
    return url_cascade.verdicts(_table(spark, sf_dir, "pages"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document's whole text; learns only from labels that aren't held out."""
    bound_batches(spark)
    return quality_cnn.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document's whole text, encoded and decoded again."""
    bound_batches(spark)
    vocabulary = bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), vocabulary), vocabulary))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every document, by equal texts without white space."""
    return exact_dedup.decisions(_table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document, in 40 shards by key."""
    return sharding.assign(_table(spark, sf_dir, "documents"))


def op6_vp_tree_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id and score of the 20 nearest of all vectors for those whose id is divisible by 20."""
    vectors = _table(spark, sf_dir, "embeddings")
    return vptree.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, n_lines, n_links, removed and source of every document, by its lines' matches among all lines."""
    return line_dedup.classes(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document, in the mix of all sources."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, archived and found again by its url."""
    return warc.archive_and_read(spark, _table(spark, sf_dir, "pages"), fresh_dir(spark, "warc"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id and class_size of every document, by near copies among all documents."""
    return near_dedup.classes(_table(spark, sf_dir, "documents"))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, source, part, item, value and rank: how far each two sources of a language diverge, and each source's top terms."""
    return source_audit.audit(_table(spark, sf_dir, "documents"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of every document, by links between sets of word 3-grams of all documents."""
    return ngram_join.join(_table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near and form_n of every frequent word of all documents, by words one edit away."""
    return spelling.variants(_table(spark, sf_dir, "documents"))


_ALL = (
    op1_url_filters,
    op2_quality_classifier,
    op3_byte_bpe,
    op4_exact_dedup,
    op5_sharding,
    op6_vp_tree_neighbours,
    op7_line_dedup,
    op8_mixing,
    op9_warc,
    op10_near_dedup,
    op11_source_audit,
    op12_ngram_join,
    op13_spelling_variants,
)
QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filters": url_cascade.ORACLE_SQL,
    "op4_exact_dedup": exact_dedup.ORACLE_SQL,
    "op11_source_audit": source_audit.ORACLE_SQL,
    "op12_ngram_join": ngram_join.ORACLE_SQL,
    "op13_spelling_variants": spelling.ORACLE_SQL,
}
