"""Registered queries of this subpackage. Each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsql.llm import bpe, conversations, hilbert, neardup, ocr, packing, pii, spans, splitting
from docsql.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(table(spark, d, "ingest_documents"), table(spark, d, "chunk_options"))


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(table(spark, d, "ingest_documents"), table(spark, d, "chunk_options"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hilbert.similar_pairs(table(spark, d, "chunks"))


def p2_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The 5 nearest of every chunk whose id is divisible by 20, against all chunks; a twentieth of the rows, so more orderings and wider windows."""
    return hilbert.nearest(table(spark, d, "chunks"), asked="id % 20 = 0", orderings=20, window=2048).select("id", "neighbour", "similarity", "rank")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.mentions(table(spark, d, "ingest_documents"), table(spark, d, "messages"))


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(table(spark, d, "ingest_documents"), table(spark, d, "messages"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_records(table(spark, d, "ingest_documents"), 0.6)


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.record_groups(table(spark, d, "ingest_documents"), 0.6)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return ocr.noisy_lines(table(spark, d, "ingest_documents"))


def p6_repaired(spark: SparkSession, d: str) -> DataFrame:
    return ocr.repaired(table(spark, d, "ingest_documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.thread_verdicts(table(spark, d, "messages"), table(spark, d, "threads")).where(F.col("reason").isNotNull())


def p7_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversations(table(spark, d, "messages"), table(spark, d, "threads"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_ids(table(spark, d, "documents").select("doc_id", "text"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(table(spark, d, "documents"), table(spark, d, "context_windows"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.sharing_pairs(table(spark, d, "documents"))


def p10_spans(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_stretches(table(spark, d, "documents"))


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_shares(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    found = [p1_found, p1_pieces, p2_found, p2_nearest, p3_found, p3_redacted, p5_found, p5_groups, p6_found, p6_repaired, p7_found, p7_conversations, p8_ids, p9_containers, p10_found, p10_spans, p10_shares]
    return {q.__name__: q for q in found}
