"""Queries of the training-data problems: splitting (p1), membership (p5), encoding (p7), packing (p8), subjects (p9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.functions.keys import norm_hash
from cairnlake.llm import encode, membership, packing, splitting, subjects
from cairnlake.plans.problems import norm_hash_sql
from cairnlake.session import staged
from cairnlake.sources.tables import table


def p7_ids(spark: SparkSession, root: str) -> DataFrame:
    return encode.encode_corpus(table(spark, root, "documents"))


def p8_packing(spark: SparkSession, root: str) -> DataFrame:
    """Every document in a container of 2,048 tokens."""
    return packing.pack(staged(encode.encode_corpus(table(spark, root, "documents"), counts=True), "p8-lengths"))


def p8_fill(spark: SparkSession, root: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill_report(p8_packing(spark, root))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    limits = table(spark, root, "chunk_limits")
    chunks = splitting.split_chunks(table(spark, root, "chunks"), limits, with_data=False)
    entries = splitting.split_entries(table(spark, root, "manifest_entries"), limits)
    kinds = F.when(F.col("longest_gap") > F.col("max_bytes"), F.array(F.lit("chunk"), F.lit("chunk_forced"))).otherwise(F.array(F.lit("chunk")))
    of_chunks = chunks.where("piece_no = 0").select(F.explode(kinds).alias("case_kind"), "item_key")
    of_entries = entries.where("piece_no = 0").select(F.lit("entry").alias("case_kind"), "item_key")
    return of_chunks.unionByName(of_entries).where(F.col("item_key").isNotNull()).distinct()


def p1_pieces(spark: SparkSession, root: str) -> DataFrame:
    """The pieces of all oversized chunks, with their data."""
    return splitting.split_chunks(table(spark, root, "chunks"), table(spark, root, "chunk_limits"))


def p1_entry_pieces(spark: SparkSession, root: str) -> DataFrame:
    """The pieces of all oversized manifest entries, as byte ranges."""
    return splitting.split_entries(table(spark, root, "manifest_entries"), table(spark, root, "chunk_limits"))


def _membership(spark: SparkSession, root: str) -> membership.Membership:
    arrivals = table(spark, root, "encrypted_chunks").select(F.col("arrival_id").alias("id"), norm_hash(F.col("content_hash")).alias("key"))
    known = table(spark, root, "chunks").select("hash").unionByName(table(spark, root, "builtin_chunks").select("hash"))
    return membership.seen_before(arrivals, known.select(norm_hash(F.col("hash")).alias("key")))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return _membership(spark, root).found().select(F.col("id").alias("arrival_id"))


def p5_rate(spark: SparkSession, root: str) -> DataFrame:
    """How many arrivals are called seen, and how often that is wrong."""
    return _membership(spark, root).rate()


def _subject_tables(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, root, "documents"), table(spark, root, "subject_labels"), table(spark, root, "subjects")


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return subjects.document_subjects(*_subject_tables(spark, root)).select("doc_id", "subject").distinct()


def p9_makeup(spark: SparkSession, root: str) -> DataFrame:
    """How many documents, and of how many characters, are about each subject."""
    docs = table(spark, root, "documents")
    found = subjects.document_subjects(*_subject_tables(spark, root))
    sized = found.join(docs.select("doc_id", F.length("text").alias("chars")), "doc_id")
    return sized.groupBy("subject").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("chars").alias("n_chars"), F.avg("probability").alias("mean_probability"))


def p9_quality(spark: SparkSession, root: str) -> DataFrame:
    """Right, wrong and missed cases among held-out labelled documents."""
    return subjects.held_out_quality(*_subject_tables(spark, root))


QUERIES = {
    "p9_found": p9_found,
    "p9_makeup": p9_makeup,
    "p9_quality": p9_quality,
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p1_entry_pieces": p1_entry_pieces,
    "p5_found": p5_found,
    "p5_rate": p5_rate,
    "p7_ids": p7_ids,
    "p8_packing": p8_packing,
    "p8_fill": p8_fill,
}

_BYTES = "regexp_replace(hex({}), '(..)', '\\1,', 'g')"

SQL: dict[str, str] = {
    "p1_found": f"""
WITH c AS (
  SELECT hash, data, max_bytes, list_max(list_transform(string_split({_BYTES.format("data")}, {_BYTES.format("boundary")}), lambda x: len(x) // 3)) AS gap
  FROM chunks JOIN chunk_limits USING (category) WHERE octet_length(data) > max_bytes)
SELECT 'chunk' AS case_kind, hash AS item_key FROM c
UNION SELECT 'chunk_forced', hash FROM c WHERE gap > max_bytes
UNION SELECT 'entry', entry_id::VARCHAR FROM manifest_entries, chunk_limits WHERE category = 'manifest_entry'
  AND greatest(size, list_max(list_transform(chunks, lambda x: x.byte_offset + x.size))) > max_bytes""",
    "p5_found": f"""
WITH a AS (SELECT arrival_id, {norm_hash_sql("content_hash")} AS key FROM encrypted_chunks),
k AS (SELECT {norm_hash_sql("hash")} AS key FROM chunks UNION SELECT {norm_hash_sql("hash")} FROM builtin_chunks)
SELECT arrival_id FROM (SELECT *, min(arrival_id) OVER (PARTITION BY key) AS first FROM a WHERE key IS NOT NULL)
WHERE arrival_id > first OR key IN (SELECT key FROM k WHERE key IS NOT NULL)""",
}
