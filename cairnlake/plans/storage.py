"""Queries on objects, chunks and deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlake.functions.keys import norm_hash
from cairnlake.operators import storage as op
from cairnlake.plans import relations as R
from cairnlake.plans.problems import norm_hash_sql as NH
from cairnlake.plans.relations import sql
from cairnlake.sources.tables import table


def _refs(s, d):
    return R.chunk_refs(R.head_entries(s, d), "repo", "branch")


def _blocks(s, d):
    return op.fixed_blocks(R.files(s, d).select("doc_id", "text"), "text", 64).select("doc_id", "idx", F.sha2("block", 256).alias("chunk_hash"), F.octet_length("block").cast("long").alias("size"), "block")


ORDER = ["repo", "branch", "path", "idx"]

QUERIES = {
    "scan_objects": lambda s, d: table(s, d, "object_files").groupBy(F.substring_index(F.substring_index("object_path", "/", 2), "/", -1).alias("kind")).agg(F.count(F.lit(1)).alias("n")),
    "scan_object_bytes": lambda s, d: table(s, d, "object_files").agg(F.sum(F.octet_length("data")).alias("bytes")),
    "scan_proxies_by_suffix": lambda s, d: table(s, d, "object_files").where(F.col("object_path").startswith("objects/chunks/")).agg(F.count(F.lit(1)).alias("n")),
    "file_stats": lambda s, d: op.file_stats(R.head_entries(s, d)),
    "list_files": lambda s, d: R.head_entries(s, d).select("repo", "branch", "path"),
    "repo_stats": lambda s, d: R.commits(s, d).select("hash").distinct().agg(F.count(F.lit(1)).alias("n_commits")).crossJoin(table(s, d, "manifests").agg(F.countDistinct("manifest").alias("n_manifests"))).crossJoin(R.stored_chunks(s, d).agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("size").alias("chunk_bytes"))),
    "repo_dedup_stats": lambda s, d: op.dedup_stats(_refs(s, d)),
    "text_dedup_stats": lambda s, d: op.dedup_stats(_blocks(s, d)),
    "file_dedup_stats": lambda s, d: op.file_dedup_stats(_refs(s, d)),
    "chunk_usage_count": lambda s, d: op.usage_counts(_refs(s, d), ["repo", "branch"]).select(*ORDER, "chunk_hash", "usage"),
    "first_occurrence": lambda s, d: op.first_occurrences(_refs(s, d), ORDER).select(*ORDER, "was_new"),
    "add_result": lambda s, d: op.add_result(_refs(s, d), ORDER),
    "chunk_stats": lambda s, d: op.chunk_stats(_refs(s, d)),
    "compression_ratio": lambda s, d: op.compression_ratios(R.stored_chunks(s, d)),
    "manifest_totals": lambda s, d: op.manifest_totals(R.head_entries(s, d)),
    "unique_chunk_hashes": lambda s, d: _refs(s, d).groupBy("repo", "branch").agg(F.countDistinct("chunk_hash").alias("n")),
    "chunk_offsets": lambda s, d: op.chunk_offsets(_refs(s, d)),
    "chunks_for_range": lambda s, d: op.chunks_for_range(_refs(s, d), 500, 1500),
    "chunk_ref_count": lambda s, d: op.reference_counts(R.chunk_refs(R.entries(s, d), "repo"), R.stored_chunks(s, d)),
    "refcount_negative": lambda s, d: op.reference_counts(R.chunk_refs(R.entries(s, d), "repo"), R.stored_chunks(s, d)).where("off_by < 0").agg(F.count(F.lit(1)).alias("n")),
    "refcount_decrement": lambda s, d: op.decrement(R.stored_chunks(s, d), _refs(s, d).select(F.col("chunk_hash").alias("hash")), F.lit("2026-07-01").cast("timestamp_ntz")),
    "missing_objects": lambda s, d: op.missing(_refs(s, d).select(F.col("chunk_hash").alias("hash")).where("hash is not null"), table(s, d, "object_files").select(norm_hash(F.col("hash")).alias("hash"))),
    "have_want": lambda s, d: op.have_want(_refs(s, d).select(F.col("chunk_hash").alias("hash")).where("hash is not null"), R.stored_chunks(s, d)),
    "put_if_absent": lambda s, d: op.put_if_absent(R.stored_chunks(s, d).select("hash"), _refs(s, d).where("chunk_hash is not null").select(F.col("chunk_hash").alias("hash"))),
    "unreferenced_objects": lambda s, d: R.stored_chunks(s, d).select("hash", "size").join(R.chunk_refs(R.entries(s, d), "repo").select(F.col("chunk_hash").alias("hash")), "hash", "left_anti"),
    "gc_orphans": lambda s, d: R.stored_chunks(s, d).where("ref_count <= 1 and deleted_at is null and created_at < timestamp_ntz'2025-06-01'").orderBy("created_at", "hash").limit(100).select("hash", "created_at"),
    "storage_usage": lambda s, d: op.storage_usage(R.stored_chunks(s, d)),
    "daily_storage_cost": lambda s, d: op.storage_usage(R.stored_chunks(s, d)).select("day", (F.col("total_bytes") / 1e12 * 0.023).alias("cost")),
    "largest_files": lambda s, d: op.largest(R.head_entries(s, d).select("repo", "branch", "path", "size"), ["repo", "branch"], "size", "path", 10).select("repo", "branch", "path", "size", "rank"),
    "repository_storage": lambda s, d: _refs(s, d).groupBy("repo", "chunk_hash").agg(F.sum("size").alias("l"), F.max("size").alias("p")).groupBy("repo").agg(F.sum("l").alias("total_bytes"), F.sum("p").alias("unique_bytes"), F.count("chunk_hash").alias("unique_chunks")),
    "fixed_chunk": lambda s, d: _blocks(s, d).select("doc_id", "idx", "chunk_hash", "size"),
    "line_chunk": lambda s, d: op.lines(R.files(s, d).select("doc_id", "text"), "text").select("doc_id", "idx", F.sha2("line", 256).alias("chunk_hash")),
    "reassemble": lambda s, d: op.reassembled(_blocks(s, d), "doc_id", "block"),
    "verify_objects": lambda s, d: table(s, d, "object_files").where("data is not null").select("file_id", (F.sha2("data", 256) == norm_hash(F.col("hash"))).alias("intact")),
    "table_counts": lambda s, d: table(s, d, "commits").agg(F.count(F.lit(1)).alias("commits")).crossJoin(table(s, d, "chunks").agg(F.count(F.lit(1)).alias("chunks"))).crossJoin(table(s, d, "manifest_entries").agg(F.count(F.lit(1)).alias("entries"))),
}

_BLOCKS = "b AS (SELECT doc_id, i AS idx, sha256(substr(text, i * 64 + 1, 64)) AS chunk_hash, strlen(substr(text, i * 64 + 1, 64)) AS size, substr(text, i * 64 + 1, 64) AS block FROM documents, unnest(range(0, (length(text) + 63) // 64)) t(i) WHERE length(text) > 0)"
_DEDUP = "SELECT coalesce(sum(n), 0)::BIGINT AS n_refs, count(chunk_hash) AS unique_chunks, coalesce(sum(l), 0)::BIGINT AS logical, coalesce(sum(p), 0)::BIGINT AS physical, greatest(coalesce(sum(l), 0) - coalesce(sum(p), 0), 0)::BIGINT AS saved, coalesce(sum(p)::DOUBLE / nullif(sum(l), 0), 1.0) AS ratio FROM (SELECT chunk_hash, count(*) AS n, sum(size) AS l, max(size) AS p FROM {} GROUP BY 1)"
_ALLREFS = f"allrefs AS (SELECT {NH('e.chunks[i].hash')} AS hash FROM entries e, unnest(range(1, len(e.chunks) + 1)) t(i))"
_FIRST = "f AS (SELECT *, row_number() OVER (PARTITION BY chunk_hash ORDER BY repo, branch, path, idx) = 1 AS was_new FROM refs WHERE chunk_hash IS NOT NULL)"
_HEAD = "entries snaps head "

SQL = {
    "scan_objects": "SELECT split_part(object_path, '/', 2) AS kind, count(*) AS n FROM object_files GROUP BY 1",
    "scan_object_bytes": "SELECT sum(octet_length(data))::BIGINT AS bytes FROM object_files",
    "scan_proxies_by_suffix": "SELECT count(*) AS n FROM object_files WHERE starts_with(object_path, 'objects/chunks/')",
    "file_stats": sql(_HEAD, f"SELECT repo, branch, path, size, coalesce(len(chunks), 0) AS chunk_count, coalesce(array_to_string(list_transform(chunks, lambda c: {NH('c.hash')}), ','), '') AS hashes, regexp_matches(lower(path), '\\.(mp4|mov|m4v)$') AS is_mp4 FROM head"),
    "list_files": sql(_HEAD, "SELECT repo, branch, path FROM head"),
    "repo_stats": sql("cm stored", "SELECT (SELECT count(DISTINCT hash) FROM cm) AS n_commits, (SELECT count(DISTINCT manifest) FROM manifests) AS n_manifests, (SELECT count(*) FROM stored) AS n_chunks, (SELECT sum(size)::BIGINT FROM stored) AS chunk_bytes"),
    "repo_dedup_stats": sql(_HEAD + "refs", _DEDUP.format("refs")),
    "text_dedup_stats": f"WITH {_BLOCKS} " + _DEDUP.format("b"),
    "file_dedup_stats": sql(_HEAD + "refs", "SELECT repo, branch, path, count(*) AS chunk_count, count(*) FILTER (u > 1) AS shared_chunks, count(*) FILTER (u = 1) AS unique_chunks, coalesce(sum(size) FILTER (u = 1), 0)::BIGINT AS unique_bytes, 100.0 * count(*) FILTER (u > 1) / count(*) AS shared_pct, 100.0 * count(*) FILTER (u = 1) / count(*) AS unique_pct FROM (SELECT *, count(*) OVER (PARTITION BY repo, branch, chunk_hash) AS u FROM refs WHERE chunk_hash IS NOT NULL) GROUP BY 1, 2, 3"),
    "chunk_usage_count": sql(_HEAD + "refs", "SELECT repo, branch, path, idx, chunk_hash, count(*) OVER (PARTITION BY repo, branch, chunk_hash) AS usage FROM refs WHERE chunk_hash IS NOT NULL"),
    "first_occurrence": sql(_HEAD + "refs", f"SELECT repo, branch, path, idx, was_new FROM (WITH {_FIRST} SELECT * FROM f)"),
    "add_result": sql(_HEAD + "refs", f"SELECT * FROM (WITH {_FIRST} SELECT count(*) FILTER (was_new) AS new_chunks, count(*) FILTER (NOT was_new) AS dedup_chunks, coalesce(sum(size) FILTER (was_new), 0)::BIGINT AS new_bytes, coalesce(sum(size) FILTER (NOT was_new), 0)::BIGINT AS dedup_bytes, sum(size)::DOUBLE / nullif(sum(size) FILTER (was_new), 0) AS dedup_ratio FROM f)"),
    "chunk_stats": sql(_HEAD + "refs", "SELECT sum(n)::BIGINT AS total_chunks, count(*) AS unique_chunks, sum(s)::BIGINT AS total_size, sum(hi)::BIGINT AS dedup_size, min(lo) AS min_size, max(hi) AS max_size, sum(s)::DOUBLE / sum(n) AS avg_size, sum(s)::DOUBLE / sum(hi) AS dedup_ratio FROM (SELECT chunk_hash, count(*) AS n, sum(size) AS s, min(size) AS lo, max(size) AS hi FROM refs GROUP BY 1)"),
    "compression_ratio": sql("stored", "SELECT coalesce(compression, 'none') AS compression, count(*) AS n, sum(size)::BIGINT AS stored, sum(original_size)::BIGINT AS original, coalesce(sum(size)::DOUBLE / nullif(sum(original_size), 0), 1.0) AS ratio FROM stored WHERE size IS NOT NULL AND original_size IS NOT NULL GROUP BY 1"),
    "manifest_totals": sql(_HEAD + "refs", "SELECT repo, branch, coalesce(sum(size), 0)::BIGINT AS total_size, sum(coalesce(len(chunks), 0))::BIGINT AS total_chunks, any_value(n) AS distinct_chunks FROM head LEFT JOIN (SELECT repo, branch, count(DISTINCT chunk_hash) AS n FROM refs GROUP BY 1, 2) USING (repo, branch) GROUP BY 1, 2"),
    "unique_chunk_hashes": sql(_HEAD + "refs", "SELECT repo, branch, count(DISTINCT chunk_hash) AS n FROM refs GROUP BY 1, 2"),
    "chunk_offsets": sql(_HEAD + "refs", "SELECT repo, branch, path, idx, chunk_hash, size, coalesce(sum(size) OVER (PARTITION BY repo, branch, path ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM refs"),
    "chunks_for_range": sql(_HEAD + "refs", "SELECT repo, branch, path, idx, chunk_hash, greatest(500 - start, 0) AS read_start, least(start + size, 2000) - greatest(start, 500) AS read_len FROM (SELECT *, coalesce(sum(size) OVER (PARTITION BY repo, branch, path ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM refs) WHERE start + size > 500 AND start < 2000"),
    "chunk_ref_count": sql("entries stored", f"SELECT * FROM (WITH {_ALLREFS} SELECT s.hash, ref_count, coalesce(n, 0) AS real_count, ref_count - coalesce(n, 0) AS off_by FROM stored s LEFT JOIN (SELECT hash, count(*) AS n FROM allrefs GROUP BY 1) r ON r.hash = s.hash)"),
    "refcount_negative": sql("entries stored", f"SELECT * FROM (WITH {_ALLREFS} SELECT count(*) AS n FROM stored s JOIN (SELECT hash, count(*) AS n FROM allrefs GROUP BY 1) r ON r.hash = s.hash WHERE ref_count < r.n)"),
    "refcount_decrement": sql(_HEAD + "refs stored", "SELECT s.hash, greatest(ref_count - n, 0) AS ref_count, CASE WHEN greatest(ref_count - n, 0) = 0 THEN TIMESTAMP '2026-07-31' END AS delete_after FROM stored s JOIN (SELECT chunk_hash, count(*) AS n FROM refs GROUP BY 1) r ON r.chunk_hash = s.hash"),
    "missing_objects": sql(_HEAD + "refs", f"SELECT DISTINCT chunk_hash AS hash FROM refs WHERE chunk_hash IS NOT NULL AND chunk_hash NOT IN (SELECT {NH('hash')} FROM object_files WHERE {NH('hash')} IS NOT NULL)"),
    "have_want": sql(_HEAD + "refs stored", "SELECT DISTINCT chunk_hash AS hash, chunk_hash IN (SELECT hash FROM stored) AS exists FROM refs WHERE chunk_hash IS NOT NULL"),
    "put_if_absent": sql(_HEAD + "refs stored", "SELECT hash FROM stored UNION SELECT chunk_hash FROM refs WHERE chunk_hash IS NOT NULL"),
    "unreferenced_objects": sql("entries stored", f"SELECT * FROM (WITH {_ALLREFS} SELECT hash, size FROM stored WHERE hash NOT IN (SELECT hash FROM allrefs WHERE hash IS NOT NULL))"),
    "gc_orphans": sql("stored", "SELECT hash, created_at FROM stored WHERE ref_count <= 1 AND deleted_at IS NULL AND created_at < TIMESTAMP '2025-06-01' ORDER BY created_at, hash LIMIT 100"),
    "storage_usage": sql("stored", "SELECT created_at::DATE AS day, count(*) AS n_chunks, coalesce(sum(size), 0)::BIGINT AS total_bytes, coalesce(sum(size) FILTER (tier = 'hot'), 0)::BIGINT AS hot_bytes, coalesce(sum(size) FILTER (tier = 'warm'), 0)::BIGINT AS warm_bytes, coalesce(sum(size) FILTER (tier = 'cold'), 0)::BIGINT AS cold_bytes, coalesce(sum(size) FILTER (coalesce(compression, 'none') != 'none'), 0)::BIGINT AS compressed_bytes, coalesce(sum(size) FILTER (coalesce(compression, 'none') = 'none'), 0)::BIGINT AS plain_bytes FROM stored GROUP BY 1"),
    "daily_storage_cost": sql("stored", "SELECT created_at::DATE AS day, coalesce(sum(size), 0) / 1e12::DOUBLE * 0.023::DOUBLE AS cost FROM stored GROUP BY 1"),
    "largest_files": sql(_HEAD, "SELECT repo, branch, path, size, row_number() OVER (PARTITION BY repo, branch ORDER BY size DESC NULLS LAST, path) AS rank FROM head QUALIFY rank <= 10"),
    "repository_storage": sql(_HEAD + "refs", "SELECT repo, sum(l)::BIGINT AS total_bytes, sum(p)::BIGINT AS unique_bytes, count(chunk_hash) AS unique_chunks FROM (SELECT repo, chunk_hash, sum(size) AS l, max(size) AS p FROM refs GROUP BY 1, 2) GROUP BY 1"),
    "fixed_chunk": f"WITH {_BLOCKS} SELECT doc_id, idx, chunk_hash, size FROM b",
    "line_chunk": "SELECT doc_id, i - 1 AS idx, sha256(l[i]) AS chunk_hash FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), unnest(range(1, len(l) + 1)) t(i)",
    "reassemble": "SELECT doc_id, strlen(text) AS size, sha256(text) AS content_hash FROM documents WHERE length(text) > 0",
    "verify_objects": f"SELECT file_id, sha256(data) = {NH('hash')} AS intact FROM object_files WHERE data IS NOT NULL",
    "table_counts": "SELECT (SELECT count(*) FROM commits) AS commits, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM manifest_entries) AS entries",
}
