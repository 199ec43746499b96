"""Queries on scalar functions, search, chunkers, media metadata and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlake.operators import chunkers as C
from cairnlake.functions import scalars as S
from cairnlake.plans import relations as R
from cairnlake.plans.problems import norm_hash_sql as NH
from cairnlake.plans.relations import sql
from cairnlake.sources.tables import table
from cairnlake.streaming import twins as W


def _chunker(name):
    return lambda s, d: C.chunked(table(s, d, "chunks").select(F.concat_ws(":", "hash", F.col("created_at").cast("string")).alias("key"), "data"), "key", "data", C.REGISTRY[name])


def _fixed(s, d):
    return C.chunked(table(s, d, "object_files"), "file_id", "data", C.fixed(256)).select("file_id", "idx", "start", "size", "hash")


def _events(s, d):
    return W.stream(s, f"{d}/events.parquet*", table(s, d, "events"))


def _proxies(s, d):
    p = table(s, d, "part")
    return p.select((F.col("p_partkey") % 500).alias("parent"), F.element_at(F.array(*[F.lit(v) for v in ("1080p", "720p", "540p", "half", "quarter")]), (F.col("p_size") % 5 + 1).cast("int")).alias("variant"), F.floor("p_retailprice").cast("long").alias("size"), F.col("p_partkey").alias("id"))


def _rank():
    return S.choose(F.col("variant"), {"1080p": "1", "720p": "2", "540p": "3", "half": "4", "quarter": "5"})


def _picked(s, d):
    return _proxies(s, d).groupBy("parent").agg(F.min_by(F.struct("variant", "size"), F.struct(_rank(), "id")).alias("v")).select("parent", "v.variant", "v.size")


def _paths(s, d):
    return R.head_entries(s, d).select("path").distinct()


def _mp4(s, d):
    return table(s, d, "mp4_metadata").distinct()


QUERIES = {
    "fn_paths": lambda s, d: _paths(s, d).select("path", S.extension(F.col("path")).alias("ext"), S.stem(F.col("path")).alias("stem"), S.parent(F.col("path")).alias("parent")),
    "fn_classify": lambda s, d: _paths(s, d).select("path", S.file_kind(F.col("path")).alias("kind"), S.file_kind(F.col("path")).isin(*S.LOCKED).alias("needs_lock"), S.file_kind(F.col("path")).isin(*S.MERGEABLE).alias("mergeable")),
    "fn_storage": lambda s, d: R.files(s, d).select("doc_id", S.storage_of(F.col("path"), F.col("text")).alias("storage")),
    "fn_hash": lambda s, d: R.stored_chunks(s, d).select("hash", S.short_hash(F.col("hash")).alias("short"), S.fan_out(F.col("hash")).alias("object_path")),
    "fn_format_bytes": lambda s, d: table(s, d, "lineitem").select(F.floor(F.col("l_extendedprice") * F.col("l_orderkey")).cast("long").alias("n")).distinct().select("n", S.format_bytes(F.col("n")).alias("text")),
    "fn_parse_bytes": lambda s, d: table(s, d, "part").select(F.concat(F.col("p_size").cast("string"), F.lit(".5"), F.element_at(F.array(*[F.lit(u) for u in ("", "KB", " mb", "GiB")]), (F.col("p_partkey") % 4 + 1).cast("int"))).alias("text")).distinct().select("text", S.parse_bytes(F.col("text")).alias("n")),
    "fn_percentage": lambda s, d: table(s, d, "orders").select("o_orderkey", F.round(S.percentage(F.col("o_custkey"), F.col("o_orderkey")), 6).alias("pct"), S.eta_seconds(F.col("o_orderkey"), F.col("o_custkey")).alias("eta")),
    "fn_days": lambda s, d: table(s, d, "orders").select("o_orderkey", F.date_diff(F.lit("2001-08-02").cast("date"), F.to_date("o_orderdate")).alias("days"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso")),
    "fn_expiry": lambda s, d: table(s, d, "events").select("event_id", S.remaining(F.col("ts"), F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")).alias("left")),
    "fn_version_sort": lambda s, d: table(s, d, "part").select(F.concat(F.lit("v"), F.col("p_size") % 7, F.lit("."), F.col("p_partkey") % 13).alias("tag")).distinct().select("tag", F.array_join(F.transform(S.version_key(F.col("tag")), lambda x: F.lpad(x.cast("string"), 4, "0")), ".").alias("key")).orderBy("key", "tag"),
    "fn_remote": lambda s, d: table(s, d, "supplier").select("s_suppkey", S.remote_kind(F.concat(F.element_at(F.array(*[F.lit(u) for u in ("https://", "ssh://", "git@host:", "/srv/")]), (F.col("s_suppkey") % 4 + 1).cast("int")), "s_name")).alias("kind")),
    "fn_revision": lambda s, d: table(s, d, "supplier").select("s_suppkey", S.revision(F.concat(F.lit("main"), F.element_at(F.array(*[F.lit(u) for u in ("", "~", "^", "~12")]), (F.col("s_suppkey") % 4 + 1).cast("int")))).alias("r")).select("s_suppkey", "r.base", "r.steps"),
    "fn_mode": lambda s, d: table(s, d, "manifest_entries").select("mode", S.mode_bits(F.col("mode")).alias("bits")).distinct(),
    "fn_chunk_size": lambda s, d: table(s, d, "events").select("event_id", S.chunk_size_for(F.col("value") * 10, F.col("user_id")).alias("mean")).select("event_id", "mean", S.chunk_bounds(F.col("mean")).alias("b")).select("event_id", "mean", "b.*"),
    "fn_mime": lambda s, d: _paths(s, d).select("path", S.mime_type(F.col("path")).alias("mime")).select("path", "mime", S.content_type(F.col("mime")).alias("content_type")),
    "fn_bloom": lambda s, d: table(s, d, "orders").select("o_orderkey", S.bloom_parameters(F.col("o_orderkey") + 1, 0.01).alias("b")).select("o_orderkey", "b.bytes", "b.hashes"),
    "fn_offset_patch": lambda s, d: _mp4(s, d).select("mp4_id", F.array_join(S.shifted_offsets(F.transform("stco_offsets", lambda o: o["table_pos"]), F.col("moov_size")), ",").alias("moved")),
    "mp4_atoms": lambda s, d: _mp4(s, d).select(F.explode("atom_order").alias("atom")).groupBy("atom").agg(F.count(F.lit(1)).alias("n")),
    "mp4_layout": lambda s, d: _mp4(s, d).select("mp4_id", (F.array_position("atom_order", "moov") < F.array_position("atom_order", "mdat")).alias("fast_start"), F.aggregate("stco_offsets", F.lit(0), lambda a, o: a + o["n_samples"]).alias("samples")),
    "meta_lookup": lambda s, d: table(s, d, "manifest_entries").select("entry_id", "storage").distinct().join(_mp4(s, d).select("entry_id", "mp4_id"), "entry_id").groupBy("storage").agg(F.count(F.lit(1)).alias("n")),
    "meta_scan_todo": lambda s, d: table(s, d, "manifest_entries").where(F.lower("path").rlike(r"\.(mp4|mov|m4v)$")).select("entry_id").distinct().join(_mp4(s, d), "entry_id", "left_anti"),
    "grep_tracked": lambda s, d: R.files(s, d).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).where(F.col("line").rlike(r"(?i)\bproxy\b")).select("doc_id", "line_no"),
    "grep_count": lambda s, d: R.files(s, d).select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).where(F.contains("line", F.lit("Branch off"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")),
    "search_fts": lambda s, d: R.commits(s, d).select("hash", S.term_score(["proxy", "relink", "conform"], F.col("message"), F.col("repo")).alias("score")).where("score > 0").distinct(),
    "proxy_stats": lambda s, d: _proxies(s, d).groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")),
    "proxy_for_file": _picked,
    "proxy_savings": lambda s, d: _picked(s, d).agg(F.count(F.lit(1)).alias("files"), F.sum(F.greatest(F.lit(2000) - F.col("size"), F.lit(0))).alias("saved")),
    "chunk_fixed_bytes": _fixed,
    "chunk_normalized": _chunker("normalized"),
    "chunk_sizes": lambda s, d: C.chunked(table(s, d, "object_files"), "file_id", "data", C.preset("small")).groupBy("file_id").agg(F.sum("size").alias("n_bytes"), F.max("size").alias("largest")).select("file_id", "n_bytes", (F.col("largest") <= 16384).alias("fits")),
    "chunk_preset": lambda s, d: R.head_entries(s, d).select("repo", "branch", "path", C.preset_for_size(F.col("size")).alias("by_size"), C.preset_for_kind(S.file_kind(F.col("path"))).alias("by_kind")),
    "chunk_gear": _chunker("gear"),
    "chunk_rolling": _chunker("rolling"),
    "chunk_keyed": _chunker("keyed"),
    "chunk_local_maximum": _chunker("local_maximum"),
    "stream_hourly": lambda s, d: W.drained(W.windowed_counts(_events(s, d), "1 hour"), "complete"),
    "stream_access_state": lambda s, d: W.drained(W.access_state(_events(s, d)), "complete"),
    "stream_first_by_key": lambda s, d: W.drained(W.first_by_key(_events(s, d).select("ts", "user_id"), "user_id").select("user_id"), "append"),
}

_EXT = "lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1))"
# Written out for the extensions in the tables, not taken from the functions under test.
_KIND = f"CASE WHEN {_EXT} IN ('mov', 'mp4', 'mxf', 'exr') THEN 'video' WHEN {_EXT} = 'wav' THEN 'audio' WHEN {_EXT} = 'png' THEN 'image' WHEN {_EXT} IN ('prproj', 'aep', 'drp', 'xml') THEN 'project' WHEN {_EXT} IN ('txt', 'md', 'json') THEN 'text' ELSE 'binary' END"
_MIME = f"CASE {_EXT} WHEN 'mov' THEN 'video/quicktime' WHEN 'mp4' THEN 'video/mp4' WHEN 'mxf' THEN 'application/mxf' WHEN 'wav' THEN 'audio/wav' WHEN 'png' THEN 'image/png' WHEN 'prproj' THEN 'application/x-premiere-project' WHEN 'aep' THEN 'application/x-aftereffects-project' WHEN 'drp' THEN 'application/x-davinci-resolve-project' WHEN 'xml' THEN 'application/xml' WHEN 'txt' THEN 'text/plain' WHEN 'md' THEN 'text/markdown' WHEN 'json' THEN 'application/json' ELSE 'application/octet-stream' END"
_H = "entries snaps head"
_PX = "px AS (SELECT p_partkey % 500 AS parent, ['1080p', '720p', '540p', 'half', 'quarter'][p_size % 5 + 1] AS variant, floor(p_retailprice)::BIGINT AS size, p_partkey AS id FROM part), pk AS (SELECT * FROM px QUALIFY row_number() OVER (PARTITION BY parent ORDER BY list_position(['1080p', '720p', '540p', 'half', 'quarter'], variant), id) = 1)"
_M = "m AS (SELECT DISTINCT * FROM mp4_metadata)"

SQL = {
    "fn_paths": sql(_H, f"SELECT DISTINCT path, {_EXT} AS ext, regexp_replace(split_part(path, '/', -1), '(.)\\.[^.]*$', '\\1') AS stem, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent FROM head"),
    "fn_classify": sql(_H, f"SELECT *, kind = 'project' AS needs_lock, kind IN ('text', 'project') AS mergeable FROM (SELECT DISTINCT path, {_KIND} AS kind FROM head)"),
    "fn_mime": sql(_H, f"SELECT *, CASE WHEN mime LIKE 'video/%' THEN 'video' WHEN mime LIKE 'audio/%' THEN 'audio' WHEN mime LIKE 'image/%' THEN 'photo' WHEN mime LIKE 'text/%' THEN 'text' WHEN mime LIKE '%project%' THEN 'project' ELSE 'file' END AS content_type FROM (SELECT DISTINCT path, {_MIME} AS mime FROM head)"),
    "fn_storage": sql("files", f"SELECT doc_id, CASE WHEN {_EXT} IN ('txt', 'md', 'json') THEN 'text' WHEN text IS NULL THEN 'binary' WHEN text = '' THEN 'text' WHEN contains(left(text, 8192), chr(0)) THEN 'binary' WHEN (strlen(text) - len(regexp_extract_all(text, '\\r?\\n')) - len(regexp_extract_all(text, '\\r\\n'))) // greatest(len(string_split(text, chr(10))) - (right(text, 1) = chr(10))::INT, 1) < 500 THEN 'text' ELSE 'binary' END AS storage FROM files"),
    "fn_hash": sql("stored", "SELECT hash, substr(hash, 1, 8) AS short, substr(hash, 1, 2) || '/' || substr(hash, 3) AS object_path FROM stored"),
    "fn_format_bytes": "SELECT n, CASE WHEN n >= 1099511627776 THEN format('{:.2f} TB', n / 1099511627776.0::DOUBLE) WHEN n >= 1073741824 THEN format('{:.2f} GB', n / 1073741824.0::DOUBLE) WHEN n >= 1048576 THEN format('{:.2f} MB', n / 1048576.0::DOUBLE) WHEN n >= 1024 THEN format('{:.2f} KB', n / 1024.0::DOUBLE) ELSE n || ' B' END AS text FROM (SELECT DISTINCT floor(l_extendedprice * l_orderkey)::BIGINT AS n FROM lineitem)",
    "fn_parse_bytes": "SELECT text, floor(regexp_extract(text, '^[0-9.]+')::DOUBLE * CASE WHEN text ILIKE '%k%' THEN 1024 WHEN text ILIKE '%m%' THEN 1048576 WHEN text ILIKE '%g%' THEN 1073741824 ELSE 1 END)::BIGINT AS n FROM (SELECT DISTINCT p_size || '.5' || ['', 'KB', ' mb', 'GiB'][p_partkey % 4 + 1] AS text FROM part)",
    "fn_percentage": "SELECT o_orderkey, round(coalesce(o_custkey * 100.0::DOUBLE / nullif(o_orderkey, 0), 100.0), 6) AS pct, floor(o_orderkey / nullif(o_custkey, 0))::BIGINT AS eta FROM orders",
    "fn_days": "SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '2001-08-02') AS days, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM orders",
    "fn_expiry": "SELECT event_id, CASE WHEN s <= 0 THEN 'expired' WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' WHEN s >= 60 THEN (s % 3600 // 60) || 'm' ELSE s || 's' END AS left FROM (SELECT event_id, floor(epoch(ts))::BIGINT - epoch(TIMESTAMP '2024-01-15 12:00:00')::BIGINT AS s FROM events)".replace("AS left", 'AS "left"'),
    "fn_version_sort": "SELECT DISTINCT 'v' || (p_size % 7) || '.' || (p_partkey % 13) AS tag, lpad((p_size % 7)::VARCHAR, 4, '0') || '.' || lpad((p_partkey % 13)::VARCHAR, 4, '0') AS key FROM part",
    "fn_remote": "SELECT s_suppkey, ['http', 'ssh', 'ssh', 'local'][s_suppkey % 4 + 1] AS kind FROM supplier",
    "fn_revision": "SELECT s_suppkey, 'main' AS base, [0, 1, 1, 12][s_suppkey % 4 + 1] AS steps FROM supplier",
    "fn_mode": "SELECT DISTINCT mode, CASE mode WHEN 'regular' THEN '644' WHEN 'executable' THEN '755' WHEN 'symlink' THEN '777' END AS bits FROM manifest_entries",
    "fn_chunk_size": "SELECT event_id, mean, greatest(mean // 4, 65536) AS least, least(mean * 4, 33554432) AS most FROM (SELECT event_id, CASE WHEN value * 10 > 1000 THEN 8388608 WHEN value * 10 > 100 THEN 2097152 WHEN user_id < 50 THEN 1048576 ELSE 262144 END AS mean FROM events)",
    "fn_bloom": "SELECT o_orderkey, bytes, greatest(1, least(16, round(bytes * 8 / (o_orderkey + 1)::DOUBLE * ln(2))))::INTEGER AS hashes FROM (SELECT o_orderkey, ceil(ceil((o_orderkey + 1) * (-ln(0.01) / (ln(2) * ln(2)))) / 8)::BIGINT AS bytes FROM orders)",
    "fn_offset_patch": f"WITH {_M} SELECT mp4_id, array_to_string(list_transform(stco_offsets, lambda o: o.table_pos + moov_size), ',') AS moved FROM m",
    "mp4_atoms": f"WITH {_M} SELECT atom, count(*) AS n FROM (SELECT unnest(atom_order) AS atom FROM m) GROUP BY 1",
    "mp4_layout": f"WITH {_M} SELECT mp4_id, coalesce(list_position(atom_order, 'moov'), 0) < coalesce(list_position(atom_order, 'mdat'), 0) AS fast_start, coalesce(list_sum(list_transform(stco_offsets, lambda o: o.n_samples)), CASE WHEN stco_offsets IS NOT NULL THEN 0 END)::INTEGER AS samples FROM m",
    "meta_lookup": f"WITH {_M} SELECT storage, count(*) AS n FROM (SELECT DISTINCT entry_id, storage FROM manifest_entries) JOIN m USING (entry_id) GROUP BY 1",
    "meta_scan_todo": "SELECT DISTINCT entry_id FROM manifest_entries WHERE regexp_matches(lower(path), '\\.(mp4|mov|m4v)$') AND entry_id NOT IN (SELECT entry_id FROM mp4_metadata WHERE entry_id IS NOT NULL)",
    "grep_tracked": "SELECT doc_id, i - 1 AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) t(i) WHERE regexp_matches(l[i], '(?i)\\bproxy\\b')",
    "grep_count": "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE contains(line, 'Branch off') GROUP BY 1",
    "search_fts": sql("cm", "SELECT DISTINCT hash, score FROM (SELECT hash, 2 * coalesce(len(list_filter(regexp_split_to_array(lower(message), '[^a-z0-9]+'), lambda w: w IN ('proxy', 'relink', 'conform'))), 0) + coalesce(len(list_filter(regexp_split_to_array(lower(repo), '[^a-z0-9]+'), lambda w: w IN ('proxy', 'relink', 'conform'))), 0) AS score FROM cm) WHERE score > 0"),
    "proxy_stats": f"WITH {_PX} SELECT variant, count(*) AS n, sum(size)::BIGINT AS bytes FROM px GROUP BY 1",
    "proxy_for_file": f"WITH {_PX} SELECT parent, variant, size FROM pk",
    "proxy_savings": f"WITH {_PX} SELECT count(*) AS files, sum(greatest(2000 - size, 0))::BIGINT AS saved FROM pk",
    "chunk_fixed_bytes": "SELECT file_id, i AS idx, i * 256 AS start, least(256, n - i * 256) AS size, sha256(unhex(substr(hex(data), i * 512 + 1, 512))) AS hash FROM (SELECT file_id, data, octet_length(data) AS n FROM object_files WHERE octet_length(data) > 0), unnest(range(0, (n + 255) // 256)) t(i)",
    "chunk_sizes": "SELECT file_id, octet_length(data) AS n_bytes, true AS fits FROM object_files WHERE octet_length(data) > 0",
    "chunk_preset": sql(_H, f"SELECT repo, branch, path, CASE WHEN size <= 65536 THEN 'project' WHEN size <= 10485760 THEN 'default' WHEN size IS NOT NULL THEN 'media' END AS by_size, CASE WHEN {_KIND} IN ('video', 'audio', 'image') THEN 'media' WHEN {_KIND} IN ('project', 'text') THEN 'project' ELSE 'default' END AS by_kind FROM head"),
    "stream_hourly": "SELECT date_trunc('hour', ts) AS bucket, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "stream_access_state": "SELECT user_id, min(ts) AS created_at, max(ts) AS last_accessed, count(*) AS access_count FROM events GROUP BY 1",
    "stream_first_by_key": "SELECT DISTINCT user_id FROM events",
}
