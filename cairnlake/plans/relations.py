"""The relations that the named queries read, and the SQL of the same relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnlake.functions.keys import norm_hash, norm_path
from cairnlake.plans.problems import norm_hash_sql, norm_path_sql
from cairnlake.session import broadcast_if_small
from cairnlake.sources.tables import table


def raw_entries(spark: SparkSession, root: str, of: DataFrame | None = None) -> DataFrame:
    """Rows of manifest entries with a path, only those of the snapshots ``of`` (manifest) if given: they are picked
    before anything is normalised or shuffled, by broadcast if they are few."""
    raw = table(spark, root, "manifest_entries").where("path is not null")
    return raw if of is None else raw.join(broadcast_if_small(of.select("manifest").distinct()), "manifest", "left_semi")


def entries(spark: SparkSession, root: str, of: DataFrame | None = None) -> DataFrame:
    """One row for each path of a snapshot: of several rows the one recorded last."""
    cols = ["repo", "mode", "file_type", "size", "content_hash", "chunks", "storage"]
    rows = raw_entries(spark, root, of).withColumns({"path": norm_path(F.col("path")), "content_hash": norm_hash(F.col("content_hash"))})
    last = rows.groupBy("manifest", "path").agg(F.max_by(F.struct(*cols), F.struct("recorded_at", "entry_id")).alias("row"))
    return last.select("manifest", "path", "row.*")


def snapshots(spark: SparkSession, root: str) -> DataFrame:
    """(manifest, repo, branch, seq, nth, back): snapshots numbered from the first and from the last of their branch."""
    one = table(spark, root, "manifests").where("manifest is not null and seq is not null").select("manifest", "repo", "branch", "seq", "taken_at").distinct()
    w = Window.partitionBy("repo", "branch")
    up, down = w.orderBy("seq", "taken_at", "manifest"), w.orderBy(F.desc("seq"), F.desc("taken_at"), F.desc("manifest"))
    return one.select("manifest", "repo", "branch", "seq", F.row_number().over(up).alias("nth"), F.row_number().over(down).alias("back"))


def head_entries(spark: SparkSession, root: str) -> DataFrame:
    """Entries of the last snapshot of each branch."""
    heads = snapshots(spark, root).where("back = 1").select("manifest", "branch")
    return entries(spark, root, heads).join(heads, "manifest")


def window_entries(spark: SparkSession, root: str, width: int) -> list[DataFrame]:
    """(repo, branch, path, mode, file_type, size, content_hash, chunks) of the first to last snapshot of every ``width``
    consecutive ones of a branch.

    ``branch`` is a struct of the branch and the last one's seq (and number), so that each window is a group of its own.
    """
    snaps = snapshots(spark, root)
    last = snaps.select("repo", "branch", F.col("nth").alias("at"), "seq")
    rows, out = entries(spark, root), []
    for k in range(width):
        here = snaps.where(F.col("nth") > k).select("manifest", "repo", "branch", (F.col("nth") - k + width - 1).alias("at"))
        here = here.join(last, ["repo", "branch", "at"]).select("manifest", F.struct("branch", "seq", "at").alias("branch"))
        out.append(rows.join(here, "manifest").select("repo", "branch", "path", "mode", "file_type", "size", "content_hash", "chunks"))
    return out


def chunk_refs(of: DataFrame, *keys: str) -> DataFrame:
    """(keys, path, idx, chunk_hash, byte_offset, size): the chunks that entries name, in order."""
    out = of.select(*keys, "path", F.posexplode("chunks").alias("idx", "c"))
    return out.select(*keys, "path", "idx", norm_hash(F.col("c.hash")).alias("chunk_hash"), F.col("c.byte_offset").alias("byte_offset"), F.col("c.size").alias("size"))


def stored_chunks(spark: SparkSession, root: str) -> DataFrame:
    """One row for each chunk hash: its latest row."""
    rows = table(spark, root, "chunks").where("hash is not null")
    cols = ["category", "size", "original_size", "compression", "tier", "ref_count", "created_at", "deleted_at"]
    return rows.groupBy(norm_hash(F.col("hash")).alias("hash")).agg(F.max(F.struct("created_at", "size", "tier", "ref_count", "category", "original_size", "compression", "deleted_at")).alias("row")).select("hash", *[F.col(f"row.{c}").alias(c) for c in cols])


def commits(spark: SparkSession, root: str) -> DataFrame:
    """Commits without copies."""
    rows = table(spark, root, "commits").select(norm_hash(F.col("hash")).alias("hash"), "repo", norm_hash(F.col("parent")).alias("parent"), F.transform("parents", norm_hash).alias("parents"), norm_hash(F.col("manifest")).alias("manifest"), "message", "author", "email", "ts")
    return rows.distinct()


def commit_links(spark: SparkSession, root: str, first_only: bool = False) -> DataFrame:
    """(child, parent): parents that are commits themselves; ``first_only``: the first of them, in the order named."""
    c = commits(spark, root)
    named = F.array_compact(F.concat(F.array("parent"), F.coalesce("parents", F.array().cast("array<string>"))))
    if first_only:
        links = c.select(F.col("hash").alias("child"), F.get(named, F.lit(0)).alias("parent")).where("parent is not null")
    else:
        links = c.select(F.col("hash").alias("child"), F.explode(named).alias("parent"))
    return links.join(c.select(F.col("hash").alias("parent")), "parent", "left_semi").select("child", "parent").distinct()


def files(spark: SparkSession, root: str) -> DataFrame:
    """Documents as files: (doc_id, path, size, content_hash, text)."""
    return table(spark, root, "documents").select("doc_id", F.concat_ws("/", "source", "path").alias("path"), F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("content_hash"), "text")


def access_records(spark: SparkSession, root: str) -> DataFrame:
    """(hash, size, tier, created_at, last_accessed, access_count, is_proxy, is_manifest), one for each customer's orders."""
    o, c = table(spark, root, "orders"), table(spark, root, "customer")
    each = o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("created_at"), F.max("o_orderdate").alias("last_accessed"), F.count(F.lit(1)).alias("access_count"), F.round(F.sum("o_totalprice")).cast("long").alias("size"))
    tier = F.element_at(F.array(*[F.lit(t) for t in ("hot", "warm", "cold", "archive")]), (F.col("o_custkey") % 4 + 1).cast("int"))
    return each.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_custkey").alias("hash"), "size", tier.alias("tier"), "created_at", "last_accessed", "access_count", (F.col("c_mktsegment") == "BUILDING").alias("is_proxy"), (F.col("c_mktsegment") == "MACHINERY").alias("is_manifest"))


def audit_events(spark: SparkSession, root: str) -> DataFrame:
    """(id, ts, event_type, outcome, resource, user_id, value)."""
    e = table(spark, root, "events")
    outcome = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "signup", "denied").otherwise("success")
    return e.select(F.col("event_id").alias("id"), "ts", "event_type", outcome.alias("outcome"), F.get_json_object("props", "$.k").alias("resource"), "user_id", "value")


def dependency_nodes(spark: SparkSession, root: str) -> DataFrame:
    """(node, is_project, is_tracked, exists_on_disk) from parts."""
    return table(spark, root, "part").select(F.col("p_partkey").alias("node"), (F.col("p_size") % 4 != 0).alias("is_project"), (F.col("p_size") % 3 != 0).alias("is_tracked"), (F.col("p_size") % 5 != 0).alias("exists_on_disk"))


def dependency_edges(spark: SparkSession, root: str) -> DataFrame:
    """(src, dst, edge_type): each part uses the parts (7p + 1) mod n and p div 2; the graph has cycles."""
    p = table(spark, root, "part")
    n = p.agg(F.count(F.lit(1)).alias("n"))
    both = p.crossJoin(n).select(F.col("p_partkey").alias("src"), F.explode(F.array(F.struct(((F.col("p_partkey") * 7 + 1) % F.col("n")).alias("dst"), F.lit("media").alias("edge_type")), F.struct(F.expr("p_partkey div 2").alias("dst"), F.lit("nested_project").alias("edge_type")))).alias("e"))  # one row beside each
    return both.select("src", "e.dst", "e.edge_type")


def segments(spark: SparkSession, root: str) -> DataFrame:
    """(video, idx, segment_id, duration): the events of a user in order, a duration in milliseconds each."""
    e = table(spark, root, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("video"), (F.row_number().over(w) - 1).alias("idx"), F.col("event_id").alias("segment_id"), F.floor(F.col("value") * 10).cast("long").alias("duration"))


_NP, _NH = norm_path_sql, norm_hash_sql

#: SQL of the relations above, as common table expressions.
CTE = {
    "entries": f"entries AS (SELECT manifest, {_NP('path')} AS path, repo, mode, file_type, size, {_NH('content_hash')} AS content_hash, chunks, storage FROM manifest_entries WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY manifest, {_NP('path')} ORDER BY recorded_at DESC, entry_id DESC) = 1)",
    "snaps": "snaps AS (SELECT *, row_number() OVER (PARTITION BY repo, branch ORDER BY seq, taken_at, manifest) AS nth, row_number() OVER (PARTITION BY repo, branch ORDER BY seq DESC, taken_at DESC, manifest DESC) AS back FROM (SELECT DISTINCT manifest, repo, branch, seq, taken_at FROM manifests WHERE manifest IS NOT NULL AND seq IS NOT NULL))",
    "head": "head AS (SELECT e.*, branch FROM entries e JOIN snaps USING (manifest) WHERE back = 1)",
    "refs": f"refs AS (SELECT h.repo, h.branch, h.manifest, h.path, i - 1 AS idx, {_NH('h.chunks[i].hash')} AS chunk_hash, h.chunks[i].byte_offset AS byte_offset, h.chunks[i].size AS size FROM head h, unnest(range(1, len(h.chunks) + 1)) t(i))",
    **{f"{name}{width}": f"{name} AS (SELECT e.*, {{'branch': s.branch, 'seq': l.seq, 'at': l.nth}} AS branch FROM entries e JOIN snaps s USING (manifest) JOIN snaps l ON l.repo = s.repo AND l.branch = s.branch AND l.nth = s.nth + {width - 1 - k} WHERE l.nth >= {width})" for width in (2, 3) for k, name in enumerate(("base", "ours", "theirs")[:width])},
    "theirs2": "theirs AS (SELECT * FROM ours)",
    "stored": f"stored AS (SELECT {_NH('hash')} AS hash, category, size, original_size, compression, tier, ref_count, created_at, deleted_at FROM chunks WHERE hash IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_NH('hash')} ORDER BY created_at DESC NULLS LAST, size DESC NULLS LAST, tier DESC NULLS LAST, ref_count DESC NULLS LAST, category DESC NULLS LAST, original_size DESC NULLS LAST, compression DESC NULLS LAST, deleted_at DESC NULLS LAST) = 1)",
    "cm": f"cm AS (SELECT DISTINCT {_NH('hash')} AS hash, repo, {_NH('parent')} AS parent, list_transform(parents, lambda x: {_NH('x')}) AS parents, {_NH('manifest')} AS manifest, message, author, email, ts FROM commits)",
    "links": "links AS (SELECT DISTINCT hash AS child, p AS parent FROM (SELECT hash, unnest([parent] || coalesce(parents, [])) AS p FROM cm) WHERE p IN (SELECT hash FROM cm))",
    "first": "first AS (SELECT DISTINCT hash AS child, p AS parent FROM (SELECT hash, list_filter([parent] || coalesce(parents, []), lambda x: x IS NOT NULL)[1] AS p FROM cm) WHERE p IN (SELECT hash FROM cm))",
    "files": "files AS (SELECT doc_id, concat_ws('/', source, path) AS path, strlen(text) AS size, sha256(text) AS content_hash, text FROM documents)",
    "acc": "acc AS (SELECT o_custkey AS hash, round(sum(o_totalprice))::BIGINT AS size, ['hot', 'warm', 'cold', 'archive'][o_custkey % 4 + 1] AS tier, min(o_orderdate) AS created_at, max(o_orderdate) AS last_accessed, count(*) AS access_count, any_value(c_mktsegment) = 'BUILDING' AS is_proxy, any_value(c_mktsegment) = 'MACHINERY' AS is_manifest FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey)",
    "ev": "ev AS (SELECT event_id AS id, ts, event_type, CASE event_type WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'denied' ELSE 'success' END AS outcome, json_extract_string(props, '$.k') AS resource, user_id, value FROM events)",
    "dn": "dn AS (SELECT p_partkey AS node, p_size % 4 != 0 AS is_project, p_size % 3 != 0 AS is_tracked, p_size % 5 != 0 AS exists_on_disk FROM part)",
    "de": "de AS (SELECT p_partkey AS src, (p_partkey * 7 + 1) % (SELECT count(*) FROM part) AS dst, 'media' AS edge_type FROM part UNION ALL SELECT p_partkey, p_partkey // 2, 'nested_project' FROM part)",
    "seg": "seg AS (SELECT user_id AS video, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, event_id AS segment_id, floor(value * 10)::BIGINT AS duration FROM events)",
}


def sql(names: str, body: str, recursive: bool = False) -> str:
    """A statement over the named relations (those they build on are named too), in order."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(CTE[n] for n in names.split()) + "\n" + body
