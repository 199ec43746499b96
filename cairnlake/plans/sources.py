"""Queries that write the files of a repository to the shared folder, read them again, and change trees."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cairnlake.functions.keys import norm_hash
from cairnlake.operators import mutate as M
from cairnlake.plans import relations as R
from cairnlake.plans.problems import norm_hash_sql as NH
from cairnlake.plans.relations import sql
from cairnlake.plans.trees import _M3, _all, _win
from cairnlake.session import shared_dir
from cairnlake.sources import files as S
from cairnlake.sources.tables import table

_AT = "2001-08-02"


def _place(s, name):
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


def _audit_files(s, d):
    """Audit events as JSON lines, among lines that are none."""
    at = _place(s, "audit")
    R.audit_events(s, d).withColumn("ts", F.col("ts").cast("timestamp_ntz")).select(F.to_json(F.struct(*[c.split()[0] for c in S.AUDIT_SCHEMA.split(", ")]), S.WRITE_OPTIONS)).write.text(f"{at}/good")
    s.createDataFrame([("{\"id\": 1, \"ts\"",), ("not json",)], "value string").write.text(f"{at}/bad")
    return S.read_json_lines(s, at, S.AUDIT_SCHEMA)


def _audit_sink(s, d):
    """The log after two appends, half of the events each, that keeps 1,000."""
    at, e = _place(s, "audit-log"), R.audit_events(s, d)
    S.append_audit(e.where("id % 2 = 0"), at, 1000)
    S.append_audit(e.where("id % 2 = 1"), at, 1000)
    return S.audit_log(s, at)[1].select("id")


def _access_files(s, d):
    """Access records in JSON arrays of some hundred, each record once before with another size."""
    at, r = _place(s, "access"), R.access_records(s, d)
    each = r.select(F.col("hash").cast("string").alias("hash"), *[c for c in r.columns if c != "hash"])
    both = F.array(F.struct(F.lit(0).alias("k"), "hash", F.lit(-1).cast("long").alias("size"), *[c for c in each.columns if c not in ("hash", "size")]), F.struct(F.lit(1).alias("k"), *each.columns))
    n = max(1, each.count() // 500)
    rows = each.select(F.pmod(F.xxhash64("hash"), F.lit(n)).alias("part"), F.explode(both).alias("r"))
    rows.groupBy("part").agg(F.array_sort(F.collect_list("r")).alias("rs")).select(F.to_json("rs", S.WRITE_OPTIONS).alias("value")).repartitionByRange(n, "value").write.text(at)
    s.createDataFrame([("[{\"hash\": ",)], "value string").write.mode("append").text(at)
    return S.read_access(s, at)


def _lock_files(s, d):
    at, o = _place(s, "locks"), table(s, d, "orders")
    locks = o.groupBy("o_custkey").agg(F.max("o_orderdate").alias("t"), F.max_by("o_orderpriority", "o_orderkey").alias("owner"))
    entry = F.struct(F.col("o_custkey").cast("string").alias("key"), F.struct("owner", F.col("t").alias("acquired_at"), (F.col("t") + F.expr("INTERVAL 8 HOURS")).alias("expires_at"), F.lit(None).cast("string").alias("reason")).alias("value"))
    n = max(1, locks.count() // 500)
    parts = locks.groupBy(F.pmod(F.xxhash64("o_custkey"), F.lit(n)).alias("part")).agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    parts.select(F.to_json("m", S.WRITE_OPTIONS).alias("value")).repartitionByRange(n, "value").write.text(at)
    return S.read_locks(s, at).select("path", "owner", "expires_at")


def _stored_twice(s, d):
    """Which chunks were new when all of them came after those every client knows and those of one category."""
    at, c = _place(s, "store"), table(s, d, "chunks")
    S.put_if_absent(table(s, d, "builtin_chunks").select("hash", "data").unionByName(c.where("category = 'text'").select("hash", "data")), at)
    return S.put_if_absent(c.select("hash", "data"), at)


def _seeded(s, d):
    records = R.access_records(s, d).select(F.col("hash").cast("string").alias("hash"), "size", "tier", "created_at", "last_accessed", "access_count", "is_proxy", "is_manifest")
    return S.new_access_records(R.stored_chunks(s, d), records, F.lit(_AT).cast("timestamp_ntz")).select("hash", "size", "tier", "access_count")


def _refs(s, d):
    """The newest snapshot of each branch."""
    return R.snapshots(s, d).where("back = 1").select(F.concat_ws("/", "repo", "branch").alias("name"), F.col("manifest").alias("hash"))


def _ref_changes(s, d):
    """Branches move back by one snapshot, those with one only are deleted; new ones are made, as is one that is there."""
    snaps, name = R.snapshots(s, d), F.concat_ws("/", "repo", "branch").alias("name")
    moved = snaps.where("back = 2").select(name, F.lit("move").alias("action"), F.col("manifest").alias("hash"))
    made = snaps.where("back = 1").select(F.concat_ws("/", "repo", "branch", F.lit("copy")).alias("name"), F.lit("create").alias("action"), F.col("manifest").alias("hash"))
    gone = snaps.where("back = 1 and nth = 1").select(name, F.lit("delete").alias("action"), F.lit(None).cast("string").alias("hash"))
    return moved.unionByName(made).unionByName(gone).unionByName(gone.select(F.concat("name", F.lit("?")).alias("name"), "action", "hash"))


def _wav(tree):
    return tree.where(F.col("path").endswith(".wav"))


QUERIES = {
    "scan_audit_jsonl": _audit_files,
    "sink_audit": _audit_sink,
    "scan_access_db": lambda s, d: _access_files(s, d).select("hash", "size", "tier", "created_at", "last_accessed", "access_count", "is_proxy", "is_manifest"),
    "scan_locks": _lock_files,
    "sink_chunk": _stored_twice,
    "scan_refs": lambda s, d: _refs(s, d).orderBy("name"),
    "damaged_objects": lambda s, d: S.damaged(table(s, d, "object_files").where("data is not null").select(norm_hash(F.col("hash")).alias("hash"), "data")),
    "init_access_from_objects": _seeded,
    "update_refs": lambda s, d: M.update_refs(_refs(s, d), _ref_changes(s, d)),
    "commit_tree": _all(2, lambda o, n: M.commit_tree(o, M.stage(n, o))),
    "checkout_plan": _all(3, lambda b, o, t: M.checkout(b, o, t)),
    "reset_hard": _all(3, lambda b, o, t: M.reset("hard", b, o, t)["work"]),
    "reset_mixed": _all(3, lambda b, o, t: M.reset("mixed", b, o, t)["index"]),
    "restore": _all(2, lambda o, n: M.restore(n, o, _wav(o))),
    "stash": _all(2, M.stash),
    "stash_apply": _all(3, lambda b, o, t: M.stash_apply(M.stash(b, o), t)),
    "cherry_pick_tree": _all(3, lambda b, o, t: M.replay(b, o, t)),
}

_LK = "lk AS (SELECT o_custkey, max_by(o_orderpriority, o_orderkey) AS owner, max(o_orderdate) AS t FROM orders GROUP BY 1)"
_SWAP = _M3.replace("FROM base b FULL JOIN ours o USING (repo, branch, path) FULL JOIN theirs t", "FROM base b FULL JOIN theirs o USING (repo, branch, path) FULL JOIN ours t")
_EQ = "({0}.manifest IS NULL) = ({1}.manifest IS NULL) AND {0}.content_hash IS NOT DISTINCT FROM {1}.content_hash"
_STASH = "SELECT repo, branch, path, h.content_hash AS base_hash, w.content_hash AS content_hash, CASE WHEN h.manifest IS NULL THEN 'A' WHEN w.manifest IS NULL THEN 'D' WHEN h.content_hash IS DISTINCT FROM w.content_hash THEN 'M' END AS kind FROM base h FULL JOIN ours w USING (repo, branch, path)"

SQL = {
    "scan_audit_jsonl": sql("ev", "SELECT id, ts, event_type, outcome, resource, user_id, value FROM ev"),
    "sink_audit": sql("ev", "SELECT id FROM (SELECT * FROM (SELECT id, ts FROM ev WHERE id % 2 = 1 UNION ALL SELECT * FROM (SELECT id, ts FROM ev WHERE id % 2 = 0 ORDER BY ts DESC, id DESC LIMIT 1000)) ORDER BY ts DESC, id DESC LIMIT 1000)"),
    "scan_access_db": sql("acc", "SELECT hash::VARCHAR AS hash, size, tier, created_at, last_accessed, access_count, is_proxy, is_manifest FROM acc"),
    "scan_locks": f"WITH {_LK} SELECT o_custkey::VARCHAR AS path, owner, t + INTERVAL 8 HOURS AS expires_at FROM lk",
    "sink_chunk": f"SELECT h AS hash, h NOT IN (SELECT {NH('hash')} FROM builtin_chunks UNION SELECT {NH('hash')} FROM chunks WHERE category = 'text') AS was_new FROM (SELECT DISTINCT {NH('hash')} AS h FROM chunks) WHERE h IS NOT NULL",
    "scan_refs": sql("snaps", "SELECT concat_ws('/', repo, branch) AS name, manifest AS hash FROM snaps WHERE back = 1"),
    "damaged_objects": f"SELECT DISTINCT h AS hash FROM (SELECT {NH('hash')} AS h, data FROM object_files WHERE data IS NOT NULL) WHERE sha256(data) != h",
    "init_access_from_objects": sql("stored acc", "SELECT hash::VARCHAR AS hash, size, tier, access_count FROM acc UNION ALL SELECT hash, size, 'hot', 1 FROM stored"),
    "update_refs": sql("snaps", "SELECT concat_ws('/', s.repo, s.branch) AS name, CASE WHEN p.manifest IS NOT NULL THEN p.manifest END AS hash, CASE WHEN p.manifest IS NOT NULL THEN 'moved' ELSE 'deleted' END AS outcome FROM snaps s LEFT JOIN snaps p ON p.repo = s.repo AND p.branch = s.branch AND p.back = 2 WHERE s.back = 1 UNION ALL SELECT concat_ws('/', repo, branch, 'copy'), manifest, 'created' FROM snaps WHERE back = 1 UNION ALL SELECT concat_ws('/', repo, branch) || '?', NULL, 'refused' FROM snaps WHERE back = 1 AND nth = 1"),
    "commit_tree": _win(2, "SELECT repo, branch, path, content_hash FROM ours"),
    "checkout_plan": _win(3, f"SELECT repo, branch, path, action FROM (SELECT repo, branch, path, CASE WHEN {_EQ.format('o', 'n')} OR {_EQ.format('w', 'n')} THEN NULL WHEN NOT ({_EQ.format('w', 'o')}) THEN 'conflict' WHEN n.manifest IS NOT NULL THEN 'write' ELSE 'delete' END AS action FROM base o FULL JOIN ours n USING (repo, branch, path) FULL JOIN theirs w USING (repo, branch, path)) WHERE action IS NOT NULL"),
    "reset_hard": _win(3, "SELECT repo, branch, path, content_hash FROM base UNION ALL SELECT repo, branch, path, content_hash FROM theirs t WHERE NOT EXISTS (FROM base b WHERE (b.repo, b.branch, b.path) = (t.repo, t.branch, t.path)) AND NOT EXISTS (FROM ours b WHERE (b.repo, b.branch, b.path) = (t.repo, t.branch, t.path))"),
    "reset_mixed": _win(3, "SELECT repo, branch, path, content_hash FROM base"),
    "restore": _win(2, "SELECT repo, branch, path, content_hash FROM base WHERE path LIKE '%.wav' UNION ALL SELECT repo, branch, path, content_hash FROM ours o WHERE NOT EXISTS (FROM base b WHERE (b.repo, b.branch, b.path) = (o.repo, o.branch, o.path) AND b.path LIKE '%.wav')"),
    "stash": _win(2, f"SELECT * FROM ({_STASH}) WHERE kind IS NOT NULL"),
    "stash_apply": _win(3, f"SELECT repo, branch, path, outcome, CASE outcome WHEN 'applied' THEN nh WHEN 'kept' THEN wh END AS content_hash FROM (SELECT repo, branch, path, e.content_hash AS nh, t.content_hash AS wh, CASE WHEN e.kind IS NULL THEN 'kept' WHEN e.kind = 'D' THEN CASE WHEN t.manifest IS NULL OR t.content_hash IS NOT DISTINCT FROM e.base_hash THEN 'deleted' ELSE 'conflict' END WHEN t.manifest IS NOT NULL AND t.content_hash IS NOT DISTINCT FROM e.content_hash THEN 'applied' WHEN e.kind = 'A' AND t.manifest IS NULL THEN 'applied' WHEN e.kind = 'M' AND t.manifest IS NOT NULL AND t.content_hash IS NOT DISTINCT FROM e.base_hash THEN 'applied' ELSE 'conflict' END AS outcome FROM (SELECT * FROM ({_STASH}) WHERE kind IS NOT NULL) e FULL JOIN theirs t USING (repo, branch, path))"),
    "cherry_pick_tree": _win(3, f"SELECT repo, branch, path, content_hash FROM ({_SWAP}) WHERE outcome IN ('ours', 'theirs', 'same', 'unchanged')"),
}
