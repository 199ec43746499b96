"""Queries on snapshots as file trees: every two or three consecutive snapshots of a branch are base (HEAD), ours (index) and
theirs (work); ``seq`` in a result is that of the last."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlake.operators import trees as op
from cairnlake.plans import relations as R
from cairnlake.plans.problems import norm_hash_sql as _NH
from cairnlake.plans.relations import sql

IGNORE = ["*.wav", "proxies/", "!*001.wav", "day0?/**/*.json"]
SPARSE = ["camA/**", "*.srt", "notes/"]


def _lines(s, d, shift):
    docs = R.files(s, d).where("text is not null").select("doc_id", F.split("text", "\n", -1).alias("l"))
    line = F.when((F.col("idx") + F.col("key")) % 7 == shift, F.concat(F.lit(f"edit {shift}: "), "line")).otherwise(F.col("line")) if shift else F.col("line")
    return docs.select(F.col("doc_id").alias("key"), F.posexplode("l").alias("idx", "line")).select("key", "idx", line.alias("line"))


def _all(width, f):
    """``f`` over every ``width`` consecutive snapshots of each branch; seq is the last one's."""

    def query(s, d):
        out = f(*R.window_entries(s, d, width))
        return out.select("repo", F.col("branch.branch").alias("branch"), F.col("branch.seq").alias("seq"), *[c for c in out.columns if c not in op.GROUP])

    return query


def _wanted_paths(tree):
    """Every file, every folder of a file, and as many names that aren't there."""
    up = tree.where(F.col("path").contains("/")).select(*op.GROUP, F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("path"))
    return tree.select(*op.KEY).union(up).union(tree.select(*op.GROUP, F.concat("path", F.lit(".none")))).distinct()


def _keys(tree):
    return tree.select(*op.KEY)


def _outcomes(*trees):
    return op.three_way(*trees).groupBy("repo", "branch", "outcome").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "commit_diff": _all(2, op.tree_diff),
    "show_stat": _all(2, lambda o, n: op.change_counts(op.tree_diff(o, n))),
    "status_staged": _all(2, op.status_staged),
    "status_unstaged": _all(3, op.status_unstaged),
    "status_missing": _all(3, op.status_missing),
    "rename_detect": _all(2, op.renames),
    "copy_not_rename": _all(2, op.copies),
    "merge_conflicts": _all(3, lambda b, o, t: op.three_way(b, o, t).where(F.col("outcome").isin(*op.CONFLICTS)).select(*op.KEY, "outcome")),
    "merge_manifests": _all(3, lambda b, o, t: op.merged_tree(op.three_way(b, o, t))),
    "merge_outcomes": _all(3, _outcomes),
    "cherry_pick_plan": _all(3, op.cherry_pick),
    "rebase_delta": _all(2, lambda o, n: op.tree_diff(o, n).where("change <> 'D'")),
    "manifest_sync_diff": _all(2, lambda o, n: op.sync_diff(n, o)),
    "all_paths_union": _all(3, lambda b, o, t: _keys(b).union(_keys(o)).union(_keys(t)).distinct()),
    "paths_in_all": _all(3, lambda b, o, t: _keys(b).intersect(_keys(o)).intersect(_keys(t))),
    "clean_untracked": _all(2, lambda o, n: op.clean_list(n, o, IGNORE, ["vfx/**"])),
    "index_by_status": _all(2, lambda o, n: op.status_staged(o, n).where("status = 'modified'").select(*op.KEY)),
    "ignore_filter": lambda s, d: R.head_entries(s, d).where(~op.is_ignored(F.col("path"), IGNORE)).select(*op.KEY),
    "sparse_filter": lambda s, d: R.head_entries(s, d).where(op.matches_any(F.col("path"), SPARSE)).select(*op.KEY),
    "video_ext_filter": lambda s, d: R.head_entries(s, d).where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin("mp4", "mov", "mxf")).select(*op.KEY),
    "vfs_tree": lambda s, d: op.directories(R.head_entries(s, d)),
    "readdir": lambda s, d: op.children(R.head_entries(s, d)),
    "lookup": lambda s, d: op.lookup(_wanted_paths(R.head_entries(s, d)), R.head_entries(s, d)),
    "line_merge3": lambda s, d: op.merge_lines(_lines(s, d, 0), _lines(s, d, 1), _lines(s, d, 2)),
}



def _win(width: int, body: str) -> str:
    """``body`` over base, ours and theirs of every ``width`` consecutive snapshots (of two, theirs is ours)."""
    return sql(f"entries snaps base{width} ours{width} theirs{width}", f"SELECT repo, branch.branch AS branch, branch.seq AS seq, * EXCLUDE (repo, branch) FROM ({body})")


_D = "SELECT repo, branch, path, CASE WHEN o.in_x IS NULL THEN 'A' WHEN n.in_x IS NULL THEN 'D' WHEN o.content_hash IS DISTINCT FROM n.content_hash THEN 'M' END AS change FROM (SELECT *, true AS in_x FROM {0}) o FULL JOIN (SELECT *, true AS in_x FROM {1}) n USING (repo, branch, path)"
_STAGED = "SELECT * FROM (SELECT repo, branch, path, CASE WHEN h.manifest IS NULL THEN 'new' WHEN i.manifest IS NULL THEN 'deleted' WHEN h.content_hash IS DISTINCT FROM i.content_hash THEN 'modified' WHEN h.file_type IS DISTINCT FROM i.file_type THEN 'typechange' WHEN h.mode IS DISTINCT FROM i.mode THEN 'modechange' END AS status FROM base h FULL JOIN ours i USING (repo, branch, path)) WHERE status IS NOT NULL"
_M3 = """SELECT repo, branch, path, outcome, CASE WHEN outcome IN ('ours', 'same', 'unchanged') THEN oh WHEN outcome = 'theirs' THEN th END AS content_hash FROM (
SELECT repo, branch, path, o.content_hash AS oh, t.content_hash AS th, CASE
 WHEN b.manifest IS NULL THEN CASE WHEN t.manifest IS NULL THEN 'ours' WHEN o.manifest IS NULL THEN 'theirs' WHEN o.content_hash IS NOT DISTINCT FROM t.content_hash THEN 'same' ELSE 'both_added' END
 WHEN o.manifest IS NULL AND t.manifest IS NULL THEN 'deleted'
 WHEN o.manifest IS NULL THEN CASE WHEN b.content_hash IS NOT DISTINCT FROM t.content_hash THEN 'deleted' ELSE 'delete_modify' END
 WHEN t.manifest IS NULL THEN CASE WHEN b.content_hash IS NOT DISTINCT FROM o.content_hash THEN 'deleted' ELSE 'modify_delete' END
 WHEN o.content_hash IS NOT DISTINCT FROM t.content_hash THEN CASE WHEN b.content_hash IS NOT DISTINCT FROM o.content_hash THEN 'unchanged' ELSE 'same' END
 WHEN b.content_hash IS NOT DISTINCT FROM o.content_hash THEN 'theirs' WHEN b.content_hash IS NOT DISTINCT FROM t.content_hash THEN 'ours' ELSE 'both_modified' END AS outcome
FROM base b FULL JOIN ours o USING (repo, branch, path) FULL JOIN theirs t USING (repo, branch, path))"""
_GONE = "gone AS (SELECT * FROM base b WHERE content_hash IS NOT NULL AND NOT EXISTS (FROM theirs t WHERE (t.repo, t.branch, t.path) = (b.repo, b.branch, b.path)))"
_CAME = "came AS (SELECT * FROM theirs t WHERE content_hash IS NOT NULL AND NOT EXISTS (FROM base b WHERE (t.repo, t.branch, t.path) = (b.repo, b.branch, b.path)))"


def _any(patterns: list[str]) -> str:
    return "regexp_matches(path, '" + "|".join(f"(?:{op.glob_regex(p)})" for p in patterns).replace("'", "''") + "')"


def _ignored() -> str:
    out = "false"
    for p in IGNORE:
        keep = p.startswith("!")
        out = f"CASE WHEN {_any([p[1:] if keep else p])} THEN {str(not keep).lower()} ELSE {out} END"
    return f"(regexp_matches(path, '^\\.repo(/.*)?$') OR {out})"


_DOCL = "l{0} AS (SELECT doc_id AS key, i - 1 AS idx, {1} AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), unnest(range(1, len(l) + 1)) t(i))"

SQL = {
    "commit_diff": _win(2, f"SELECT * FROM ({_D.format('base', 'ours')}) WHERE change IS NOT NULL"),
    "show_stat": _win(2, f"SELECT repo, branch, count(*) AS files_changed, count(*) FILTER (change = 'A') AS additions, count(*) FILTER (change = 'M') AS modifications, count(*) FILTER (change = 'D') AS deletions FROM ({_D.format('base', 'ours')}) WHERE change IS NOT NULL GROUP BY 1, 2"),
    "status_staged": _win(2, _STAGED),
    "index_by_status": _win(2, f"SELECT repo, branch, path FROM ({_STAGED}) WHERE status = 'modified'"),
    "status_unstaged": _win(3, "SELECT * FROM (SELECT repo, branch, path, CASE WHEN t.repo IS NULL THEN 'untracked' WHEN t.content_hash IS DISTINCT FROM w.content_hash THEN 'modified' WHEN t.file_type IS DISTINCT FROM w.file_type THEN 'typechange' WHEN t.mode IS DISTINCT FROM w.mode THEN 'modechange' END AS status FROM theirs w LEFT JOIN (SELECT repo, branch, path, content_hash, file_type, mode FROM ours UNION ALL SELECT repo, branch, path, content_hash, file_type, mode FROM base b WHERE NOT EXISTS (FROM ours o WHERE (o.repo, o.branch, o.path) = (b.repo, b.branch, b.path))) t USING (repo, branch, path)) WHERE status IS NOT NULL"),
    "status_missing": _win(3, "SELECT repo, branch, path FROM base EXCEPT SELECT repo, branch, path FROM theirs EXCEPT SELECT repo, branch, path FROM ours"),
    "rename_detect": _win(2, f"SELECT * FROM (WITH {_GONE}, {_CAME}, g AS (SELECT *, row_number() OVER (PARTITION BY repo, branch, content_hash ORDER BY path) AS k FROM gone), c AS (SELECT *, row_number() OVER (PARTITION BY repo, branch, content_hash ORDER BY path) AS k FROM came) SELECT g.repo, g.branch, g.path AS old_path, c.path AS new_path FROM g JOIN c USING (repo, branch, content_hash, k))"),
    "copy_not_rename": _win(2, f"SELECT * FROM (WITH {_CAME} SELECT repo, branch, path FROM came c WHERE EXISTS (FROM base b JOIN theirs t USING (repo, branch, path) WHERE b.repo = c.repo AND b.branch = c.branch AND b.content_hash = c.content_hash))"),
    "merge_conflicts": _win(3, f"SELECT repo, branch, path, outcome FROM ({_M3}) WHERE outcome IN ('both_modified', 'both_added', 'modify_delete', 'delete_modify')"),
    "merge_manifests": _win(3, f"SELECT repo, branch, path, content_hash FROM ({_M3}) WHERE outcome IN ('ours', 'theirs', 'same', 'unchanged')"),
    "merge_outcomes": _win(3, f"SELECT repo, branch, outcome, count(*) AS n FROM ({_M3}) GROUP BY ALL"),
    "cherry_pick_plan": _win(3, f"SELECT repo, branch, path, CASE WHEN c.content_hash IS NOT DISTINCT FROM h.content_hash AND (c.manifest IS NULL) = (h.manifest IS NULL) THEN 'nothing' WHEN p.content_hash IS NOT DISTINCT FROM h.content_hash AND (p.manifest IS NULL) = (h.manifest IS NULL) THEN CASE WHEN change = 'D' THEN 'delete' ELSE 'apply' END ELSE 'conflict' END AS action FROM ({_D.format('base', 'ours')}) x LEFT JOIN base p USING (repo, branch, path) LEFT JOIN theirs h USING (repo, branch, path) LEFT JOIN ours c USING (repo, branch, path) WHERE change IS NOT NULL"),
    "rebase_delta": _win(2, f"SELECT repo, branch, path, change FROM ({_D.format('base', 'ours')}) WHERE change IN ('A', 'M')"),
    "manifest_sync_diff": _win(2, f"SELECT * FROM (WITH c AS (SELECT repo, branch, path, h, count(*) FILTER (l) AS nl, count(*) FILTER (NOT l) AS nr, coalesce(sum(size) FILTER (l), 0) AS bytes FROM (SELECT repo, branch, path, true AS l, {_NH('u.c.hash')} AS h, u.c.size AS size FROM ours, unnest(chunks) u(c) UNION ALL SELECT repo, branch, path, false, {_NH('u.c.hash')}, u.c.size FROM base, unnest(chunks) u(c)) WHERE h IS NOT NULL GROUP BY ALL), p AS (SELECT repo, branch, path, CASE WHEN b.manifest IS NULL THEN 'A' WHEN o.manifest IS NULL THEN 'D' ELSE 'M' END AS change FROM ours o FULL JOIN base b USING (repo, branch, path)) SELECT repo, branch, path, change, count(*) FILTER (nl > 0 AND nr = 0) AS n_new, count(*) FILTER (nl > 0 AND nr > 0) AS n_kept, count(*) FILTER (nl = 0 AND nr > 0) AS n_removed, coalesce(sum(bytes) FILTER (nr = 0), 0)::BIGINT AS transfer_bytes FROM p LEFT JOIN c USING (repo, branch, path) GROUP BY repo, branch, path, change)"),
    "all_paths_union": _win(3, "SELECT repo, branch, path FROM base UNION SELECT repo, branch, path FROM ours UNION SELECT repo, branch, path FROM theirs"),
    "paths_in_all": _win(3, "SELECT repo, branch, path FROM base INTERSECT SELECT repo, branch, path FROM ours INTERSECT SELECT repo, branch, path FROM theirs"),
    "ignore_filter": sql("entries snaps head", f"SELECT repo, branch, path FROM head WHERE NOT {_ignored()}"),
    "sparse_filter": sql("entries snaps head", f"SELECT repo, branch, path FROM head WHERE {_any(SPARSE)}"),
    "clean_untracked": _win(2, f"SELECT repo, branch, path FROM theirs t WHERE NOT EXISTS (FROM base b WHERE (b.repo, b.branch, b.path) = (t.repo, t.branch, t.path)) AND NOT {_ignored()} AND NOT {_any(['vfx/**'])}"),
    "video_ext_filter": sql("entries snaps head", "SELECT repo, branch, path FROM head WHERE lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('mp4', 'mov', 'mxf')"),
    "vfs_tree": sql("entries snaps head", "SELECT repo, branch, dir, count(*) AS n_files, coalesce(sum(size), 0)::BIGINT AS size, regexp_extract(dir, '^(.*)/[^/]*$', 1) AS parent FROM (SELECT repo, branch, size, array_to_string(p[1:i], '/') AS dir FROM (SELECT *, string_split(path, '/') AS p FROM head) h, unnest(range(1, len(h.p))) t(i)) GROUP BY repo, branch, dir"),
    "readdir": sql("entries snaps head", "SELECT DISTINCT repo, branch, array_to_string(p[1:i - 1], '/') AS dir, p[i] AS name, i < len(p) AS is_dir FROM (SELECT *, string_split(path, '/') AS p FROM head) h, unnest(range(1, len(h.p) + 1)) t(i)"),
    "lookup": sql("entries snaps head", "SELECT repo, branch, path, CASE WHEN EXISTS (FROM head h WHERE h.repo = q.repo AND h.branch = q.branch AND h.path = q.path) THEN 'file' WHEN EXISTS (FROM head h WHERE h.repo = q.repo AND h.branch = q.branch AND starts_with(h.path, q.path || '/')) THEN 'directory' ELSE 'none' END AS kind FROM (SELECT DISTINCT repo, branch, path FROM head UNION SELECT repo, branch, regexp_extract(path, '^(.*)/[^/]*$', 1) FROM head WHERE contains(path, '/') UNION SELECT repo, branch, path || '.none' FROM head) q"),
    "line_merge3": "WITH " + ", ".join(_DOCL.format(k, "l[i]" if not k else f"CASE WHEN (i - 1 + doc_id) % 7 = {k} THEN 'edit {k}: ' || l[i] ELSE l[i] END") for k in (0, 1, 2)) + " SELECT key, idx, CASE WHEN o.line = t.line THEN o.line WHEN b.line = o.line THEN t.line WHEN b.line = t.line THEN o.line ELSE '<<<<<<< ours' || chr(10) || o.line || chr(10) || '=======' || chr(10) || t.line || chr(10) || '>>>>>>> theirs' END AS line, o.line != t.line AND b.line != o.line AND b.line != t.line AS conflict FROM l0 b JOIN l1 o USING (key, idx) JOIN l2 t USING (key, idx)",
}
