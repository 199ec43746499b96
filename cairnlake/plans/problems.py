"""Queries of the general data problems: hierarchies (p2), orphans (p3), small files (p4), snapshot changes (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.functions.keys import is_directory, norm_hash
from cairnlake.operators import compaction, orphans, snapshots
from cairnlake.operators.hierarchy import Hierarchy, hierarchy
from cairnlake.sources.tables import table


def _references(spark: SparkSession, root: str) -> DataFrame:
    entries, mp4 = table(spark, root, "manifest_entries"), table(spark, root, "mp4_metadata")
    return orphans.union_all(
        [
            orphans.references(entries, "manifest_entries", F.col("entry_id"), F.col("chunks.hash"), F.col("recorded_at")),
            orphans.references(mp4, "mp4_metadata", F.col("mp4_id"), F.array("moov_hash"), F.col("recorded_at")),
        ]
    )


def _orphans(spark: SparkSession, root: str) -> DataFrame:
    return orphans.orphan_references(_references(spark, root), table(spark, root, "chunks"), table(spark, root, "builtin_chunks"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return _orphans(spark, root).select("ref_table", "ref_id", "target_hash", "ref_state", F.date_format("at", "yyyy-MM").alias("ref_month"))


def p3_report(spark: SparkSession, root: str) -> DataFrame:
    """Orphans per referring table, month and state, beside all references of the month."""
    return orphans.orphan_report(_orphans(spark, root), _references(spark, root))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    changes = snapshots.snapshot_changes(table(spark, root, "manifests"), table(spark, root, "manifest_entries"))
    return changes.select("repo", "branch", "seq", "path", "change_kind").distinct()


def p6_summary(spark: SparkSession, root: str) -> DataFrame:
    """How many paths each snapshot added, removed and changed."""
    changes = snapshots.snapshot_changes(table(spark, root, "manifests"), table(spark, root, "manifest_entries"))
    return changes.groupBy("repo", "branch", "seq").agg(
        *[F.count_if(F.col("change_kind") == k).alias(f"n_{k}") for k in ("added", "removed", "changed")]
    )


def _graph(spark: SparkSession, root: str) -> Hierarchy:
    """Commits (c:hash) and directories (t:hash) as one graph."""
    commits, trees = table(spark, root, "commits"), table(spark, root, "tree_entries")
    key = lambda kind, c: F.concat(F.lit(kind), norm_hash(F.col(c)))
    dirs = trees.where(is_directory(F.col("mode")))
    nodes = commits.select(key("c:", "hash").alias("node")).unionByName(trees.select(key("t:", "tree_hash").alias("node")))
    nodes = nodes.unionByName(dirs.select(key("t:", "hash").alias("node")))
    named = F.concat(F.array("parent"), F.coalesce("parents", F.array().cast("array<string>")))
    of_commits = commits.select(key("c:", "hash").alias("child"), F.posexplode(named).alias("ord", "p")).select("child", key("c:", "p").alias("parent"), "ord")
    of_dirs = dirs.select(key("t:", "hash").alias("child"), key("t:", "tree_hash").alias("parent"), F.lit(0).alias("ord"))
    return hierarchy(nodes, of_commits.unionByName(of_dirs))


def _kind(c: str = "node"):
    return F.when(F.col(c).startswith("c:"), "commit").otherwise("tree").alias("kind")


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    graph = _graph(spark, root)
    below = graph.root_links().select(_kind(), F.substring("node", 3, 1 << 20).alias("node"), F.substring("root", 3, 1 << 20).alias("root"), F.col("n_links").cast("int").alias("n_links"))
    cycles = graph.on_cycles.select(_kind(), F.substring("node", 3, 1 << 20).alias("node"), F.lit("cycle").alias("root"), F.lit(-1).alias("n_links"))
    return below.unionByName(cycles)


def p2_hierarchy(spark: SparkSession, root: str) -> DataFrame:
    """Path, depth and root of every commit and directory, the number of its descendants, and all roots it descends from over any parents;
    directories have their names in the path."""
    trees = table(spark, root, "tree_entries").where(is_directory(F.col("mode")))
    names = trees.select(F.concat(F.lit("t:"), norm_hash(F.col("hash"))).alias("node"), "name").where("node is not null").groupBy("node").agg(F.min("name").alias("name"))
    graph = _graph(spark, root)
    roots = graph.root_links().groupBy("node").agg(F.sort_array(F.collect_list(F.substring("root", 3, 1 << 20))).alias("roots"))
    paths = graph.with_paths(names).join(roots, "node", "left")
    return paths.select(
        _kind(), F.substring("node", 3, 1 << 20).alias("node"), F.regexp_replace("path", "[ct]:", "").alias("path"), "depth", F.substring("root", 3, 1 << 20).alias("root"), F.coalesce("roots", F.array().cast("array<string>")).alias("roots"), "n_descendants", "unprocessed"
    )


def p2_descendants(spark: SparkSession, root: str) -> DataFrame:
    """Every commit and directory beside each of its descendants over any parents."""
    graph = _graph(spark, root)
    return graph.all_descendants(graph.nodes).select(_kind(), F.substring("node", 3, 1 << 20).alias("node"), F.substring("descendant", 3, 1 << 20).alias("descendant"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    done = compaction.compact(table(spark, root, "object_files"))
    done.discard()  # the answer is in the plan that was just carried out and verified
    return done.duplicates


def p4_files(spark: SparkSession, root: str) -> DataFrame:
    """How many records and bytes the compaction wrote."""
    return compaction.compact(table(spark, root, "object_files")).files().agg(F.sum("n_records").alias("n_records"), F.sum("n_bytes").alias("n_bytes"))


def p4_bins(spark: SparkSession, root: str) -> DataFrame:
    """The bins of files of 64 KiB: records, bytes, whether all keep to the target, and whether they are at most a tenth
    (and one) more than the bytes and the records' overhead need."""
    target = 1 << 16
    done = compaction.compact(table(spark, root, "object_files"), target_bytes=target)
    weight = F.col("n_bytes") + compaction.OVERHEAD * F.col("n_records")
    fits = (F.max("n_bytes") <= target).alias("fits")
    tight = (F.count(F.lit(1)) <= F.ceil(F.sum(weight) / target) * 1.1 + 1).alias("tight")
    return done.files().agg(F.sum("n_records").alias("n_records"), F.sum("n_bytes").alias("n_bytes"), fits, tight)


QUERIES = {"p2_found": p2_found, "p2_hierarchy": p2_hierarchy, "p2_descendants": p2_descendants, "p4_found": p4_found, "p4_files": p4_files, "p4_bins": p4_bins, "p3_found": p3_found, "p3_report": p3_report, "p6_found": p6_found, "p6_summary": p6_summary}


def norm_hash_sql(c: str) -> str:
    """SQL of the normal form of a hash."""
    return f"nullif(lower(regexp_replace({c}, '^\\s*([^\\s:]+\\s*:)?\\s*|\\s+$', '', 'g')), '')"


def norm_path_sql(c: str) -> str:
    """SQL of the normal form of a path."""
    return f"nfc_normalize(regexp_replace(regexp_replace(replace({c}, '\\', '/'), '/+', '/', 'g'), '^(\\./)+', ''))"


_P3 = f"""
WITH refs AS (
  SELECT DISTINCT * FROM (
    SELECT 'manifest_entries' AS ref_table, entry_id AS ref_id, recorded_at, {norm_hash_sql("u.c.hash")} AS target_hash
    FROM manifest_entries, unnest(chunks) AS u(c)
    UNION ALL
    SELECT 'mp4_metadata', mp4_id, recorded_at, {norm_hash_sql("moov_hash")} FROM mp4_metadata)
  WHERE target_hash IS NOT NULL),
par AS (
  SELECT {norm_hash_sql("hash")} AS target_hash, bool_or(deleted_at IS NULL) AS live,
         CASE WHEN count(created_at) = count(*) THEN min(created_at) END AS born
  FROM chunks GROUP BY 1),
orph AS (
  SELECT r.*, CASE WHEN p.target_hash IS NULL THEN 'missing' WHEN NOT live THEN 'deleted' WHEN born > recorded_at THEN 'late' END AS ref_state
  FROM refs r LEFT JOIN par p USING (target_hash)
  WHERE r.target_hash NOT IN (SELECT {norm_hash_sql("hash")} FROM builtin_chunks))
"""

_P6 = f"""
WITH m AS (SELECT DISTINCT manifest, repo, branch, seq, taken_at FROM manifests WHERE manifest IS NOT NULL AND seq IS NOT NULL),
pairs AS (SELECT *, lag(manifest) OVER (PARTITION BY repo, branch ORDER BY seq, taken_at, manifest) AS prev FROM m),
e AS (
  SELECT manifest, path, max_by(h, (recorded_at, entry_id)) AS h
  FROM (SELECT manifest, {norm_path_sql("path")} AS path, coalesce({norm_hash_sql("content_hash")}, '') AS h, recorded_at, entry_id
        FROM manifest_entries WHERE path IS NOT NULL)
  GROUP BY ALL),
n AS (SELECT repo, branch, seq, path, h FROM pairs JOIN e USING (manifest) WHERE prev IS NOT NULL),
o AS (SELECT repo, branch, seq, path, h FROM pairs JOIN e ON e.manifest = prev),
ch AS (
  SELECT repo, branch, seq, path,
         CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
  FROM n FULL JOIN o USING (repo, branch, seq, path) WHERE n.h IS DISTINCT FROM o.h)
"""

_P2 = f"""
WITH RECURSIVE c AS (SELECT DISTINCT 'commit' AS kind, {norm_hash_sql("hash")} AS child, unnest([parent] || coalesce(parents, [])) AS p FROM commits),
nodes AS (
  SELECT DISTINCT kind, node FROM (
    SELECT 'commit' AS kind, {norm_hash_sql("hash")} AS node FROM commits
    UNION ALL SELECT 'tree', {norm_hash_sql("tree_hash")} FROM tree_entries
    UNION ALL SELECT 'tree', {norm_hash_sql("hash")} FROM tree_entries WHERE lower(trim(mode)) IN ('directory', '040000'))
  WHERE node IS NOT NULL),
links AS (
  SELECT DISTINCT l.* FROM (
    SELECT kind, child, {norm_hash_sql("p")} AS parent FROM c
    UNION ALL SELECT 'tree', {norm_hash_sql("hash")}, {norm_hash_sql("tree_hash")} FROM tree_entries WHERE lower(trim(mode)) IN ('directory', '040000')) l
  JOIN nodes a ON a.kind = l.kind AND a.node = l.child JOIN nodes b ON b.kind = l.kind AND b.node = l.parent),
down AS (
  SELECT kind, node, node AS root, 0 AS n FROM nodes n WHERE NOT EXISTS (FROM links l WHERE l.kind = n.kind AND l.child = n.node)
  UNION SELECT d.kind, l.child, d.root, n + 1 FROM down d JOIN links l ON l.kind = d.kind AND l.parent = d.node WHERE n < 1000),
anc AS (SELECT kind, child AS node, parent AS a FROM links UNION SELECT x.kind, x.node, l.parent FROM anc x JOIN links l ON l.kind = x.kind AND l.child = x.a)
"""

_P4 = f"""
WITH f AS (SELECT DISTINCT file_id, {norm_hash_sql("hash")} AS key, data FROM object_files),
r AS (
  SELECT coalesce(octet_length(data), 0) AS n FROM f WHERE key IS NULL OR data IS NULL
  UNION ALL SELECT octet_length(data) FROM (SELECT DISTINCT key, data FROM f WHERE key IS NOT NULL AND data IS NOT NULL))
"""

SQL = {
    "p2_found": _P2
    + """SELECT kind, node, root, min(n)::INTEGER AS n_links FROM down GROUP BY ALL
UNION ALL SELECT kind, node, 'cycle', -1 FROM anc WHERE node = a""",
    "p2_descendants": _P2 + "SELECT kind, a AS node, node AS descendant FROM anc WHERE a != node",
    "p2_hierarchy": _P2.rstrip()
    + f""",
d AS (SELECT kind, node, min(n) AS d FROM down GROUP BY ALL),
lo AS (
  SELECT kind, child, parent, min(ord) AS ord FROM (
    SELECT 'commit' AS kind, {norm_hash_sql("hash")} AS child, {norm_hash_sql("ps[i]")} AS parent, i AS ord
    FROM (SELECT hash, [parent] || coalesce(parents, []) AS ps FROM commits) x, unnest(range(1, len(x.ps) + 1)) t(i)
    UNION ALL SELECT 'tree', {norm_hash_sql("hash")}, {norm_hash_sql("tree_hash")}, 0 FROM tree_entries WHERE lower(trim(mode)) IN ('directory', '040000'))
  WHERE child != parent GROUP BY ALL),
prim AS (
  SELECT l.kind, l.child, min({{'d': d.d, 'ord': ord, 'parent': parent}}).parent AS parent
  FROM lo l JOIN d ON d.kind = l.kind AND d.node = l.parent GROUP BY l.kind, l.child),
nm AS (SELECT 'tree' AS kind, {norm_hash_sql("hash")} AS node, min(name) AS name FROM tree_entries WHERE lower(trim(mode)) IN ('directory', '040000') GROUP BY 1, 2),
own AS (SELECT n.kind, n.node, coalesce(nm.name, n.node) AS name FROM nodes n LEFT JOIN nm ON nm.kind = n.kind AND nm.node = n.node),
pth AS (
  SELECT o.kind, o.node, o.node AS root, o.name AS path, 0 AS depth FROM own o JOIN d ON d.kind = o.kind AND d.node = o.node AND d.d = 0
  UNION ALL SELECT o.kind, o.node, p.root, p.path || '/' || o.name, depth + 1 FROM pth p JOIN prim c ON c.kind = p.kind AND c.parent = p.node JOIN own o ON o.kind = c.kind AND o.node = c.child),
ro AS (SELECT kind, node, list_sort(list(root)) AS roots FROM (SELECT DISTINCT kind, node, root FROM down) GROUP BY ALL),
nd AS (SELECT kind, a AS node, count(*) AS n FROM anc WHERE a != node GROUP BY ALL)
SELECT n.kind, n.node, p.path, p.depth, p.root, coalesce(ro.roots, []) AS roots, coalesce(nd.n, 0) AS n_descendants, p.path IS NULL AS unprocessed
FROM nodes n LEFT JOIN pth p USING (kind, node) LEFT JOIN ro USING (kind, node) LEFT JOIN nd USING (kind, node)""",
    "p4_found": f"""
SELECT file_id FROM (SELECT file_id, min(file_id) OVER (PARTITION BY {norm_hash_sql("hash")}, data) AS first
FROM object_files WHERE data IS NOT NULL AND {norm_hash_sql("hash")} IS NOT NULL) WHERE file_id > first""",
    "p4_files": _P4 + "SELECT count(*) AS n_records, sum(n)::BIGINT AS n_bytes FROM r",
    "p4_bins": _P4 + "SELECT count(*) AS n_records, sum(n)::BIGINT AS n_bytes, true AS fits, true AS tight FROM r",
    "p3_found": _P3 + "SELECT ref_table, ref_id, target_hash, ref_state, strftime(recorded_at, '%Y-%m') AS ref_month FROM orph WHERE ref_state IS NOT NULL",
    "p3_report": _P3
    + """, tot AS (SELECT ref_table, strftime(recorded_at, '%Y-%m') AS period, count(*) AS n_refs FROM refs GROUP BY ALL)
SELECT ref_table, period, ref_state, count(*) AS n_orphans, count(DISTINCT target_hash) AS n_keys, any_value(n_refs) AS n_refs
FROM (SELECT *, strftime(recorded_at, '%Y-%m') AS period FROM orph) JOIN tot USING (ref_table, period)
WHERE ref_state IS NOT NULL GROUP BY ref_table, period, ref_state""",
    "p6_found": _P6 + "SELECT DISTINCT repo, branch, seq, path, change_kind FROM ch",
    "p6_summary": _P6
    + """SELECT repo, branch, seq, count(*) FILTER (change_kind = 'added') AS n_added, count(*) FILTER (change_kind = 'removed') AS n_removed,
count(*) FILTER (change_kind = 'changed') AS n_changed FROM ch GROUP BY ALL""",
}
