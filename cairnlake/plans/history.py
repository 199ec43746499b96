"""Queries on commits, refs and reachability."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlake.operators import history as op
from cairnlake.operators import integrity as chk
from cairnlake.plans import relations as R
from cairnlake.plans.problems import norm_hash_sql as NH
from cairnlake.plans.relations import sql
from cairnlake.session import cut
from cairnlake.sources.tables import table


def _graph(s, d, first=False):
    return op.graph(R.commits(s, d), R.commit_links(s, d, first_only=first))


def _heads(s, d):
    return op.heads(R.commits(s, d), R.commit_links(s, d))


def _reach(s, d, first=False):
    """What every head reaches."""
    return _graph(s, d, first).ancestors(_heads(s, d).select(F.col("hash").alias("node")))


def _halfway(reached):
    return reached.groupBy("start").agg(F.max("steps").alias("last")).join(reached, "start").where("steps = last div 2").select("start", "node")


def _tested(s, d):
    """Commits that a test called good (their hash begins with 0) or bad (with f)."""
    return R.commits(s, d).select(F.col("hash").alias("node"), F.col("hash").startswith("f").alias("bad")).where("node < '1' or bad").distinct()


def _narrowed(s, d):
    return op.narrowed(cut(_reach(s, d, True)), _tested(s, d))


def _sweep(s, d):
    """Chunks that neither the heads' histories nor the newest snapshots of the branches name."""
    graph = _graph(s, d)
    live = cut(chk.live_manifests(graph.marked(graph.heads()), R.commits(s, d), R.snapshots(s, d).where("back = 1")))
    return chk.unreachable_chunks(R.entries(s, d, live), R.stored_chunks(s, d))


def _revisions(s, d):
    """Revisions of tags, of the latest commits by prefix, and of nothing."""
    tags = _tags(s, d).select(F.concat("name", F.element_at(F.array(*[F.lit(x) for x in ("", "~1", "^", "~3")]), (F.ascii(F.substring("hash", 2, 1)) % 4 + 1).cast("int"))).alias("text"))
    short = op.tips(R.commits(s, d)).select(F.concat(F.substring("hash", 1, 10), F.lit("~2")).alias("text"))
    return tags.union(short).union(s.createDataFrame([("nothing",), ("zzzzzzz~1",), ("v~x",)], "text string"))


def _tags(s, d):
    """Every commit whose hash begins with 0 or 1 is tagged."""
    return R.commits(s, d).select("hash").distinct().where("hash < '2'").select("hash", F.concat(F.lit("v"), F.substring("hash", 1, 8)).alias("name"))


def _pairs(s, d):
    """Two commits a repo: the tip and the latest commit with another author."""
    c = R.commits(s, d)
    tip = op.tips(c).join(c.select("hash", F.col("author").alias("own")), "hash").select("repo", F.col("hash").alias("a"), "own")
    other = c.join(tip, "repo").where("author is null or author <> own").select("repo", "hash", "ts", "a")
    b = other.groupBy("repo", "a").agg(F.max_by("hash", F.struct("ts", "hash")).alias("b"))
    return b.select(F.col("repo").alias("pair"), "a", "b")


def _merge_base(s, d):
    pairs = _pairs(s, d)
    links = R.commit_links(s, d)
    starts = pairs.select(F.col("a").alias("start")).union(pairs.select(F.col("b").alias("start")))
    reached = op.reach(starts, links)
    side = lambda c: pairs.select("pair", F.col(c).alias("start")).join(reached, "start").select("pair", "node", "steps")
    return op.merge_bases(side("a"), side("b"), links, R.commits(s, d))


def _not_upstream(s, d):
    pairs = _pairs(s, d)
    reached = op.reach(pairs.select(F.col("a").alias("start")).union(pairs.select(F.col("b").alias("start"))), R.commit_links(s, d))
    side = lambda c: pairs.select("pair", F.col(c).alias("start")).join(reached, "start").select("pair", "node")
    return side("a").exceptAll(side("b"))


QUERIES = {
    "ancestors": lambda s, d: _reach(s, d),
    "log_chain": lambda s, d: _reach(s, d, True).select("start", "node"),
    "rev_walk_n": lambda s, d: _reach(s, d, True).where("steps = 5").select("start", "node"),
    "chain_length": lambda s, d: _reach(s, d, True).groupBy("start").agg(F.count(F.lit(1)).alias("n")),
    "count_between": lambda s, d: op.between(_graph(s, d), _graph(s, d, True), cut(_pairs(s, d).select(F.col("b").alias("old"), F.col("a").alias("new")))),
    "bisect": lambda s, d: _halfway(cut(_reach(s, d, True))),
    "bisect_narrowed": _narrowed,
    "rev_parse": lambda s, d: op.resolve(_revisions(s, d), _tags(s, d), R.commits(s, d).select("hash").distinct(), _graph(s, d, True)),
    "describe": lambda s, d: op.describe(_reach(s, d), _tags(s, d)),
    "merge_base": _merge_base,
    "ff_check": lambda s, d: _pairs(s, d).join(_merge_base(s, d), "pair").select("pair", F.when(F.col("node") == F.col("a"), "up_to_date").when(F.col("node") == F.col("b"), "fast_forward").otherwise("merge").alias("kind")),
    "commits_not_in_upstream": _not_upstream,
    "log_all": lambda s, d: op.log(R.commits(s, d).select("repo", "hash", "ts").distinct(), 20),
    "log_limit": lambda s, d: R.commits(s, d).select("hash", "ts").distinct().orderBy(F.desc("ts"), F.desc("hash")).limit(50),
    "shortlog": lambda s, d: op.shortlog(R.commits(s, d)),
    "prefix_lookup": lambda s, d: op.by_prefix(R.commits(s, d), 2),
    "decorate_log": lambda s, d: R.commits(s, d).select("hash").distinct().join(_tags(s, d), "hash", "left").groupBy("hash").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("labels")),
    "keyset_page": lambda s, d: op.page(R.commits(s, d).select("hash", "message").distinct(), "hash", "8", 25),
    "commit_filter": lambda s, d: R.commits(s, d).where("lower(author) like 'b%' and ts >= timestamp_ntz'2025-06-01' and ts < timestamp_ntz'2026-01-01'").select("hash", "ts").distinct(),
    "repo_commit_count": lambda s, d: R.commits(s, d).groupBy("repo").agg(F.countDistinct("hash").alias("n")),
    "message_title": lambda s, d: R.commits(s, d).select("hash", F.split("message", "\n")[0].alias("title")).distinct(),
    "fsck_parents": lambda s, d: chk.dangling_parents(R.commits(s, d)),
    "fsck_manifests": lambda s, d: chk.dangling_manifests(R.commits(s, d), table(s, d, "manifests")),
    "fsck_counts": lambda s, d: chk.counts(R.commits(s, d), table(s, d, "manifests"), R.stored_chunks(s, d)),
    "reachability_gc": _sweep,
    "gc_stats": lambda s, d: _sweep(s, d).agg(F.count(F.lit(1)).alias("unreferenced"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_to_free")),
    "reflog_capture": lambda s, d: op.ref_changes(R.snapshots(s, d).select(F.concat_ws(":", "repo", "branch").alias("ref"), F.col("nth").alias("seq"), F.col("manifest").alias("hash"))),
    "reflog_retention": lambda s, d: R.snapshots(s, d).where("back <= 5").select("repo", "branch", "manifest"),
    "fetch_ref_delta": lambda s, d: R.snapshots(s, d).where("back = 1").select("repo", "branch", F.col("manifest").alias("remote")).join(R.snapshots(s, d).where("back = 2").select("repo", "branch", F.col("manifest").alias("local")), ["repo", "branch"], "left").select("repo", "branch", F.when(F.col("local").isNull(), "new").otherwise("changed").alias("kind")),
    "branches_sorted": lambda s, d: R.snapshots(s, d).select("repo", "branch").distinct().orderBy("repo", "branch"),
    "scan_manifest": lambda s, d: R.head_entries(s, d).where("branch = 'main'").select("repo", "path", "content_hash"),
}

_TIP = "tip AS (SELECT repo, max_by(hash, (ts, hash)) AS hash FROM cm GROUP BY repo)"
_HEADS = [
    "up AS (SELECT child AS x, parent AS y FROM links WHERE child != parent UNION SELECT x, l.parent FROM up JOIN links l ON l.child = y)",
    "free AS (SELECT DISTINCT hash FROM cm WHERE hash IS NOT NULL AND hash NOT IN (SELECT parent FROM links WHERE child != parent))",
    "rest AS (SELECT DISTINCT hash FROM cm WHERE hash IS NOT NULL AND hash NOT IN (SELECT hash FROM free) AND hash NOT IN (SELECT y FROM up WHERE x IN (SELECT hash FROM free)))",
    "heads AS (SELECT hash FROM free UNION SELECT hash FROM rest r WHERE NOT EXISTS (FROM up u WHERE u.y = r.hash AND NOT EXISTS (FROM up v WHERE v.x = r.hash AND v.y = u.x)) AND NOT EXISTS (FROM up u WHERE u.x = r.hash AND u.y > r.hash AND EXISTS (FROM up v WHERE v.x = u.y AND v.y = r.hash)))",
]
_R = "r AS (SELECT hash AS start, hash AS node, 0 AS steps FROM heads UNION SELECT start, l.parent, steps + 1 FROM r JOIN {} l ON l.child = r.node WHERE steps < 1000)"
_RD = "rd AS (SELECT start, node, min(steps)::BIGINT AS steps FROM r GROUP BY 1, 2)"
_TAGS = "tags AS (SELECT DISTINCT hash, 'v' || substr(hash, 1, 8) AS name FROM cm WHERE hash < '2')"
_PAIRS = "prs AS (SELECT t.repo AS pair, t.hash AS a, max_by(c.hash, (c.ts, c.hash)) AS b FROM tip t JOIN (SELECT DISTINCT hash, author FROM cm) x ON x.hash = t.hash JOIN cm c ON c.repo = t.repo AND (c.author IS NULL OR c.author != x.author) GROUP BY 1, 2)"
_AB = "s0 AS (SELECT a AS start FROM prs UNION SELECT b FROM prs), rr AS (SELECT start, start AS node FROM s0 UNION SELECT start, l.parent FROM rr JOIN links l ON l.child = rr.node)"
_COMMON = "com AS (SELECT pair, x.node FROM prs JOIN rr x ON x.start = a JOIN rr y ON y.start = b AND y.node = x.node), best AS (SELECT c.pair, max_by(c.node, (cm.ts, c.node)) AS node FROM com c JOIN cm ON cm.hash = c.node WHERE NOT EXISTS (FROM com k JOIN links l ON l.child = k.node WHERE k.pair = c.pair AND l.parent = c.node) GROUP BY 1)"


def _rec(names: str, ctes: list[str], body: str) -> str:
    return sql(names, "", True).rstrip() + ",\n" + ",\n".join(ctes) + "\n" + body


_ANC = ("cm links", [*_HEADS, _R.format("links"), _RD])
_FIRST = ("cm links first", [*_HEADS, _R.format("first"), _RD])
_UNREACH = "SELECT hash, size FROM stored WHERE hash NOT IN (SELECT " + NH("u.c.hash") + " FROM entries e, unnest(e.chunks) u(c) WHERE " + NH("u.c.hash") + " IS NOT NULL AND (e.manifest IN (SELECT manifest FROM cm JOIN rd ON rd.node = cm.hash WHERE manifest IS NOT NULL) OR e.manifest IN (SELECT manifest FROM snaps WHERE back = 1)))"

SQL = {
    "ancestors": _rec(*_ANC, "SELECT start, node, steps FROM rd"),
    "log_chain": _rec(*_FIRST, "SELECT start, node FROM rd"),
    "rev_walk_n": _rec(*_FIRST, "SELECT start, node FROM rd WHERE steps = 5"),
    "chain_length": _rec(*_FIRST, "SELECT start, count(*) AS n FROM rd GROUP BY 1"),
    "count_between": _rec("cm links first", [_TIP, _PAIRS, _AB, "w AS (SELECT DISTINCT a, b, a AS node, 0 AS k FROM prs UNION SELECT a, b, f.parent, k + 1 FROM w JOIN first f ON f.child = w.node WHERE k < 1000)", "wk AS (SELECT a, b, node, min(k) AS k FROM w GROUP BY ALL)"], "SELECT b AS old, a AS new, coalesce(min(k) FILTER (node IN (SELECT rr.node FROM rr WHERE rr.start = b)), count(*)) AS n FROM wk GROUP BY a, b"),
    "rev_parse": _rec("cm links first", [_TIP, _TAGS, "nm AS (SELECT name || ['', '~1', '^', '~3'][ascii(substr(hash, 2, 1)) % 4 + 1] AS text FROM tags UNION SELECT substr(hash, 1, 10) || '~2' FROM tip UNION VALUES ('nothing'), ('zzzzzzz~1'), ('v~x'))",
        "rv AS (SELECT text, regexp_extract(text, '^([^~^]+)', 1) AS base, CASE WHEN regexp_matches(text, '^[^~^]+$') THEN 0 WHEN regexp_matches(text, '^[^~^]+[~^]$') THEN 1 ELSE try_cast(regexp_extract(text, '[~^](\\d+)$', 1) AS INT) END AS n FROM nm)",
        "ax AS (SELECT text, 0 AS k, n, coalesce((SELECT min(hash) FROM tags WHERE name = base), CASE WHEN length(base) >= 6 THEN (SELECT min(hash) FROM cm WHERE starts_with(cm.hash, base)) END) AS hash FROM rv UNION SELECT text, k + 1, n, f.parent FROM ax JOIN first f ON f.child = ax.hash WHERE k < n)"],
        "SELECT nm.text, a.hash FROM (SELECT DISTINCT text FROM nm) nm LEFT JOIN ax a ON a.text = nm.text AND a.k = a.n"),
    "bisect_narrowed": _rec(*_FIRST, "SELECT start, node, n AS left FROM (SELECT *, count(*) OVER (PARTITION BY start) AS n, min(steps) OVER (PARTITION BY start) AS low FROM (SELECT * FROM (SELECT *, min(steps) FILTER (node < '1' AND steps > bad_at) OVER (PARTITION BY start) AS good_at FROM (SELECT *, coalesce(max(steps) FILTER (node >= 'f') OVER (PARTITION BY start), 0) AS bad_at FROM rd)) WHERE steps >= bad_at AND (good_at IS NULL OR steps < good_at))) WHERE steps = low + n // 2").replace("AS left FROM", 'AS "left" FROM'),
    "bisect": _rec(*_FIRST, "SELECT start, node FROM (SELECT *, max(steps) OVER (PARTITION BY start) AS last FROM rd) WHERE steps = last // 2"),
    "describe": _rec(_ANC[0], [*_ANC[1], _TAGS], "SELECT start, min((steps, name)).name AS tag, min((steps, name)).steps AS steps FROM (SELECT start, steps, name FROM rd JOIN tags ON hash = node) GROUP BY 1").replace("min((steps, name))", "min({'steps': steps, 'name': name})"),
    "merge_base": _rec("cm links", [_TIP, _PAIRS, _AB, _COMMON], "SELECT pair, node FROM best"),
    "ff_check": _rec("cm links", [_TIP, _PAIRS, _AB, _COMMON], "SELECT pair, CASE node WHEN a THEN 'up_to_date' WHEN b THEN 'fast_forward' ELSE 'merge' END AS kind FROM prs JOIN best USING (pair)"),
    "commits_not_in_upstream": _rec("cm links", [_TIP, _PAIRS, _AB], "SELECT pair, node FROM prs JOIN rr ON start = a EXCEPT SELECT pair, node FROM prs JOIN rr ON start = b"),
    "log_all": sql("cm", "SELECT repo, hash, ts, row_number() OVER (PARTITION BY repo ORDER BY ts DESC NULLS LAST, hash DESC) AS rank FROM (SELECT DISTINCT repo, hash, ts FROM cm) QUALIFY rank <= 20"),
    "log_limit": sql("cm", "SELECT DISTINCT hash, ts FROM cm ORDER BY ts DESC NULLS LAST, hash DESC LIMIT 50"),
    "shortlog": sql("cm", "SELECT repo, array_to_string(list_transform(string_split(lower(trim(author)), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS author, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM cm GROUP BY 1, 2"),
    "prefix_lookup": sql("cm", "SELECT substr(hash, 1, 2) AS prefix, count(DISTINCT hash) AS n, count(DISTINCT hash) > 1 AS ambiguous FROM cm GROUP BY 1"),
    "decorate_log": sql("cm", f"SELECT * FROM (WITH {_TAGS} SELECT h.hash, coalesce(name, '') AS labels FROM (SELECT DISTINCT hash FROM cm) h LEFT JOIN tags USING (hash))"),
    "keyset_page": sql("cm", "SELECT DISTINCT hash, message FROM cm WHERE hash > '8' ORDER BY hash LIMIT 26"),
    "commit_filter": sql("cm", "SELECT DISTINCT hash, ts FROM cm WHERE lower(author) LIKE 'b%' AND ts >= TIMESTAMP '2025-06-01' AND ts < TIMESTAMP '2026-01-01'"),
    "repo_commit_count": sql("cm", "SELECT repo, count(DISTINCT hash) AS n FROM cm GROUP BY 1"),
    "message_title": sql("cm", "SELECT DISTINCT hash, split_part(message, chr(10), 1) AS title FROM cm"),
    "fsck_parents": sql("cm", "SELECT DISTINCT hash, p AS parent FROM (SELECT hash, unnest([parent] || coalesce(parents, [])) AS p FROM cm) WHERE p IS NOT NULL AND p NOT IN (SELECT hash FROM cm)"),
    "fsck_manifests": sql("cm", "SELECT DISTINCT hash, manifest FROM cm WHERE manifest IS NOT NULL AND manifest NOT IN (SELECT manifest FROM manifests WHERE manifest IS NOT NULL)"),
    "fsck_counts": sql("cm stored", "SELECT (SELECT count(DISTINCT hash) FROM cm) AS commits, (SELECT count(DISTINCT manifest) FROM manifests) AS manifests, (SELECT count(*) FROM stored) AS chunks, (SELECT count(*) FROM (SELECT DISTINCT hash, unnest([parent] || coalesce(parents, [])) AS p FROM cm) WHERE p IS NOT NULL AND p NOT IN (SELECT hash FROM cm)) AS dangling_parents"),
    "reachability_gc": _rec("cm links entries snaps stored", _ANC[1], _UNREACH),
    "gc_stats": _rec("cm links entries snaps stored", _ANC[1], f"SELECT count(*) AS unreferenced, coalesce(sum(size), 0)::BIGINT AS bytes_to_free FROM ({_UNREACH})"),
    "reflog_capture": sql("snaps", "SELECT ref, seq, previous, hash, CASE WHEN previous IS NULL THEN 'create' ELSE 'update' END AS action FROM (SELECT repo || ':' || branch AS ref, nth AS seq, lag(manifest) OVER (PARTITION BY repo, branch ORDER BY nth) AS previous, manifest AS hash FROM snaps) WHERE previous IS DISTINCT FROM hash"),
    "reflog_retention": sql("snaps", "SELECT repo, branch, manifest FROM snaps WHERE back <= 5"),
    "fetch_ref_delta": sql("snaps", "SELECT repo, branch, CASE WHEN count(*) FILTER (back = 2) = 0 THEN 'new' ELSE 'changed' END AS kind FROM snaps GROUP BY 1, 2"),
    "branches_sorted": "SELECT DISTINCT repo, branch FROM manifests WHERE manifest IS NOT NULL AND seq IS NOT NULL ORDER BY 1, 2",
    "scan_manifest": sql("entries snaps head", "SELECT repo, path, content_hash FROM head WHERE branch = 'main'"),
}
