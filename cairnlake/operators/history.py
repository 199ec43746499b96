"""Walking commit graphs, on the nested sets of :mod:`cairnlake.operators.hierarchy`."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.operators.hierarchy import Hierarchy, hierarchy
from cairnlake.session import cut


def graph(commits: DataFrame, links: DataFrame) -> Hierarchy:
    """The graph of ``commits`` (hash) and ``links`` (child, parent)."""
    return hierarchy(commits.select(F.col("hash").alias("node")), links.select("child", "parent", F.lit(0).alias("ord")))


def reach(starts: DataFrame, links: DataFrame) -> DataFrame:
    """(start, node, steps): every node that ``starts`` (start) reach over ``links`` (child, parent), fewest steps.

    A start reaches itself with 0 steps.  Cycles are walked once.  Runs jobs.
    """
    nodes = starts.select(F.col("start").alias("hash")).union(links.select("child")).union(links.select("parent"))
    return graph(nodes, links).ancestors(starts.select(F.col("start").alias("node")))


def reach_by_steps(starts: DataFrame, links: DataFrame) -> DataFrame:
    """(start, node, steps) like :func:`reach`, one link a round from what is new: for graphs that branch so much that
    jumps of 2^k links would lead everywhere (dependencies), where few rounds reach all there is."""
    edges = cut(links.select("child", "parent").distinct())
    front = cut(starts.select("start", F.col("start").alias("node"), F.lit(0).cast("long").alias("steps")).distinct())
    got, n = front, 0
    while front.limit(1).count():
        n += 1
        more = front.join(edges, front["node"] == edges["child"]).select("start", F.col("parent").alias("node")).distinct()
        front = cut(more.join(got.select("start", "node"), ["start", "node"], "left_anti").withColumn("steps", F.lit(n).cast("long")))
        got = got.unionByName(front)
        if n % 4 == 0:
            got = cut(got)
    return cut(got)


def tips(commits: DataFrame) -> DataFrame:
    """(repo, hash): the latest commit of each repo (ties: the greater hash)."""
    return commits.groupBy("repo").agg(F.max_by("hash", F.struct("ts", "hash")).alias("hash"))


def heads(commits: DataFrame, links: DataFrame) -> DataFrame:
    """(hash): every commit that is no other commit's parent, and of each cycle that nothing outside leads to the greatest hash."""
    return graph(commits, links).heads().select(F.col("node").alias("hash"))


def between(graph: Hierarchy, first: Hierarchy, ranges: DataFrame) -> DataFrame:
    """(old, new, n): for each pair of ``ranges`` (old, new) how many first parents (graph ``first``) one walks from ``new``,
    itself counted, until a commit that is ``old`` or an ancestor of it over any parents; to the end if there is none."""
    pairs = ranges.select("old", "new").distinct()
    known = graph.ancestors(pairs.select(F.col("old").alias("node"))).select(F.col("start").alias("old"), "node", F.lit(True).alias("met"))
    walk = pairs.join(first.ancestors(pairs.select(F.col("new").alias("node"))).withColumnRenamed("start", "new"), "new")
    told = walk.join(known, ["old", "node"], "left")
    return told.groupBy("old", "new").agg(F.coalesce(F.min(F.when(F.col("met"), F.col("steps"))), F.count(F.lit(1))).alias("n"))


def narrowed(reached: DataFrame, known: DataFrame) -> DataFrame:
    """(start, node, left): the commit to test next when searching a first-parent chain for the first bad one.

    ``reached`` is (start, node, steps) of first parents, ``known`` (node, bad).  Of the commits between the oldest known
    bad one (the start, if none is known) and the newest known good one before it, the middle is next; ``left`` are the
    candidates that remain, the bad one included.  A chain without good commit is searched to its end.
    """
    told = reached.join(known, "node", "left")
    ends = told.groupBy("start").agg(F.coalesce(F.max(F.when(F.col("bad"), F.col("steps"))), F.lit(0)).alias("bad_at"))
    told = told.join(ends, "start")
    good = told.groupBy("start").agg(F.min(F.when(~F.col("bad") & (F.col("steps") > F.col("bad_at")), F.col("steps"))).alias("good_at"))
    open_ = told.join(good, "start").where("steps >= bad_at and (good_at is null or steps < good_at)")
    last = open_.groupBy("start").agg(F.min("steps").alias("low"), F.count(F.lit(1)).alias("left"))
    return open_.join(last, "start").where("steps = low + left div 2").select("start", "node", "left")


def resolve(names: DataFrame, refs: DataFrame, commits: DataFrame, first: Hierarchy) -> DataFrame:
    """(text, hash): the commits that revisions ``names`` (text) stand for; null where there is none.

    A revision is a ref or a prefix of a hash of at least six digits (of several commits the least), then ``~N``, ``^`` or
    ``^N``: N first parents up.  ``refs`` is (name, hash), unique; ``first`` the graph of first parents.
    """
    from cairnlake.functions.scalars import revision

    rows = names.select("text").distinct().withColumn("r", revision(F.col("text"))).select("text", F.col("r.base").alias("base"), F.col("r.steps").alias("up"))
    by_name = rows.join(refs.select(F.col("name").alias("base"), F.col("hash").alias("by_name")), "base", "left")
    short = by_name.where("by_name is null and length(base) >= 6").select("text", F.lower("base").alias("prefix"), F.lower(F.substring("base", 1, 6)).alias("six"))
    six = commits.select(F.substring("hash", 1, 6).alias("six"), "hash")
    by_prefix = short.join(six, "six").where(F.col("hash").startswith(F.col("prefix"))).groupBy("text").agg(F.min("hash").alias("by_prefix"))
    based = cut(by_name.join(by_prefix, "text", "left").select("text", "up", F.coalesce("by_name", "by_prefix").alias("start")))
    walked = first.ancestors(based.select(F.col("start").alias("node")))
    found = based.join(walked, "start").where("steps = up").select("text", F.col("node").alias("hash"))
    return based.select("text").join(found, "text", "left")


def merge_bases(a_reach: DataFrame, b_reach: DataFrame, links: DataFrame, commits: DataFrame) -> DataFrame:
    """(pair, node): the best common ancestor of the starts of each pair.

    Inputs are (pair, node, steps).  Best is a common ancestor that no other common ancestor descends from; of several
    the latest, then the greatest hash.
    """
    common = a_reach.select("pair", "node").join(b_reach.select("pair", "node"), ["pair", "node"])
    covered = common.join(links, common["node"] == links["child"]).select("pair", F.col("parent").alias("node"))
    best = common.join(covered, ["pair", "node"], "left_anti").join(commits.select(F.col("hash").alias("node"), "ts"), "node")
    return best.groupBy("pair").agg(F.max_by("node", F.struct("ts", "node")).alias("node"))


def log(commits: DataFrame, limit: int) -> DataFrame:
    """The latest commits of each repo, newest first (ties: hash), with their rank."""
    w = Window.partitionBy("repo").orderBy(F.desc("ts"), F.desc("hash"))
    return commits.select("repo", "hash", "ts", F.row_number().over(w).alias("rank")).where(F.col("rank") <= limit)


def shortlog(commits: DataFrame) -> DataFrame:
    """Commits by author (without case), with first and last time."""
    return commits.groupBy("repo", F.initcap(F.trim("author")).alias("author")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def by_prefix(commits: DataFrame, length: int) -> DataFrame:
    """Abbreviations of this length: how many commits have each, and whether it is ambiguous."""
    out = commits.select("hash").distinct().groupBy(F.substring("hash", 1, length).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("ambiguous", F.col("n") > 1)


def describe(reached: DataFrame, tags: DataFrame) -> DataFrame:
    """(start, tag, steps): the nearest tag (name, hash) at or above each start (ties: name)."""
    near = reached.join(tags, reached["node"] == tags["hash"])
    return near.groupBy("start").agg(F.min(F.struct("steps", "name")).alias("m")).select("start", F.col("m.name").alias("tag"), F.col("m.steps").alias("steps"))


def page(rows: DataFrame, key: str, after, size: int) -> DataFrame:
    """A page of rows with keys after a cursor, in order; one row more tells that there is another page."""
    w = rows if after is None else rows.where(F.col(key) > F.lit(after))
    return w.orderBy(key).limit(size + 1)


def ref_changes(log_rows: DataFrame) -> DataFrame:
    """Reflog from snapshots of refs (ref, seq, hash): a row where the hash differs from the one before."""
    w = Window.partitionBy("ref").orderBy("seq")
    before = F.lag("hash").over(w)
    return log_rows.select("ref", "seq", before.alias("previous"), "hash").where(~F.col("hash").eqNullSafe(F.col("previous"))).withColumn("action", F.when(F.col("previous").isNull(), "create").otherwise("update"))
