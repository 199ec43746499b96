"""Walks and mark-and-sweep from all heads, against brute force."""

from collections import defaultdict

from test_projects_all import brute_reach

from cairnlake.operators import history as op
from cairnlake.plans import history
from cairnlake.plans import relations as R


def test_heads(spark):
    links = [("b", "a"), ("c", "a"), ("d", "c"), ("x", "y"), ("y", "x"), ("y", "p"), ("p", "q"), ("q", "p"), ("s", "s")]
    commits = spark.createDataFrame([(c,) for c in "abcdxypqs"], "hash string")
    frame = spark.createDataFrame(links, "child string, parent string")
    assert sorted(r[0] for r in op.heads(commits, frame).collect()) == ["b", "d", "s", "y"]


def test_walks_and_sweep_from_all_heads(spark, root):
    parents, everything = defaultdict(set), {r[0] for r in R.commits(spark, root).select("hash").collect()}
    for r in R.commit_links(spark, root).where("child <> parent").collect():
        parents[r["child"]].add(r["parent"])
    named = {p for ps in parents.values() for p in ps}
    reached = defaultdict(set)
    for r in history.QUERIES["ancestors"](spark, root).collect():
        reached[r["start"]].add(r["node"])
    assert everything - named <= set(reached) and set().union(*reached.values()) == everything
    assert all(nodes == brute_reach(start, parents) for start, nodes in reached.items())
    live = {r[0] for r in R.commits(spark, root).select("manifest").collect()} | {r[0] for r in R.snapshots(spark, root).where("back = 1").select("manifest").collect()}
    used = {r[1] for r in R.chunk_refs(R.entries(spark, root), "manifest").select("manifest", "chunk_hash").collect() if r[0] in live}
    stored = {r[0] for r in R.stored_chunks(spark, root).select("hash").collect()}
    assert {r[0] for r in history.QUERIES["reachability_gc"](spark, root).collect()} == stored - used
