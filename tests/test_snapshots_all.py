"""Trees over all consecutive snapshots, against brute force."""

from collections import defaultdict

from cairnlake.plans import problems, trees
from cairnlake.plans import relations as R


def test_trees_over_all_snapshots(spark, root):
    kinds = {"A": "added", "D": "removed", "M": "changed"}
    got = {(r["repo"], r["branch"], r["seq"], r["path"], kinds[r["change"]]) for r in trees.QUERIES["commit_diff"](spark, root).collect()}
    assert got == {tuple(r) for r in problems.p6_found(spark, root).collect()}
    snaps = defaultdict(list)
    for r in R.snapshots(spark, root).orderBy("nth").collect():
        snaps[r["repo"], r["branch"]].append((r["manifest"], r["seq"]))
    files = defaultdict(dict)
    for r in R.entries(spark, root).collect():
        files[r["manifest"]][r["path"]] = r["content_hash"]
    want = set()
    for (repo, branch), s in snaps.items():
        for (b, _), (o, _), (t, seq) in zip(s, s[1:], s[2:]):
            for path in files[b].keys() | files[o].keys() | files[t].keys():
                x, y, z = (files[m].get(path, "none") for m in (b, o, t))
                kept = y if y == z or x == z else z if x == y else "none"
                if kept != "none":
                    want.add((repo, branch, seq, path, kept))
    rows = trees.QUERIES["merge_manifests"](spark, root).collect()
    assert len(rows) == len(want) and {(r["repo"], r["branch"], r["seq"], r["path"], r["content_hash"]) for r in rows} == want
