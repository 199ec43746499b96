"""Comparing and merging file trees: diffs, status, renames, three-way merges, path filters and directories.

A tree is a DataFrame with ``group`` columns (here repo and branch), ``path`` and ``content_hash``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.functions.keys import norm_hash

GROUP = ["repo", "branch"]
KEY = [*GROUP, "path"]


def _side(tree: DataFrame, name: str, *cols: str) -> DataFrame:
    return tree.select(*KEY, F.lit(True).alias(f"in_{name}"), *[F.col(c).alias(f"{name}_{c}") for c in ("content_hash", *cols)])


def _there(name: str) -> Column:
    return F.col(f"in_{name}").isNotNull()


def tree_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(group, path, change): A(dded), M(odified) or D(eleted), comparing content hashes null-safely."""
    both = _side(old, "o").join(_side(new, "n"), KEY, "full")
    change = F.when(~_there("o"), "A").when(~_there("n"), "D").when(~F.col("o_content_hash").eqNullSafe(F.col("n_content_hash")), "M")
    return both.select(*KEY, change.alias("change")).where("change is not null")


def change_counts(diff: DataFrame) -> DataFrame:
    """Files changed, added, modified and deleted per group."""
    n = lambda k: F.count_if(F.col("change") == k)
    return diff.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("files_changed"), n("A").alias("additions"), n("M").alias("modifications"), n("D").alias("deletions"))


def status_staged(head: DataFrame, index: DataFrame) -> DataFrame:
    """(group, path, status) of the index against HEAD: new, modified, typechange, modechange or deleted."""
    both = _side(head, "h", "file_type", "mode").join(_side(index, "i", "file_type", "mode"), KEY, "full")
    same = lambda c: F.col(f"h_{c}").eqNullSafe(F.col(f"i_{c}"))
    status = F.when(~_there("h"), "new").when(~_there("i"), "deleted").when(~same("content_hash"), "modified").when(~same("file_type"), "typechange").when(~same("mode"), "modechange")
    return both.select(*KEY, status.alias("status")).where("status is not null")


def status_unstaged(head: DataFrame, index: DataFrame, work: DataFrame) -> DataFrame:
    """(group, path, status) of the working tree: against the index where the path is staged, else against HEAD;
    content before type before mode; paths in neither are untracked."""
    tracked = _side(head, "h", "file_type", "mode").join(_side(index, "i", "file_type", "mode"), KEY, "full")
    cols = ("content_hash", "file_type", "mode")
    tracked = tracked.select(*KEY, F.lit(True).alias("in_t"), *[F.when(_there("i"), F.col(f"i_{c}")).otherwise(F.col(f"h_{c}")).alias(f"t_{c}") for c in cols])
    both = _side(work, "w", "file_type", "mode").join(tracked, KEY, "left")
    same = lambda c: F.col(f"t_{c}").eqNullSafe(F.col(f"w_{c}"))
    status = F.when(~_there("t"), "untracked").when(~same("content_hash"), "modified").when(~same("file_type"), "typechange").when(~same("mode"), "modechange")
    return both.select(*KEY, status.alias("status")).where("status is not null")


def status_missing(head: DataFrame, index: DataFrame, work: DataFrame) -> DataFrame:
    """Paths of HEAD that are neither in the working tree nor staged."""
    return head.select(*KEY).join(work.select(*KEY), KEY, "left_anti").join(index.select(*KEY), KEY, "left_anti")


def renames(old: DataFrame, new: DataFrame) -> DataFrame:
    """(group, old_path, new_path): one-to-one pairs of a vanished and a new path with equal content.

    Both sides are ranked by path within a content hash; a path that still exists is a copy's source, not a rename.
    """
    w = Window.partitionBy(*GROUP, "content_hash").orderBy("path")
    key = [*GROUP, "content_hash", "k"]
    gone = old.where("content_hash is not null").join(new.select(*KEY), KEY, "left_anti").select(*GROUP, "content_hash", F.col("path").alias("old_path"), F.row_number().over(w).alias("k"))
    came = new.where("content_hash is not null").join(old.select(*KEY), KEY, "left_anti").select(*GROUP, "content_hash", F.col("path").alias("new_path"), F.row_number().over(w).alias("k"))
    return gone.join(came, key).select(*GROUP, "old_path", "new_path")


def copies(old: DataFrame, new: DataFrame) -> DataFrame:
    """(group, path): new paths whose content an old path has that still exists: added copies, no renames."""
    came = new.where("content_hash is not null").join(old.select(*KEY), KEY, "left_anti")
    kept = old.where("content_hash is not null").join(new.select(*KEY), KEY, "left_semi").select(*GROUP, "content_hash")
    return came.join(kept, [*GROUP, "content_hash"], "left_semi").select(*KEY)


def three_way(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(group, path, outcome, content_hash): clean results of a merge and its conflicts.

    ``outcome``: unchanged, ours, theirs, same (both made the same change), deleted, or a conflict: both_modified,
    both_added, modify_delete, delete_modify (our side first).  The hash is null for deletions and conflicts.
    """
    all3 = _side(base, "b").join(_side(ours, "o"), KEY, "full").join(_side(theirs, "t"), KEY, "full")
    b, o, t = _there("b"), _there("o"), _there("t")
    eq = lambda x, y: F.col(f"{x}_content_hash").eqNullSafe(F.col(f"{y}_content_hash"))
    outcome = (
        F.when(~b & ~t, "ours")
        .when(~b & ~o, "theirs")
        .when(~b, F.when(eq("o", "t"), "same").otherwise("both_added"))
        .when(~o & ~t, "deleted")
        .when(~o, F.when(eq("b", "t"), "deleted").otherwise("delete_modify"))
        .when(~t, F.when(eq("b", "o"), "deleted").otherwise("modify_delete"))
        .when(eq("o", "t"), F.when(eq("b", "o"), "unchanged").otherwise("same"))
        .when(eq("b", "o"), "theirs")
        .when(eq("b", "t"), "ours")
        .otherwise("both_modified")
    )
    rows = all3.withColumn("outcome", outcome)
    kept = F.when(F.col("outcome").isin("ours", "same", "unchanged"), F.col("o_content_hash")).when(F.col("outcome") == "theirs", F.col("t_content_hash"))
    return rows.select(*KEY, "outcome", kept.alias("content_hash"))


CONFLICTS = ("both_modified", "both_added", "modify_delete", "delete_modify")


def merged_tree(merge: DataFrame) -> DataFrame:
    """The tree that a merge without its conflicts gives."""
    return merge.where(F.col("outcome").isin("ours", "theirs", "same", "unchanged")).select(*KEY, "content_hash")


def cherry_pick(parent: DataFrame, commit: DataFrame, head: DataFrame) -> DataFrame:
    """(group, path, action) of applying a commit's change to HEAD: apply, delete, conflict or nothing to do."""
    change = tree_diff(parent, commit)
    rows = change.join(_side(parent, "p"), KEY, "left").join(_side(head, "h"), KEY, "left").join(_side(commit, "c"), KEY, "left")
    fits = F.col("p_content_hash").eqNullSafe(F.col("h_content_hash")) & (_there("p") == _there("h"))
    done = F.col("c_content_hash").eqNullSafe(F.col("h_content_hash")) & (_there("c") == _there("h"))
    action = F.when(done, "nothing").when(fits & (F.col("change") == "D"), "delete").when(fits, "apply").otherwise("conflict")
    return rows.select(*KEY, action.alias("action"))


def sync_diff(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(group, path, change, n_new, n_kept, n_removed, transfer_bytes): what to send so that ``remote`` becomes ``local``.

    ``change`` is A(dded), M (on both sides) or D (removed).  Chunks are compared by their hashes in normal form and counted
    once a file; ``transfer_bytes`` are those of every chunk that the remote file lacks.  Chunks without hash are ignored.
    """
    side = lambda df, is_local: df.select(*KEY, F.lit(is_local).alias("l"), F.explode("chunks").alias("c"))
    rows = side(local, True).unionByName(side(remote, False)).select(*KEY, "l", norm_hash(F.col("c.hash")).alias("h"), F.col("c.size").alias("size")).where("h is not null")
    each = rows.groupBy(*KEY, "h").agg(F.max("l").alias("in_l"), F.max(~F.col("l")).alias("in_r"), F.sum(F.when(F.col("l"), F.col("size"))).alias("bytes"))
    n = each.groupBy(*KEY).agg(
        F.count_if(F.col("in_l") & ~F.col("in_r")).alias("n_new"), F.count_if(F.col("in_l") & F.col("in_r")).alias("n_kept"), F.count_if(~F.col("in_l")).alias("n_removed"), F.sum(F.when(~F.col("in_r"), F.col("bytes"))).alias("transfer_bytes")
    )
    both = _side(local, "l").join(_side(remote, "r"), KEY, "full")
    change = F.when(~_there("r"), "A").when(~_there("l"), "D").otherwise("M")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_new", "n_kept", "n_removed", "transfer_bytes")]
    return both.select(*KEY, change.alias("change")).join(n, KEY, "left").select(*KEY, "change", *zero)


# -- path filters ------------------------------------------------------------------------------------------------------


def glob_regex(pattern: str) -> str:
    """A glob of an ignore file as a regular expression on whole paths: ``*`` and ``?`` stay within a name, ``**`` does
    not, a pattern without inner slash matches at any depth, a trailing slash means everything below."""
    p, out, i = pattern.strip(), "", 0
    below = p.endswith("/")
    p = p.rstrip("/")
    anywhere = "/" not in p
    p = p.lstrip("/")
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(p[i], re.escape(p[i]))
            i += 1
    return "^" + ("(.*/)?" if anywhere else "") + out + ("/.*" if below else "(/.*)?") + "$"


def matches_any(path: Column, patterns: list[str]) -> Column:
    """Whether a path matches one of the globs."""
    if not patterns:
        return F.lit(False)
    return path.rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns))


def is_ignored(path: Column, patterns: list[str], always: str = r"^\.repo(/.*)?$") -> Column:
    """Ignore rules in order, the last that matches holds, ``!`` takes back; the repository's own folder always."""
    out: Column = F.lit(False)
    for p in patterns:
        keep = p.startswith("!")
        out = F.when(path.rlike(glob_regex(p[1:] if keep else p)), F.lit(not keep)).otherwise(out)
    return path.rlike(always) | out


def clean_list(work: DataFrame, tracked: DataFrame, ignored: list[str], excluded: list[str]) -> DataFrame:
    """Untracked paths that are neither ignored nor excluded."""
    return work.join(tracked.select(*KEY), KEY, "left_anti").where(~is_ignored(F.col("path"), ignored) & ~matches_any(F.col("path"), excluded)).select(*KEY)


def directories(tree: DataFrame) -> DataFrame:
    """(group, dir, parent, n_files, size): every directory with the files below it."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    rows = tree.where(F.col("path").contains("/")).select(*GROUP, "size", F.explode(up).alias("dir"))
    return rows.groupBy(*GROUP, "dir").agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).withColumn("parent", F.regexp_extract("dir", "^(.*)/[^/]*$", 1))


def children(tree: DataFrame) -> DataFrame:
    """(group, dir, name, is_dir): what every directory lists (``""``: the root), without ``.`` and ``..``."""
    parts = F.split("path", "/")
    level = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i - 1), "/").alias("dir"), F.element_at(parts, i).alias("name"), (i < F.size(parts)).alias("is_dir")))
    return tree.select(*GROUP, F.explode(level).alias("l")).select(*GROUP, "l.dir", "l.name", "l.is_dir").distinct()


def lookup(paths: DataFrame, tree: DataFrame) -> DataFrame:
    """(group, path, kind): whether each of ``paths`` (group, path) is a file, a directory or none in its tree."""
    dirs = directories(tree).select(*GROUP, F.col("dir").alias("path"), F.lit(True).alias("is_dir"))
    found = paths.select(*KEY).distinct().join(tree.select(*KEY, F.lit(True).alias("is_file")).distinct(), KEY, "left").join(dirs, KEY, "left")
    return found.select(*KEY, F.when(F.col("is_file"), "file").when(F.col("is_dir"), "directory").otherwise("none").alias("kind"))


def merge_lines(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Positional three-way merge of texts (key, idx, line): (key, idx, line, conflict).  A line that a side lacks is empty."""
    side = lambda df, n: df.select("key", "idx", F.col("line").alias(n))
    rows = side(base, "b").join(side(ours, "o"), ["key", "idx"], "full").join(side(theirs, "t"), ["key", "idx"], "full").fillna("", ["b", "o", "t"])
    line = F.when(F.col("o") == F.col("t"), F.col("o")).when(F.col("b") == F.col("o"), F.col("t")).when(F.col("b") == F.col("t"), F.col("o"))
    marked = F.concat(F.lit("<<<<<<< ours\n"), "o", F.lit("\n=======\n"), "t", F.lit("\n>>>>>>> theirs"))
    return rows.select("key", "idx", F.coalesce(line, marked).alias("line"), line.isNull().alias("conflict"))
