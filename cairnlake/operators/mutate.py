"""Commands that change a repository, as functions from trees to trees: nothing is changed in place.

A tree is a DataFrame with group columns (repo, branch), ``path`` and ``content_hash``, as in :mod:`cairnlake.operators.trees`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.operators.trees import KEY, _side, _there, merged_tree, three_way


def _tree(df: DataFrame) -> DataFrame:
    return df.select(*KEY, "content_hash")


def commit_tree(head: DataFrame, staged: DataFrame) -> DataFrame:
    """The tree of a new commit: ``staged`` (group, path, content_hash, deleted) laid over ``head``; a staged deletion takes
    the path away, and one of what isn't there changes nothing."""
    kept = _tree(head).join(staged.select(*KEY), KEY, "left_anti")
    return kept.unionByName(_tree(staged.where(~F.coalesce("deleted", F.lit(False)))))


def stage(index: DataFrame, head: DataFrame) -> DataFrame:
    """What is staged when ``index`` differs from ``head``: (group, path, content_hash, deleted)."""
    both = _side(head, "h").join(_side(index, "i"), KEY, "full")
    changed = both.where(~(_there("h") & _there("i") & F.col("h_content_hash").eqNullSafe(F.col("i_content_hash"))))
    return changed.select(*KEY, F.col("i_content_hash").alias("content_hash"), (~_there("i")).alias("deleted"))


def checkout(old: DataFrame, new: DataFrame, work: DataFrame) -> DataFrame:
    """(group, path, action) of moving the working tree from commit ``old`` to ``new``: write, delete, or conflict where the
    working tree differs from both; paths that need nothing are left out."""
    all3 = _side(old, "o").join(_side(new, "n"), KEY, "full").join(_side(work, "w"), KEY, "full")
    same = lambda a, b: (_there(a) == _there(b)) & F.col(f"{a}_content_hash").eqNullSafe(F.col(f"{b}_content_hash"))
    action = F.when(same("o", "n") | same("w", "n"), None).when(~same("w", "o"), "conflict").when(_there("n"), "write").otherwise("delete")
    return all3.select(*KEY, action.alias("action")).where("action is not null")


def reset(mode: str, target: DataFrame, index: DataFrame, work: DataFrame) -> dict[str, DataFrame]:
    """The trees after a reset to ``target``: soft moves HEAD only, mixed the index too, hard the working tree as well.
    Untracked files survive a hard reset."""
    if mode not in ("soft", "mixed", "hard"):
        raise ValueError(f"no reset is called {mode}")
    head = _tree(target)
    untracked = _tree(work).join(index.select(*KEY), KEY, "left_anti").join(target.select(*KEY), KEY, "left_anti")
    return {"head": head, "index": head if mode != "soft" else _tree(index), "work": head.unionByName(untracked) if mode == "hard" else _tree(work)}


def restore(work: DataFrame, source: DataFrame, wanted: DataFrame) -> DataFrame:
    """The working tree with the paths ``wanted`` (group, path) as they are in ``source``; those that the source lacks stay."""
    back = _tree(source).join(wanted.select(*KEY).distinct(), KEY, "left_semi")
    return _tree(work).join(back.select(*KEY), KEY, "left_anti").unionByName(back)


def stash(head: DataFrame, work: DataFrame) -> DataFrame:
    """(group, path, base_hash, content_hash, kind): the changes (A, M, D) that are put aside; the working tree is ``head`` then."""
    both = _side(head, "h").join(_side(work, "w"), KEY, "full")
    kind = F.when(~_there("h"), "A").when(~_there("w"), "D").when(~F.col("h_content_hash").eqNullSafe(F.col("w_content_hash")), "M")
    return both.select(*KEY, F.col("h_content_hash").alias("base_hash"), F.col("w_content_hash").alias("content_hash"), kind.alias("kind")).where("kind is not null")


def stash_apply(entry: DataFrame, work: DataFrame) -> DataFrame:
    """(group, path, outcome, content_hash) of laying a stash over another working tree: applied, deleted, kept (no change
    there), or conflict where that tree has neither the stash's base nor its result."""
    rows = entry.select(*KEY, F.lit(True).alias("in_e"), "kind", "base_hash", F.col("content_hash").alias("new_hash")).join(_side(work, "w"), KEY, "full")
    was = F.when(F.col("kind") == "A", ~_there("w")).otherwise(_there("w") & F.col("w_content_hash").eqNullSafe(F.col("base_hash")))
    done = F.when(F.col("kind") == "D", ~_there("w")).otherwise(_there("w") & F.col("w_content_hash").eqNullSafe(F.col("new_hash")))
    outcome = F.when(F.col("in_e").isNull(), "kept").when(done | (was & (F.col("kind") != "D")), "applied").when(was, "deleted").otherwise("conflict")
    content = F.when(F.col("outcome") == "applied", F.col("new_hash")).when(F.col("outcome") == "kept", F.col("w_content_hash"))
    done_before = (F.col("outcome") == "applied") & (F.col("kind") == "D")
    rows = rows.withColumn("outcome", outcome).withColumn("outcome", F.when(done_before, "deleted").otherwise(F.col("outcome")))
    return rows.select(*KEY, "outcome", content.alias("content_hash"))


def replay(parent: DataFrame, commit: DataFrame, onto: DataFrame) -> DataFrame:
    """The tree of a commit replayed on ``onto`` (cherry-pick; a rebase does it commit by commit), without its conflicts."""
    return merged_tree(three_way(parent, onto, commit))


def update_refs(refs: DataFrame, changes: DataFrame) -> DataFrame:
    """(name, hash, outcome) after ``changes`` (name, action, hash): create, move or delete.

    ``outcome`` is unchanged, created, moved, deleted (hash null), or refused: creating what is there, moving or deleting what
    isn't.  Of several changes of one ref the first by action name counts.
    """
    one = changes.groupBy("name").agg(F.min(F.struct("action", "hash")).alias("c")).select("name", "c.action", F.col("c.hash").alias("new"))
    both = refs.select("name", "hash", F.lit(True).alias("there")).join(one, "name", "full")
    there, action = F.col("there").isNotNull(), F.col("action")
    outcome = F.when(action.isNull(), "unchanged").when((action == "create") & ~there, "created").when((action == "move") & there, "moved").when((action == "delete") & there, "deleted").otherwise("refused")
    rows = both.withColumn("outcome", outcome)
    return rows.select("name", F.when(F.col("outcome").isin("created", "moved"), F.col("new")).when(F.col("outcome") != "deleted", F.col("hash")).alias("hash"), "outcome")
