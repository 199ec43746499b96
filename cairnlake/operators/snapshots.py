"""What changed between full snapshots.

Every snapshot row is tagged with the comparisons that it takes part in - as the later side of one and as the earlier
side of the next - and one aggregation by (comparison, path) classifies the change.  There is no join of snapshots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.functions.keys import norm_hash, norm_path
from cairnlake.session import broadcast_if_small


def snapshot_pairs(manifests: DataFrame) -> DataFrame:
    """``(manifest, repo, branch, seq, later_seq)``: each snapshot once as the later side (``later_seq`` null on the
    first of its branch, which has no comparison) together with the ``seq`` of the snapshot that follows it, if any.

    Copies count once; rows without manifest or seq are no snapshot.  Two snapshots with one seq follow each other in
    the order of taken_at and hash.
    """
    one = manifests.select("manifest", "repo", "branch", "seq", "taken_at").where("manifest is not null and seq is not null").distinct()
    w = Window.partitionBy("repo", "branch").orderBy("seq", "taken_at", "manifest")
    return one.select(
        "manifest",
        "repo",
        "branch",
        F.when(F.lag("manifest").over(w).isNotNull(), F.col("seq")).alias("own_seq"),
        F.lead("manifest").over(w).alias("next_manifest"),
        F.lead("seq").over(w).alias("next_seq"),
    )


def snapshot_changes(manifests: DataFrame, entries: DataFrame, max_broadcast_rows: int = 200_000) -> DataFrame:
    """``(repo, branch, seq, path, change_kind, old_hash, new_hash)`` for consecutive snapshots of each branch.

    ``change_kind`` is ``added``, ``removed`` or ``changed``; paths and hashes are compared in normal form, a null hash
    equals null only.  If a path comes more than once in a snapshot the row recorded last holds (ties: the greatest
    entry_id, then hash).  Entries without path or snapshot are ignored; an empty snapshot removes everything.
    """
    pairs = snapshot_pairs(manifests)
    sides = pairs.select(
        "manifest",
        "repo",
        "branch",
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.col("manifest").alias("later"), F.col("own_seq").alias("seq"), F.lit(True).alias("is_new")),
                    F.struct(F.col("next_manifest").alias("later"), F.col("next_seq").alias("seq"), F.lit(False).alias("is_new")),
                ),
                lambda s: s["seq"].isNotNull(),
            )
        ).alias("side"),
    ).select("manifest", "repo", "branch", "side.*")
    rows = entries.select(
        "manifest",
        norm_path(F.col("path")).alias("path"),
        F.struct("recorded_at", "entry_id", norm_hash(F.col("content_hash")).alias("h")).alias("row"),
    ).where(F.col("path").isNotNull())
    tagged = rows.join(broadcast_if_small(sides, max_broadcast_rows), "manifest")
    both = tagged.groupBy("repo", "branch", "seq", "later", "path").agg(
        F.max(F.when(F.col("is_new"), F.col("row"))).alias("new"), F.max(F.when(~F.col("is_new"), F.col("row"))).alias("old")
    )
    return (
        both.withColumn(
            "change_kind",
            F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("new.h").eqNullSafe(F.col("old.h")), "changed"),
        )
        .where(F.col("change_kind").isNotNull())
        .select("repo", "branch", "seq", "path", "change_kind", F.col("old.h").alias("old_hash"), F.col("new.h").alias("new_hash"))
    )
