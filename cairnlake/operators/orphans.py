"""References to records that do not exist.

The distinct non-null foreign keys, each with the time of its first reference, are anti-joined with the parent keys that
were usable by then (a hot key is one row there).  Only the keys that are left, which have a problem, are joined back to
the references: keys of more than ``HOT_ROWS`` references by broadcast, so that a key holding a third of all rows is
never shuffled, the others by a shuffle in which no key is that large.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.functions.keys import norm_hash
from cairnlake.session import broadcast_if_small, staged

HOT_ROWS = 1_000_000


def references(df: DataFrame, ref_table: str, ref_id: Column, hashes: Column, at: Column) -> DataFrame:
    """``(ref_table, ref_id, target_hash, at)``: each hash that a row names, once a row.

    ``hashes`` is an array of hashes as written; nulls, empty strings and empty or null arrays give no row.
    """
    keys = F.array_compact(F.array_distinct(F.transform(hashes, norm_hash)))
    return df.select(
        F.lit(ref_table).alias("ref_table"), ref_id.cast("long").alias("ref_id"), at.alias("at"), F.explode(keys).alias("target_hash")
    ).select("ref_table", "ref_id", "target_hash", "at")


def orphan_references(refs: DataFrame, parents: DataFrame, always: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The references without a usable parent: ``(ref_table, ref_id, target_hash, ref_state, at)``, each once.

    ``refs`` comes from :func:`references`; ``parents`` has ``hash, created_at, deleted_at`` with any number of rows
    a hash; ``always`` has ``hash`` of parents that can't be missing.  ``ref_state`` is ``missing`` (no parent row),
    ``deleted`` (every parent row is deleted) or ``late`` (every parent row was created after the reference).  A parent
    without creation time counts as always there, a reference without time is never late.  Empty inputs give no rows,
    copies of a reference give one row, other columns of the inputs are ignored.  The keys with a problem are written to
    the shared folder when this is called.
    """
    wanted = refs.groupBy("target_hash").agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("n"))
    state = (
        parents.select(norm_hash(F.col("hash")).alias("key"), "created_at", F.col("deleted_at").isNull().alias("live"))
        .where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(
            F.max("live").alias("live"),
            F.when(F.count("created_at") == F.count(F.lit(1)), F.min("created_at")).alias("born"),
        )
    )
    known = always.select(norm_hash(F.col("hash")).alias("target_hash")).distinct()
    usable = (F.col("target_hash") == F.col("key")) & F.col("live") & ~F.coalesce(F.col("born") > F.col("first_at"), F.lit(False))
    left = wanted.join(known, "target_hash", "left_anti").join(state, usable, "left_anti")
    problems = staged(left.join(state, F.col("target_hash") == F.col("key"), "left").select("target_hash", "n", "live", "born"), "orphan-keys")
    hot, rest = problems.where(F.col("n") > hot_rows).drop("n"), problems.where(F.col("n") <= hot_rows).drop("n")
    if hot.isEmpty():
        found = refs.join(rest, "target_hash")
    else:
        hot = broadcast_if_small(hot)
        found = refs.join(hot, "target_hash").unionByName(refs.join(hot.select("target_hash"), "target_hash", "left_anti").join(rest, "target_hash"))
    return (
        found.withColumn("ref_state", F.when(F.col("live").isNull(), "missing").when(~F.col("live"), "deleted").when(F.col("born") > F.col("at"), "late"))
        .where(F.col("ref_state").isNotNull())
        .select("ref_table", "ref_id", "target_hash", "ref_state", "at")
        .distinct()
    )


def orphan_report(orphans: DataFrame, refs: DataFrame, period: str = "yyyy-MM") -> DataFrame:
    """Per table, period and state: how many references and distinct keys are orphans, and of how many references."""
    total = refs.select("ref_table", F.date_format("at", period).alias("period"), "ref_id", "target_hash").distinct()
    total = total.groupBy("ref_table", "period").agg(F.count(F.lit(1)).alias("n_refs"))
    counts = (
        orphans.groupBy("ref_table", F.date_format("at", period).alias("period"), "ref_state", "target_hash")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("ref_table", "period", "ref_state")
        .agg(F.sum("n").alias("n_orphans"), F.count(F.lit(1)).alias("n_keys"))
    )
    same = (counts["ref_table"] == total["ref_table"]) & counts["period"].eqNullSafe(total["period"])
    return counts.join(total, same).select(counts["ref_table"], counts["period"], "ref_state", "n_orphans", "n_keys", "n_refs")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name of at least one DataFrame."""
    return reduce(DataFrame.unionByName, frames)
