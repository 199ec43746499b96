"""Integrity checks and mark-and-sweep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.functions.keys import norm_hash


def dangling_parents(commits: DataFrame) -> DataFrame:
    """(hash, parent): parents that are no commits, over all parents."""
    named = F.array_compact(F.concat(F.array("parent"), F.coalesce("parents", F.array().cast("array<string>"))))
    links = commits.select("hash", F.explode(named).alias("parent")).distinct()
    return links.join(commits.select(F.col("hash").alias("parent")), "parent", "left_anti").select("hash", "parent")


def dangling_manifests(commits: DataFrame, manifests: DataFrame) -> DataFrame:
    """(hash, manifest): commits whose manifest isn't there."""
    return commits.select("hash", "manifest").where("manifest is not null").distinct().join(manifests.select("manifest"), "manifest", "left_anti").select("hash", "manifest")


def counts(commits: DataFrame, manifests: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: objects of each kind and dangling parents."""
    one = commits.agg(F.countDistinct("hash").alias("commits"))
    one = one.crossJoin(manifests.agg(F.countDistinct("manifest").alias("manifests"))).crossJoin(chunks.agg(F.count(F.lit(1)).alias("chunks")))  # frames of one row
    return one.crossJoin(dangling_parents(commits).agg(F.count(F.lit(1)).alias("dangling_parents")))


def live_manifests(reached: DataFrame, commits: DataFrame, roots: DataFrame) -> DataFrame:
    """(manifest): those that a reached commit (node) names, and ``roots`` (manifest): mark."""
    live = commits.join(reached.select(F.col("node").alias("hash")).distinct(), "hash", "left_semi").select("manifest").where("manifest is not null")
    return live.unionByName(roots.select("manifest")).distinct()


def unreachable_chunks(entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(hash, size) of stored chunks that none of the ``entries`` of live manifests names: sweep."""
    named = entries.select(F.explode("chunks").alias("c")).select(norm_hash(F.col("c.hash")).alias("hash")).distinct()
    return chunks.select("hash", "size").join(named, "hash", "left_anti")
