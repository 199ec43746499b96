"""Deduplication, chunk and object statistics.  All functions are lazy: DataFrame in, DataFrame out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.functions.keys import norm_hash


def share(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """part / whole, ``empty`` if the whole is 0 or null."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(empty))


def file_stats(entries: DataFrame) -> DataFrame:
    """Per path: size, number of chunks, their hashes in order, and whether it is a media container."""
    hashes = F.coalesce(F.array_join(F.transform("chunks", lambda c: norm_hash(c["hash"])), ","), F.lit(""))
    return entries.select("repo", "branch", "path", "size", F.coalesce(F.size("chunks"), F.lit(0)).alias("chunk_count"), hashes.alias("hashes"), F.coalesce(F.lower("path").rlike(r"\.(mp4|mov|m4v)$"), F.lit(False)).alias("is_mp4"))


def dedup_stats(refs: DataFrame) -> DataFrame:
    """One row: logical and physical bytes, saved bytes, physical/logical ratio (1 if nothing is stored)."""
    each = refs.groupBy("chunk_hash").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("logical"), F.max("size").alias("physical"))
    one = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_refs"), F.count("chunk_hash").alias("unique_chunks"), F.coalesce(F.sum("logical"), F.lit(0)).alias("logical"), F.coalesce(F.sum("physical"), F.lit(0)).alias("physical"))
    return one.withColumns({"saved": F.greatest(F.col("logical") - F.col("physical"), F.lit(0)), "ratio": share(F.col("physical"), F.col("logical"), 1.0)})


def usage_counts(refs: DataFrame, within: list[str]) -> DataFrame:
    """Each reference with how often its chunk is referenced ``within`` a group: counted once a chunk, joined back."""
    keys = [*within, "chunk_hash"]
    return refs.join(refs.groupBy(*keys).agg(F.count(F.lit(1)).alias("usage")), keys)


def file_dedup_stats(refs: DataFrame) -> DataFrame:
    """Per file: shared (used more than once in the snapshot) and unique chunks and bytes, shares in percent."""
    used = usage_counts(refs, ["repo", "branch"])
    shared = F.col("usage") > 1
    out = used.groupBy("repo", "branch", "path").agg(F.count(F.lit(1)).alias("chunk_count"), F.count_if(shared).alias("shared_chunks"), F.count_if(~shared).alias("unique_chunks"), F.coalesce(F.sum(F.when(~shared, F.col("size"))), F.lit(0)).alias("unique_bytes"))
    return out.withColumns({"shared_pct": 100 * share(F.col("shared_chunks"), F.col("chunk_count")), "unique_pct": 100 * share(F.col("unique_chunks"), F.col("chunk_count"))})


def first_occurrences(refs: DataFrame, order: list[str]) -> DataFrame:
    """Each reference with ``was_new``: whether it is the first of its chunk in the given order (a least struct a chunk,
    so a hot chunk is reduced before the shuffle)."""
    first = refs.groupBy("chunk_hash").agg(F.min(F.struct(*order)).alias("first"))
    return refs.join(first, "chunk_hash").select(*refs.columns, (F.struct(*order) == F.col("first")).alias("was_new"))


def add_result(refs: DataFrame, order: list[str]) -> DataFrame:
    """One row: new and repeated chunks and bytes; ratio (new + repeated) / new bytes, null if nothing is new."""
    new = F.col("was_new")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("size"))), F.lit(0))
    out = first_occurrences(refs, order).agg(F.count_if(new).alias("new_chunks"), F.count_if(~new).alias("dedup_chunks"), total(new).alias("new_bytes"), total(~new).alias("dedup_bytes"))
    return out.withColumn("dedup_ratio", F.try_divide((F.col("new_bytes") + F.col("dedup_bytes")).cast("double"), F.col("new_bytes").cast("double")))


def chunk_stats(refs: DataFrame) -> DataFrame:
    """One row: references, distinct chunks, bytes of both, mean, least and greatest size, total/dedup ratio."""
    each = refs.groupBy("chunk_hash").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"), F.min("size").alias("lo"), F.max("size").alias("hi"))
    out = each.agg(F.sum("n").alias("total_chunks"), F.count(F.lit(1)).alias("unique_chunks"), F.sum("s").alias("total_size"), F.sum("hi").alias("dedup_size"), F.min("lo").alias("min_size"), F.max("hi").alias("max_size"))
    return out.withColumns({"avg_size": F.try_divide(F.col("total_size").cast("double"), F.col("total_chunks")), "dedup_ratio": share(F.col("total_size"), F.col("dedup_size"), 1.0)})


def compression_ratios(chunks: DataFrame) -> DataFrame:
    """Per compression: chunks, stored and original bytes, stored/original (1 if the original size is 0)."""
    known = chunks.where("original_size is not null and size is not null")
    out = known.groupBy(F.coalesce("compression", F.lit("none")).alias("compression")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("stored"), F.sum("original_size").alias("original"))
    return out.withColumn("ratio", share(F.col("stored"), F.col("original"), 1.0))


def manifest_totals(entries: DataFrame) -> DataFrame:
    """Per snapshot: bytes, chunk references and distinct chunks."""
    whole = entries.groupBy("repo", "branch").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"), F.sum(F.coalesce(F.size("chunks"), F.lit(0))).cast("long").alias("total_chunks"))
    each = entries.select("repo", "branch", F.explode("chunks").alias("c")).select("repo", "branch", norm_hash(F.col("c.hash")).alias("h")).where("h is not null").distinct()
    n = each.groupBy("repo", "branch").agg(F.count(F.lit(1)).alias("distinct_chunks"))
    return whole.join(n, ["repo", "branch"], "left").select("repo", "branch", "total_size", "total_chunks", F.coalesce("distinct_chunks", F.lit(0)).alias("distinct_chunks"))


def chunk_offsets(refs: DataFrame) -> DataFrame:
    """Offset of each chunk in its file: the running sum of the sizes before it."""
    w = Window.partitionBy("repo", "branch", "path").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return refs.select("repo", "branch", "path", "idx", "chunk_hash", "size", F.coalesce(F.sum("size").over(w), F.lit(0)).alias("start"))


def chunks_for_range(refs: DataFrame, offset: int, size: int) -> DataFrame:
    """The chunks that a read of ``size`` bytes at ``offset`` touches, and which part of each: (start, length)."""
    o = chunk_offsets(refs)
    end = F.col("start") + F.col("size")
    return o.where((end > offset) & (F.col("start") < offset + size)).select(
        "repo", "branch", "path", "idx", "chunk_hash", F.greatest(F.lit(offset) - F.col("start"), F.lit(0)).alias("read_start"), (F.least(end, F.lit(offset + size)) - F.greatest(F.col("start"), F.lit(offset))).alias("read_len")
    )


def reference_counts(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per stored chunk: the count kept with it, the references there are, and their difference."""
    real = refs.groupBy(F.col("chunk_hash").alias("hash")).agg(F.count(F.lit(1)).alias("n"))
    out = chunks.select("hash", "ref_count").join(real, "hash", "left").select("hash", "ref_count", F.coalesce("n", F.lit(0)).alias("real_count"))
    return out.withColumn("off_by", F.col("ref_count") - F.col("real_count"))


def decrement(chunks: DataFrame, by: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Lower reference counts by the rows of ``by`` (hash), not below 0; a count of 0 sets the time of deletion."""
    n = by.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    left = F.greatest(F.col("ref_count") - F.col("n"), F.lit(0))
    return chunks.select("hash", "ref_count").join(n, "hash").select("hash", left.alias("ref_count"), F.when(left == 0, as_of + F.expr(f"INTERVAL {days} DAYS")).alias("delete_after"))


def have_want(wanted: DataFrame, there: DataFrame) -> DataFrame:
    """Each wanted hash, once, and whether it is there."""
    have = there.select("hash").distinct().withColumn("here", F.lit(True))
    return wanted.select("hash").distinct().join(have, "hash", "left").select("hash", F.coalesce("here", F.lit(False)).alias("exists"))


def missing(wanted: DataFrame, there: DataFrame) -> DataFrame:
    """The wanted hashes that are not there: what a transfer has to send."""
    return wanted.select("hash").distinct().join(there.select("hash"), "hash", "left_anti")


def put_if_absent(store: DataFrame, new: DataFrame, key: str = "hash") -> DataFrame:
    """The store with the new rows whose key it lacks (one row a key); nothing is changed in place."""
    return store.unionByName(new.dropDuplicates([key]).join(store.select(key), key, "left_anti").select(*store.columns))


def storage_usage(chunks: DataFrame) -> DataFrame:
    """Per day of creation: chunks, bytes, bytes by tier, compressed and not."""
    tiers = [F.coalesce(F.sum(F.when(F.col("tier") == t, F.col("size"))), F.lit(0)).alias(f"{t}_bytes") for t in ("hot", "warm", "cold")]
    packed = F.coalesce(F.col("compression"), F.lit("none")) != "none"
    return chunks.groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("n_chunks"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"), *tiers, F.coalesce(F.sum(F.when(packed, F.col("size"))), F.lit(0)).alias("compressed_bytes"), F.coalesce(F.sum(F.when(~packed, F.col("size"))), F.lit(0)).alias("plain_bytes"))


def largest(rows: DataFrame, group: list[str], size: str, tie: str, k: int) -> DataFrame:
    """The k largest rows of each group (ties: the lesser ``tie``), with their rank; the planner cuts groups map-side."""
    w = Window.partitionBy(*group).orderBy(F.desc_nulls_last(size), tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fixed_blocks(rows: DataFrame, text: str, size: int) -> DataFrame:
    """Cut a text column into blocks of ``size`` characters: (all other columns, idx, block); empty texts have none."""
    n = F.ceil(F.length(text) / size).cast("int")
    cut = rows.where(F.length(text) > 0).withColumn("_at", F.explode(F.sequence(F.lit(0), n - 1)))
    return cut.select(*[c for c in rows.columns if c != text], F.col("_at").alias("idx"), F.substring(text, F.col("_at") * size + 1, F.lit(size)).alias("block"))


def lines(rows: DataFrame, text: str) -> DataFrame:
    """Cut a text column at line feeds: (all other columns, idx, line)."""
    return rows.where(F.col(text).isNotNull()).select(*[c for c in rows.columns if c != text], F.posexplode(F.split(text, "\n", -1)).alias("idx", "line"))


def reassembled(blocks: DataFrame, key: str, text: str) -> DataFrame:
    """Put blocks together in order, with the hash of the whole: (key, size, content_hash)."""
    whole = blocks.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", text))), lambda b: b[text]), "").alias("w"))
    return whole.select(key, F.octet_length("w").cast("long").alias("size"), F.sha2("w", 256).alias("content_hash"))
