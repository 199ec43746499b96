"""Readers of a repository's files, and sinks.

Readers give relations; what can't be parsed is left out, as the tools that write these files do.  Sinks write to a folder
of any file system that Spark knows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.functions.keys import norm_hash
from cairnlake.operators.trees import is_ignored

#: The number of events that an audit log keeps.
AUDIT_KEPT = 10_000
AUDIT_SCHEMA = "id long, ts timestamp_ntz, event_type string, outcome string, resource string, user_id long, value double"
#: Times are written to the microsecond.
WRITE_OPTIONS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
ACCESS_SCHEMA = "hash string, size long, tier string, created_at timestamp_ntz, last_accessed timestamp_ntz, access_count long, is_proxy boolean, is_manifest boolean"
LOCK_SCHEMA = "owner string, acquired_at timestamp_ntz, expires_at timestamp_ntz, reason string"


def scan_worktree(spark: SparkSession, path: str, ignored: list[str] = (), with_hash: bool = True) -> DataFrame:
    """(path, size, modified_at, content_hash) of every file below a folder, without the ignored ones; only hashing reads data."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = path.removeprefix("file://").rstrip("/") + "/"
    rows = files.withColumn("path", F.element_at(F.split(F.col("path"), F.lit("\\Q" + root + "\\E"), 2), -1)).where(~is_ignored(F.col("path"), list(ignored)))
    out = rows.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), *([F.sha2("content", 256).alias("content_hash")] if with_hash else []))
    return out


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a log of JSON lines; malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(path)


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, schema..) of a folder in which every file is one JSON document (proxies, metadata, projects); bad ones are skipped."""
    texts = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", schema).alias("doc"))
    names = [f.name for f in texts.schema["doc"].dataType.fields]
    some = F.greatest(*[F.col(f"doc.`{n}`").isNotNull() for n in names]) if len(names) > 1 else F.col(f"doc.`{names[0]}`").isNotNull()
    return texts.where(some).select("file", "doc.*")


def read_access(spark: SparkSession, path: str) -> DataFrame:
    """Access records from files of one JSON array each; of several records of a hash in a file the last holds, a bad file is empty."""
    rows = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.from_json("value", f"array<struct<{_struct(ACCESS_SCHEMA)}>>")).alias("pos", "r"))
    last = rows.where("r.hash is not null").groupBy(F.col("r.hash").alias("h")).agg(F.max_by("r", F.struct("file", "pos")).alias("r"))
    return last.select("r.*")


def read_locks(spark: SparkSession, path: str) -> DataFrame:
    """(path, owner, acquired_at, expires_at, reason) from files that map paths to locks."""
    rows = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string, struct<{_struct(LOCK_SCHEMA)}>>")).alias("path", "lock"))
    return rows.select("path", "lock.*")


def _struct(schema: str) -> str:
    return ", ".join(": ".join(c.strip().split(" ", 1)) for c in schema.split(","))


def new_access_records(objects: DataFrame, records: DataFrame, as_of: Column) -> DataFrame:
    """The access ``records`` and one for each object (hash, size) that has none: hot, accessed once, at ``as_of``."""
    fresh = objects.select("hash", "size").where("hash is not null").dropDuplicates(["hash"]).join(records.select("hash"), "hash", "left_anti")
    fresh = fresh.select("hash", "size", F.lit("hot").alias("tier"), as_of.alias("created_at"), as_of.alias("last_accessed"), F.lit(1).cast("long").alias("access_count"), F.lit(False).alias("is_proxy"), F.lit(False).alias("is_manifest"))
    return records.select(*fresh.columns).unionByName(fresh)


# -- sinks -------------------------------------------------------------------------------------------------------------


def put_if_absent(objects: DataFrame, store: str) -> DataFrame:
    """Store ``objects`` (hash, data) whose hash is not in the store yet; (hash, was_new) of each hash given.  Runs jobs.

    The store is a folder of Parquet tables, one a call.  A hash given twice is stored once (with the least data); null
    hashes are ignored.
    """
    spark = objects.sparkSession
    given = objects.select(norm_hash(F.col("hash")).alias("hash"), "data").where("hash is not null")
    known = stored(spark, store).select("hash").distinct()
    batch = f"{store}/batch={uuid.uuid4().hex}"
    fresh = given.join(known, "hash", "left_anti").groupBy("hash").agg(F.min("data").alias("data"))
    fresh.write.parquet(batch)
    new = spark.read.schema(fresh.schema).parquet(batch).select("hash", F.lit(True).alias("was_new"))
    return given.select("hash").distinct().join(new, "hash", "left").select("hash", F.coalesce("was_new", F.lit(False)).alias("was_new"))


def stored(spark: SparkSession, store: str) -> DataFrame:
    """(hash, data) of a store; empty if nothing was stored yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "hash string, data binary")
    return spark.read.schema("hash string, data binary").option("recursiveFileLookup", True).parquet(store)


def damaged(objects: DataFrame) -> DataFrame:
    """(hash) of the objects (hash, data) whose data has another SHA-256."""
    return objects.where(F.sha2("data", 256) != norm_hash(F.col("hash"))).select("hash").distinct()


def append_audit(events: DataFrame, path: str, keep: int = AUDIT_KEPT) -> None:
    """Append events to an audit log and keep the last ``keep`` of all (by time, then id).

    The log is a folder with a folder a generation; a generation is complete when Spark has marked it so, and the last
    complete one is the log, so readers never see a half-written one.  At most ``keep`` rows are rewritten.
    """
    spark = events.sparkSession
    generation, old = audit_log(spark, path)
    rows = events.select(*old.columns).unionByName(old).orderBy(F.desc("ts"), F.desc("id")).limit(keep)
    rows.write.options(**WRITE_OPTIONS).json(f"{path}/generation-{generation + 1:09d}")


def audit_log(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """The number of the last complete generation of an audit log (-1: none) and its events."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    for name in sorted((n for n in names if n.startswith("generation-")), reverse=True):
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")):
            return int(name.split("-")[1]), read_json_lines(spark, f"{path}/{name}", AUDIT_SCHEMA)
    return -1, spark.createDataFrame([], AUDIT_SCHEMA)


def archive(entries: DataFrame, path: str, prefix: str = "") -> None:
    """Export the entries of a snapshot below a prefix as JSON, a folder a repo."""
    entries.where(F.col("path").startswith(prefix)).write.partitionBy("repo").json(path)
