"""Far too many small files: consolidate them into few well-sized ones.

1. The files are listed once into a frozen manifest (id, key, digest, size) in the shared folder.
2. Files holding the same record - equal key and data - are reduced to the one with the least id.
3. Bins are planned first-fit decreasing.  Sizes are rounded up to classes that grow by a thirty-second, so the plan is
   made on a histogram of some 500 counts whatever the number of files; a file's bin follows from its rank in its class.
4. Each bin is written by one task into one file; a folder holds the files of 10,000 bins.
5. Row counts and checksums of what was written are compared with the plan, bin by bin, and with what the listing says
   of the records, which knows nothing of the plan.
6. A commit file that names all files is created last, in one step.  Readers go by it (:func:`read_compacted`), so they
   see all of the files or none.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnlake.functions.keys import norm_hash
from cairnlake.operators.ranks import parts_for, running
from cairnlake.session import delete, drop, shared_dir, staged

TARGET_BYTES = 256 << 20
#: Bytes that a record takes beside its data: key and id.
OVERHEAD = 72
#: Bins, and so files, in one folder; also the most tasks that write.
BINS_A_FOLDER = 10_000
COMMIT = "_committed"
#: Where the size classes begin, in bytes, and how they grow.
_LEAST, _GROWTH = 64, 33 / 32
_KEY = 1 << 44


class VerificationError(RuntimeError):
    """What was written differs from the manifest."""


def size_classes(target: int) -> list[int]:
    """The greatest size of each class, class 0 having none; the last class ends at ``target``."""
    n = max(0, math.ceil(math.log(target / _LEAST) / math.log(_GROWTH))) if target > _LEAST else 0
    return [0, *[min(target, int(_LEAST * _GROWTH**k) + 2) for k in range(n)], target]


def class_of(weight: Column, target: int) -> Column:
    """The size class of a weight in bytes; one more than there are above ``target``."""
    last = len(size_classes(target)) - 1
    k = F.ceil(F.ln(F.greatest(weight, F.lit(1)) / float(_LEAST)) / math.log(_GROWTH))
    return F.when(weight > target, last + 1).otherwise(F.least(F.greatest(k, F.lit(0)) + 1, F.lit(last)))


@dataclass
class BinPlan:
    """Where the files of each size class go."""

    target: int
    n_bins: int
    classes: list[tuple[int, int, int, int, int]]  # class, first rank, files, first bin, files a bin


def plan_bins(histogram: np.ndarray, target: int, units: int, sizes: Sequence[int] | None = None) -> BinPlan:
    """First-fit decreasing on a histogram: ``histogram[c]`` files of ``sizes[c]`` (c, if not given) for classes 1 to ``units``;
    ``units + 1`` is anything above the target."""
    sizes = list(range(units + 1)) if sizes is None else sizes
    capacity = sizes[units]
    left = [int(x) for x in histogram]
    rows, n_bins = [], 0
    groups: list[list[int]] = []  # first bin, bins, room; in the order the bins were opened
    used = [0] * len(left)

    def place(c: int, n: int, first: int, each: int) -> None:
        rows.append((c, used[c], n, first, each))
        used[c] += n
        left[c] -= n

    for c in range(len(left) - 1, 0, -1):
        if c > units:  # larger than a file should be: alone
            if left[c]:
                n_bins += (n := left[c])
                place(c, n, n_bins - n, 1)
            continue
        k = 0
        while left[c] and k < len(groups):
            first, n, room = groups[k]
            each = room // sizes[c]
            if not each:
                k += 1
                continue
            full = min(n, left[c] // each)
            split = []
            if full:
                place(c, full * each, first, each)
                split.append([first, full, room - each * sizes[c]])
            if full < n:
                some = left[c]
                if some:
                    place(c, some, first + full, each)
                    split.append([first + full, 1, room - some * sizes[c]])
                    full += 1
                if full < n:
                    split.append([first + full, n - full, room])
            groups[k : k + 1] = split
            k += 1
        if left[c]:
            each = capacity // sizes[c]
            full, rest = divmod(left[c], each)
            if full:
                place(c, full * each, n_bins, each)
                groups.append([n_bins, full, capacity - each * sizes[c]])
                n_bins += full
            if rest:
                place(c, rest, n_bins, rest)
                groups.append([n_bins, 1, capacity - rest * sizes[c]])
                n_bins += 1
    return BinPlan(target, n_bins, rows)


def _to_bins(plan: BinPlan):
    """(size_class, rank, ...) -> (..., bin)."""
    by_class = np.array(sorted(plan.classes), np.int64).reshape(-1, 5)
    keys = by_class[:, 0] * _KEY + by_class[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size_class, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            k = np.searchsorted(keys, size_class * _KEY + rank, "right") - 1
            bins = by_class[k, 3] + (rank - by_class[k, 1]) // by_class[k, 4]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(bins)], [*batch.schema.names[2:], "bin"])

    return run


def _check(*of: Column) -> Column:
    """A checksum of a record that can be added up."""
    return F.pmod(F.xxhash64(*of), F.lit((1 << 40) - 1))


_RECORD = ["file_id", "key", "digest"]


@dataclass
class Compaction:
    """A planned, and perhaps committed, compaction.

    ``manifest`` and ``assigned`` have (file_id, key, digest, n) of what was listed and of what is kept, the latter with ``bin``.
    """

    source: DataFrame
    manifest: DataFrame
    assigned: DataFrame
    target: int
    path: str | None = None

    @property
    def duplicates(self) -> DataFrame:
        """(file_id) of the listed files whose record another file with a smaller id holds."""
        whole = self.manifest.where("key is not null and digest is not null")
        return whole.join(self.assigned.select(*_RECORD), _RECORD, "left_anti").select("file_id").distinct()

    def files(self) -> DataFrame:
        """(bin, n_records, n_bytes) of the written files."""
        written = read_compacted(self.source.sparkSession, self.path)
        return written.groupBy("bin").agg(F.count(F.lit(1)).alias("n_records"), F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("n_bytes"))

    def discard(self) -> None:
        """Delete what was written at ``path``; the plan stays."""
        delete(self.source.sparkSession, self.path)


def plan_compaction(files: DataFrame, target_bytes: int = TARGET_BYTES) -> Compaction:
    """Freeze the list of ``files`` (file_id, hash, data) and plan the bins.

    A record is a hash in normal form with its data.  Files without hash or data are records of their own.  A listed row
    that comes twice is one file; rows that share a file_id but differ in hash or data are different files.  Extra
    columns are not carried over; an empty list gives an empty plan.
    """
    digest = F.sha2("data", 256)
    listed = files.select("file_id", norm_hash(F.col("hash")).alias("key"), digest.alias("digest"), F.octet_length("data").cast("long").alias("n"))
    manifest = staged(listed.distinct(), "manifest")
    whole = F.col("key").isNotNull() & F.col("digest").isNotNull()
    keepers = manifest.where(whole).groupBy("key", "digest").agg(F.min("file_id").alias("file_id"), F.max("n").alias("n"))
    kept = keepers.unionByName(manifest.where(~whole))
    sizes = size_classes(target_bytes)
    units = len(sizes) - 1
    weight = F.coalesce(F.col("n"), F.lit(0)) + F.lit(OVERHEAD)
    sized = staged(kept.select(class_of(weight, target_bytes).cast("long").alias("size_class"), *_RECORD, "n"), "kept")
    histogram = np.zeros(units + 2, np.int64)
    for row in sized.groupBy("size_class").agg(F.count(F.lit(1)).alias("n")).collect():  # a row a class
        histogram[row["size_class"]] = row["n"]
    plan = plan_bins(histogram, target_bytes, units, sizes)
    ranked = running(sized, ["size_class"], "file_id", parts_for(int(histogram.sum())))
    schema = T.StructType([*(sized.schema[c] for c in (*_RECORD, "n")), T.StructField("bin", T.LongType())])
    assigned = ranked.select("size_class", "rank", *_RECORD, "n").mapInArrow(_to_bins(plan), schema)
    done = Compaction(files, manifest, staged(assigned, "assigned"), target_bytes)
    drop(sized)
    return done


def compact(files: DataFrame, path: str | None = None, target_bytes: int = TARGET_BYTES) -> Compaction:
    """Plan, rewrite, verify and commit; the files lie below ``path`` (new; in the shared folder if not given).  Runs jobs.

    Raises :class:`VerificationError`, leaving nothing at ``path``, if a count or checksum is not that of the plan or of
    the listing, and ``FileExistsError`` if something lies at ``path``.
    """
    spark = files.sparkSession
    path = path or f"{shared_dir(spark)}/compacted-{uuid.uuid4().hex}"
    fs, at = _file_system(spark, path)
    if fs.exists(at):
        raise FileExistsError(f"{path} is there already")
    done = plan_compaction(files, target_bytes)
    data = f"{path}/files-{uuid.uuid4().hex}"
    try:
        _write(done, data)
        _verify(done, data)
        _commit(spark, path, data)
    except BaseException:
        delete(spark, path)
        raise
    done.path = path
    return done


def _write(done: Compaction, data: str) -> None:
    """One file a bin."""
    last = done.assigned.agg(F.max("bin")).first()[0]
    writers = min(BINS_A_FOLDER, (last or 0) + 1)
    rows = done.source.select("file_id", norm_hash(F.col("hash")).alias("hash"), "data").withColumn("digest", F.sha2("data", 256))
    plan = done.assigned.select(*[F.col(c).alias(f"_{c}") for c in _RECORD], "bin")
    same = [rows[a].eqNullSafe(plan[b]) for a, b in (("file_id", "_file_id"), ("hash", "_key"), ("digest", "_digest"))]
    placed = rows.join(plan, same).select("file_id", "hash", "data", "digest", "bin").repartitionById(writers, F.pmod("bin", F.lit(writers)).cast("int"))
    ordered = placed.sortWithinPartitions("bin", "file_id", "hash", "digest").withColumn("folder", F.floor(F.col("bin") / BINS_A_FOLDER))
    schema = T.StructType([f for f in ordered.schema if f.name != "digest"])
    ordered.mapInArrow(_once, schema).write.partitionBy("folder").parquet(data)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first of the neighbouring rows with one bin, file, hash and digest: a row that was listed twice is written once."""
    last = None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("bin", "file_id", "hash", "digest")), strict=True))
        keep = [k != p for k, p in zip(keys, [last, *keys[:-1]], strict=True)]
        last = keys[-1] if keys else last
        out = batch.filter(pa.array(keep, pa.bool_())) if not all(keep) else batch
        yield out.drop_columns(["digest"])


def _read(spark: SparkSession, data: str, id_type: T.DataType) -> DataFrame:
    schema = T.StructType([T.StructField("file_id", id_type), *[T.StructField(n, t) for n, t in (("hash", T.StringType()), ("data", T.BinaryType()), ("bin", T.LongType()), ("folder", T.LongType()))]])
    return spark.read.schema(schema).parquet(data)


def _verify(done: Compaction, data: str) -> None:
    """Compare what lies in ``data`` with the plan, bin by bin, and with the listing, as a whole."""
    spark = done.source.sparkSession
    digest = F.sha2("data", 256)
    written = _read(spark, data, done.manifest.schema["file_id"].dataType).select("file_id", F.col("hash").alias("key"), digest.alias("digest"), "bin", F.octet_length("data").cast("long").alias("n"))
    sums = lambda df, p: df.groupBy(F.col("bin").alias(f"{p}bin")).agg(F.count(F.lit(1)).alias(f"{p}rows"), F.sum(_check(*map(F.col, _RECORD))).alias(f"{p}sum"), F.sum("n").alias(f"{p}bytes"), F.sum(_check(F.col("key"), F.col("digest"))).alias(f"{p}records"))
    plan, got = sums(done.assigned, "p"), sums(written, "w")
    same = [F.col(f"p{c}").eqNullSafe(F.col(f"w{c}")) for c in ("rows", "sum", "bytes")]
    both = plan.join(got, plan["pbin"] == got["wbin"], "full").agg(
        F.min(F.when(~(same[0] & same[1] & same[2]), F.coalesce("pbin", "wbin"))).alias("wrong"), F.coalesce(F.sum("wrows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("wrecords"), F.lit(0)).alias("records")
    ).first()
    if both["wrong"] is not None:
        raise VerificationError(f"bin {both['wrong']} was not written as planned")
    whole = F.col("key").isNotNull() & F.col("digest").isNotNull()
    record = F.when(whole, F.struct("key", "digest", F.lit(None).cast("string").alias("file_id"))).otherwise(F.struct("key", "digest", F.col("file_id").cast("string").alias("file_id")))
    listed = done.manifest.select(record.alias("r")).distinct().agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(_check(F.col("r.key"), F.col("r.digest"))), F.lit(0)).alias("records")).first()
    if (both["rows"], both["records"]) != (listed["rows"], listed["records"]):
        raise VerificationError(f"{both['rows']} records were written of {listed['rows']} listed ones, or others")


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _commit(spark: SparkSession, path: str, data: str) -> None:
    """Create the commit file, which names the folder and all files (one a bin) with their sizes."""
    fs, at = _file_system(spark, data)
    found, files = fs.listFiles(at, True), []
    while found.hasNext():
        f = found.next()
        name = f.getPath().toString().split(data.rstrip("/").rsplit("/", 1)[1] + "/", 1)[1]
        if not name.rsplit("/", 1)[-1].startswith(("_", ".")):
            files.append({"name": name, "bytes": f.getLen()})
    text = json.dumps({"data": data.rstrip("/").rsplit("/", 1)[1], "files": sorted(files, key=lambda f: f["name"])})
    fs, at = _file_system(spark, f"{path}/{COMMIT}")
    out = fs.create(at, False)  # fails if it is there
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_compacted(spark: SparkSession, path: str) -> DataFrame:
    """The records (file_id, hash, data, bin) of a committed compaction; raises ``FileNotFoundError`` without commit file."""
    fs, at = _file_system(spark, f"{path}/{COMMIT}")
    if not fs.exists(at):
        raise FileNotFoundError(f"nothing was committed at {path}")
    stream = fs.open(at)
    try:
        named = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    if not named["files"]:
        return spark.createDataFrame([], "file_id long, hash string, data binary, bin long")
    base = f"{path}/{named['data']}"
    return spark.read.option("basePath", base).parquet(*[f"{base}/{f['name']}" for f in named["files"]]).drop("folder")
