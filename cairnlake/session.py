"""Sessions, shared storage and lineage cuts.

Everything that has to outlive an executor goes to the folder which the cluster names in
``spark.checkpoint.dir``.  Only where that setting is missing on a single machine (tests, a laptop) a temporary folder
is used; a cluster without it is refused, since its executors would each write to a disk of their own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int = 8, app: str = "cairnlake", **conf: str) -> SparkSession:
    """A single-machine session with the settings that the library expects."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one where none is named and everything runs on this machine.

    Raises ``RuntimeError`` on a cluster that names none.
    """
    sc = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY)
    if named is None:
        current = sc.getCheckpointDir()
        if current is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
            current = "file://" + tempfile.mkdtemp(prefix="cairnlake-")
        named = current
        spark.conf.set(CHECKPOINT_KEY, named)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame, *old: DataFrame) -> DataFrame:
    """Cut the lineage in a loop: the rows are written to the shared folder (they survive the loss of executors), and the
    tables ``old`` of earlier calls, which nothing needs any longer, are deleted.

    A plain ``checkpoint()`` hands on the partitionings, orderings and constraints of its plan; where a table is joined
    with itself round after round these double each time until planning never ends, so a table is written instead.
    """
    out = staged(df, "cut")
    drop(*old)
    return out


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back, with column pruning and size statistics."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "lz4").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder of any file system Spark knows; whether it was there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Delete the files of results of :func:`cut` or :func:`staged`; other DataFrames are left alone."""
    for t in tables:
        if path := getattr(t, "staged_at", None):
            delete(t.sparkSession, path)
            t.staged_at = None


#: Bound of what is broadcast on the library's own account.
BROADCAST_BYTES = 32 << 20


def small_enough(df: DataFrame, max_rows: int, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows of together at most ``max_bytes``; looks at no more than that many rows."""
    size = sum((_width(f.name, f.dataType) for f in df.schema.fields), F.lit(8))
    n = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return n["rows"] <= max_rows and n["bytes"] <= max_bytes


def _width(name: str, kind) -> Column:
    """The bytes of a value: strings and binaries as they are, nested values by their text, others 8."""
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16
    return F.lit(8)


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it is proven to have at most ``max_rows`` rows and ``max_bytes``, else as it is.

    Beyond the bounds the planner falls back to a shuffled join, which adaptive execution splits at skewed keys.
    """
    return F.broadcast(df) if small_enough(df, max_rows, max_bytes) else df


def fresh(names: list[str], *wanted: str) -> list[str]:
    """Column names not in ``names`` (compared without case), one for each of ``wanted``."""
    taken = {n.lower() for n in names}
    out = []
    for w in wanted:
        c = w
        while c.lower() in taken:
            c = "_" + c
        taken.add(c.lower())
        out.append(c)
    return out
