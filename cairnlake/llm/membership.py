"""Has this key been seen before?

Keys are spread over partitions by their hash.  Each partition reads its keys in order of arrival and keeps 16-bit
fingerprints in cuckoo tables (two candidate buckets of four slots) that grow when they are full and support deletion;
the keys themselves are not kept.  The tables can be stored in the shared folder, a row a partition, and loaded by the
next batch of arrivals, which then reads no earlier key.  Before the shuffle, each Arrow batch is reduced to the first row
of each key, so a hot key sends a row a batch and not all of its rows.

A cuckoo table never overlooks a key, so "new" is always right.  "Seen" may be wrong; an audit looks up only those
reported keys of which no arrival was new, and finds which of them no earlier row has.

Each occurrence of a key counts, so a deletion takes back one of them.  For the keys that are deleted in a batch the
number of their occurrences in it is kept exactly; a deletion of what isn't there changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.session import staged

SLOTS = 4
MAX_KICKS = 256
FULL = 0.92
KEYS_PER_PARTITION = 1_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class CuckooTable:
    """Fingerprints in ``2**bits`` buckets of four slots."""

    def __init__(self, bits: int):
        self.mask = (1 << bits) - 1
        self.bits = bits
        self.slots = np.zeros((1 << bits, SLOTS), np.uint16)
        self.n = 0
        self._turn = 0

    @staticmethod
    def loaded(bits: int, slots: bytes) -> CuckooTable:
        """A table from its stored slots."""
        t = CuckooTable(bits)
        t.slots = np.frombuffer(slots, np.uint16).reshape(-1, SLOTS).copy()
        t.n = int((t.slots > 0).sum())
        return t

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = _mix(keys.astype(np.uint64, copy=False))
        fp = ((h >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        one = (h & np.uint64(self.mask)).astype(np.int64)
        return fp, one, self._other(one, fp)

    def _other(self, bucket, fp):
        """The second bucket of a fingerprint (the first, if given the second)."""
        spread = _mix(np.asarray(fp).astype(np.uint64))
        return bucket ^ (spread & np.uint64(self.mask)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        fp, one, two = self._places(keys)
        return (self.slots[one] == fp[:, None]).any(1) | (self.slots[two] == fp[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> np.ndarray:
        """Insert keys; gives which of them found no place."""
        fp, one, two = self._places(keys)
        left = np.arange(len(keys))
        for bucket in (one, two) * SLOTS:
            if not len(left):
                break
            _, first = np.unique(bucket[left], return_index=True)  # one key a bucket at a time
            at = left[first]
            free = self.slots[bucket[at]] == 0
            has = free.any(1)
            at, slot = at[has], free[has].argmax(1)
            self.slots[bucket[at], slot] = fp[at]
            self.n += len(at)
            placed = np.zeros(len(keys), bool)
            placed[at] = True
            left = left[~placed[left]]
        failed = np.zeros(len(keys), bool)
        for k in left:
            failed[k] = not self._kick(int(one[k]), fp[k])
        return failed

    def _kick(self, bucket: int, fp: np.uint16) -> bool:
        """Insert by moving others on; if that doesn't end, everything is put back."""
        path = []
        for _ in range(MAX_KICKS):
            free = np.flatnonzero(self.slots[bucket] == 0)
            if len(free):
                self.slots[bucket, free[0]] = fp
                self.n += 1
                return True
            self._turn = (self._turn + 1) % SLOTS
            path.append((bucket, self._turn, self.slots[bucket, self._turn]))
            self.slots[bucket, self._turn], fp = fp, self.slots[bucket, self._turn]
            bucket = int(self._other(np.int64(bucket), fp))
        for bucket, slot, old in reversed(path):
            self.slots[bucket, slot] = old
        return False

    def delete(self, key: np.ndarray) -> bool:
        """Delete one key (an array of length 1) that was inserted; False if it isn't there."""
        fp, one, two = self._places(key)
        for bucket in (one[0], two[0]):
            at = np.flatnonzero(self.slots[bucket] == fp[0])
            if len(at):
                self.slots[bucket, at[0]] = 0
                self.n -= 1
                return True
        return False


class GrowingCuckoo:
    """Cuckoo tables, each twice the size of the one before; a new one is opened when the last is full."""

    def __init__(self, bits: int = 10):
        self.tables = [CuckooTable(bits)]
        self.bits = bits

    def contains(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        for t in self.tables:
            out |= t.contains(keys)
        return out

    def insert(self, keys: np.ndarray) -> None:
        while len(keys):
            t = self.tables[-1]
            room = int(t.slots.size * FULL) - t.n
            if room > 0:
                failed = t.insert(keys[:room])
                keys = np.concatenate([keys[:room][failed], keys[room:]])
            if len(keys):
                self.bits += 1
                self.tables.append(CuckooTable(self.bits))

    def delete(self, key: np.ndarray) -> bool:
        return any(t.delete(key) for t in self.tables)


#: What a row does, in the order of the rows of a partition: stored tables and known keys come first, then arrivals and
#: deletions by id.
TABLE, KNOWN, ARRIVAL, DELETION = 0, 1, 2, 3
_ROW = "part int, side int, id long, op int, key string, h long, slots binary"
_OUT = "id long, key string, seen boolean, part int, bits int, slots binary"


def _first_in_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Known keys and arrivals of which no earlier row is in the batch."""
    for batch in batches:
        pdf = batch.select(["side", "id", "key"]).to_pandas()
        keep = pdf.sort_values(["side", "id"], kind="stable").drop_duplicates("key").index.to_numpy()
        yield batch.take(pa.array(np.sort(keep)))


class _Partition:
    """The tables of one partition, and the exact number of occurrences of the keys that are deleted."""

    def __init__(self):
        self.tables = GrowingCuckoo()
        self.loaded: list[CuckooTable] = []
        self.counts: dict[str, int] = {}

    def load(self, bits: int, slots: bytes) -> None:
        self.loaded.append(CuckooTable.loaded(bits, slots))
        self.loaded.sort(key=lambda t: t.bits)
        self.tables.tables, self.tables.bits = self.loaded, self.loaded[-1].bits

    def look_up(self, keys: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Which of some keys, in order, were seen before; they are remembered."""
        repeated = pd.Series(keys).duplicated().to_numpy()
        there = self.tables.contains(h)
        self.tables.insert(h[~there & ~repeated])
        return repeated | there

    def step(self, op: int, key: str, h: np.ndarray) -> bool:
        """One row of a key that is deleted somewhere: whether it is there before."""
        n = self.counts.get(key)
        if n is None:  # not in this batch yet: an earlier one may have it
            n = self.counts[key] = int(self.tables.contains(h)[0])
        if op == DELETION:
            if n:
                self.counts[key] = n - 1
                if n == 1:
                    self.tables.delete(h)
            return bool(n)
        if not n:
            self.tables.insert(h)
        self.counts[key] = n + 1
        return bool(n)


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition in order: look up, then remember; at the end come the tables."""
    held, number = _Partition(), 0
    nothing = lambda n, t: pa.nulls(n, t)
    for batch in batches:
        op = batch.column(3).to_numpy()
        for k in np.flatnonzero(op == TABLE):
            held.load(int(batch.column(2)[k].as_py()), batch.column(6)[k].as_py())
        rows = np.flatnonzero(op != TABLE)
        if not len(rows):
            if batch.num_rows:
                number = int(batch.column(0)[0].as_py())
            continue
        number = int(batch.column(0)[0].as_py())
        pdf = batch.select(["id", "op", "key", "h", "side"]).to_pandas().iloc[rows]
        op, keys, h = pdf["op"].to_numpy(), pdf["key"].to_numpy(), pdf["h"].to_numpy().view(np.uint64)
        flags = np.zeros(len(pdf), bool)
        tracked = pdf["side"].to_numpy() % 2 == 1  # rows of keys that are deleted
        flags[~tracked] = held.look_up(keys[~tracked], h[~tracked])
        for k in np.flatnonzero(tracked):
            flags[k] = held.step(op[k], keys[k], h[k : k + 1])
        some = op == ARRIVAL
        n = int(some.sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array(pdf["id"].to_numpy()[some]), pa.array(keys[some], pa.string()), pa.array(flags[some]), pa.array(np.full(n, number), pa.int32()), nothing(n, pa.int32()), nothing(n, pa.binary())],
            ["id", "key", "seen", "part", "bits", "slots"],
        )
    tables = [t for t in held.tables.tables if t.n]
    if tables:
        n = len(tables)
        yield pa.RecordBatch.from_arrays(
            [nothing(n, pa.int64()), nothing(n, pa.string()), nothing(n, pa.bool_()), pa.array([number] * n, pa.int32()), pa.array([t.bits for t in tables], pa.int32()), pa.array([t.slots.tobytes() for t in tables], pa.binary())],
            ["id", "key", "seen", "part", "bits", "slots"],
        )


@dataclass
class Membership:
    """The answers for all arrivals.

    ``probed``: (id, key, seen) of the arrivals that went to the tables; any other arrival with a key repeats one of its
    batch.  ``arrivals``: (id, key).  ``known``: (key), what the audit compares with.  ``tables``: (part, bits, slots) as
    they are after the last arrival, in the shared folder; ``partitions`` is how many partitions they have.
    """

    arrivals: DataFrame
    known: DataFrame
    probed: DataFrame
    tables: DataFrame
    partitions: int
    deleted: DataFrame | None = None

    def reported(self) -> DataFrame:
        """(id, key) of the arrivals that the tables call seen."""
        fresh = self.probed.where(~F.col("seen")).select("id")
        return self.arrivals.where(F.col("key").isNotNull()).join(fresh, "id", "left_anti")

    @cached_property
    def wrong(self) -> DataFrame:
        """(id) of the arrivals that are called seen though no earlier row has their key: the audit."""
        probed = self.probed if self.deleted is None else self.probed.join(self.deleted, "key", "left_anti")  # those are exact
        new_keys = probed.where(~F.col("seen")).select("key").distinct()
        doubtful = probed.where("seen").groupBy("key").agg(F.min("id").alias("id")).join(new_keys, "key", "left_anti")
        return doubtful.join(self.known.where("key is not null").distinct(), "key", "left_anti").select("id")

    def found(self) -> DataFrame:
        """(id) of the arrivals whose key was seen before, without the wrong answers."""
        return self.reported().select("id").join(self.wrong, "id", "left_anti")

    def rate(self) -> DataFrame:
        """One row: arrivals with a key, how many are called seen, how many of these wrongly, and the rate of wrong
        answers among those that are new (null if none is)."""
        counts = self.arrivals.where(F.col("key").isNotNull()).agg(F.count(F.lit(1)).alias("n_arrivals"))
        fresh = self.probed.where(~F.col("seen")).agg(F.count(F.lit(1)).alias("n_called_new"))
        wrong = self.wrong.agg(F.count(F.lit(1)).alias("n_wrong"))
        new = F.col("n_called_new") + F.col("n_wrong")
        return counts.join(fresh).join(wrong).select(  # three frames of one row
            "n_arrivals", (F.col("n_arrivals") - F.col("n_called_new")).alias("n_called_seen"), "n_wrong", F.try_divide("n_wrong", new).alias("wrong_rate")
        )


def seen_before(
    arrivals: DataFrame, known: DataFrame, deletions: DataFrame | None = None, partitions: int | None = None, earlier: Membership | None = None
) -> Membership:
    """Decide for each arrival ``(id, key)`` whether its key is among the ``known`` keys or those of a smaller id.

    ``id`` is a unique bigint.  A null key is never seen and not remembered.  ``deletions`` ``(id, key)`` take back one
    earlier occurrence of a key each, at their id; what isn't there can't be deleted.  ``earlier`` is an earlier result:
    its tables are loaded, its keys are not read again (``known`` then only has what is new; with ``earlier`` the keys of
    its time must be given to :attr:`Membership.known` for an audit).  An occurrence of an earlier batch counts once
    however often it came there.  Empty inputs give empty answers; the number of partitions follows the number of keys if
    not given, and is that of ``earlier``.  Runs jobs and writes the tables to the shared folder.
    """
    spark = arrivals.sparkSession
    arrivals = arrivals.select(F.col("id").cast("long").alias("id"), F.col("key").cast("string").alias("key"))
    known = known.select(F.col("key").cast("string").alias("key"))
    if earlier is not None:
        partitions = earlier.partitions
    if partitions is None:
        n = arrivals.count() + known.count()
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // KEYS_PER_PARTITION))
    part = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(partitions)).cast("int")
    row = lambda df, side, op, i: df.where(F.col("key").isNotNull()).select(
        part.alias("part"), F.lit(side).alias("side"), i.cast("long").alias("id"), F.lit(op).alias("op"), "key", F.xxhash64("key").alias("h"), F.lit(None).cast("binary").alias("slots")
    )
    rows = row(known, 0, KNOWN, F.lit(-1)).unionByName(row(arrivals, 2, ARRIVAL, F.col("id")))
    deleted = None
    if deletions is None:
        rows = rows.mapInArrow(_first_in_batch, _ROW)
    else:  # all rows of the keys that are deleted go to the tables, the others' first ones
        deletions = deletions.select(F.col("id").cast("long").alias("id"), F.col("key").cast("string").alias("key"))
        deleted = deletions.where(F.col("key").isNotNull()).select("key").distinct()
        tracked = rows.join(deleted, "key", "left_semi").withColumn("side", F.col("side") + 1)
        tracked = tracked.unionByName(row(deletions, 3, DELETION, F.col("id")))
        rows = rows.join(deleted, "key", "left_anti").select(*tracked.columns).mapInArrow(_first_in_batch, _row_schema(tracked)).unionByName(tracked)
    if earlier is not None:
        stored = earlier.tables.select("part", F.lit(-1).alias("side"), F.col("bits").cast("long").alias("id"), F.lit(TABLE).alias("op"), F.lit("").alias("key"), F.lit(0).cast("long").alias("h"), "slots")
        rows = rows.unionByName(stored)
    ordered = rows.select("part", "side", "id", "op", "key", "h", "slots").repartitionById(partitions, F.col("part")).sortWithinPartitions("side", "id")
    out = staged(ordered.mapInArrow(_probe, _OUT), "p5-probed")
    return Membership(arrivals, known, out.where("bits is null").select("id", "key", "seen"), out.where("bits is not null").select("part", "bits", "slots"), partitions, deleted)


def _row_schema(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
