"""Filling fixed-capacity containers with items of integer length.

Lengths are whole numbers up to the capacity, so the corpus is described by a histogram of at most ``capacity`` counts,
however large it is.  The plan is made on that histogram: for each length, longest first, its complement is looked up
among single lengths, pair sums and triple sums that are still available, and the combination is used as often as the
counts allow; what no exact combination fills goes best-fit-decreasing.  The plan is a list of intervals of ranks within
a length (a few thousand rows), and each item finds its container from its length and its rank by binary search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAPACITY = 2048
_KEY = 1 << 40  # ranks within a length stay below this


@dataclass
class Plan:
    """Intervals of ranks within a length and where they go."""

    capacity: int
    n_bins: int = 0
    rows: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # length, first rank, items, first bin, offset

    def arrays(self) -> tuple[np.ndarray, ...]:
        """Sorted keys (length and first rank), first ranks, first bins and offsets."""
        rows = np.array(sorted(self.rows), np.int64).reshape(-1, 5)
        return rows[:, 0] * _KEY + rows[:, 1], rows[:, 1], rows[:, 3], rows[:, 4]


class _Packer:
    def __init__(self, counts: np.ndarray, capacity: int):
        self.avail = counts.astype(np.int64).copy()
        self.used = np.zeros_like(self.avail)
        self.plan = Plan(capacity)
        self.pairs = None

    def place(self, length: int, n: int, first_bin: int, offset: int) -> None:
        self.plan.rows.append((length, int(self.used[length]), int(n), int(first_bin), int(offset)))
        self.used[length] += n
        self.avail[length] -= n

    def open_bins(self, lengths: list[int], n: int) -> int:
        """``n`` new bins, each with items of these lengths; returns the first."""
        first, offset = self.plan.n_bins, 0
        for length in lengths:
            self.place(length, n, first, offset)
            offset += length
        self.plan.n_bins += n
        return first

    def pair(self, total: int) -> list[int] | None:
        """Two available lengths of this sum, the longer as long as possible."""
        low = (total + 1) // 2
        if total < 2:
            return None
        longer = np.arange(min(total - 1, self.plan.capacity), low - 1, -1)
        ok = (self.avail[longer] > 0) & (self.avail[total - longer] > 0)
        if 2 * low == total and len(ok):
            ok[-1] &= self.avail[low] > 1
        k = int(ok.argmax()) if len(ok) else 0
        return [int(longer[k]), total - int(longer[k])] if len(ok) and ok[k] else None

    def index_pairs(self) -> None:
        """Which sums some pair of available lengths has (sums that vanish later stay until the next call)."""
        there = (self.avail > 0).astype(np.float64)
        size = 1 << int(2 * len(there) - 1).bit_length()
        f = np.fft.rfft(there, size)
        self.pairs = np.fft.irfft(f * f, size)[: len(there)] > 0.5

    def triple(self, total: int) -> list[int] | None:
        """Three available lengths of this sum."""
        if total < 3:
            return None
        stale = 0
        if self.pairs is None:
            self.index_pairs()
        a = np.arange(total - 2, 0, -1)
        for x in a[(self.avail[a] > 0) & self.pairs[total - a]]:
            self.avail[x] -= 1
            rest = self.pair(total - int(x))
            self.avail[x] += 1
            if rest:
                return [int(x), *rest]
            stale += 1
        if stale > 16:
            self.index_pairs()
        return None

    def complement(self, length: int, parts: int) -> list[int] | None:
        """``parts`` available lengths that exactly fill the room beside one item of ``length``."""
        gap = self.plan.capacity - length
        self.avail[length] -= 1
        try:
            if parts == 1:
                return [gap] if self.avail[gap] > 0 else None
            return self.pair(gap) if parts == 2 else self.triple(gap)
        finally:
            self.avail[length] += 1

    def run(self) -> Plan:
        """Single complements for all lengths first, then pairs, then triples, so that small items are not used up where
        one item would do; the rest best fit."""
        capacity = self.plan.capacity
        if self.avail[capacity]:
            self.open_bins([capacity], int(self.avail[capacity]))
        for parts in (1, 2, 3):
            for length in range(capacity - 1, 0, -1):
                while self.avail[length] > 0:
                    rest = self.complement(length, parts)
                    if rest is None:
                        break
                    lengths = [length, *rest]
                    self.open_bins(lengths, min(int(self.avail[x]) // lengths.count(x) for x in lengths))
        self.best_fit()
        return self.plan

    def best_fit(self) -> None:
        """What is left, longest first, each into the fullest bin that has room for it."""
        capacity = self.plan.capacity
        gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: (first bin, bins)
        for length in range(capacity, 0, -1):
            room = length
            while self.avail[length] > 0 and room < capacity:
                if not gaps[room]:
                    room += 1
                    continue
                first, n = gaps[room].pop()
                m = min(n, int(self.avail[length]))
                self.place(length, m, first, capacity - room)
                gaps[room - length].append((first, m))
                if m < n:
                    gaps[room].append((first + m, n - m))
                room = max(length, min(room, room - length))
            each = capacity // length
            if n := int(self.avail[length]) // each:
                first = self.open_bins([length] * each, n)
                gaps[capacity - each * length].append((first, n))
            if left := int(self.avail[length]):
                first = self.open_bins([length] * left, 1)
                gaps[capacity - left * length].append((first, 1))


def plan_bins(counts: np.ndarray, capacity: int) -> Plan:
    """The plan for a histogram: ``counts[l]`` items of length l, 0 <= l <= capacity (length 0 is not planned).

    Exact combinations, then best fit; where that needs over 0.5 % more than the least conceivable number of containers,
    best fit alone is tried as well and the plan with fewer containers is taken.
    """
    counts = np.asarray(counts).copy()
    counts[0] = 0
    plan = _Packer(counts, capacity).run()
    least = -(-int((counts * np.arange(capacity + 1)).sum()) // capacity)
    if plan.n_bins > 1.005 * least + 1:
        # many long items without exact partners: using up the short ones in exact combinations can cost containers
        other = _Packer(counts, capacity)
        other.best_fit()
        plan = min(plan, other.plan, key=lambda p: p.n_bins)
    return plan


def _assign(arrays: tuple[np.ndarray, ...], n_bins: int, names: list[str]):
    keys, ranks, bins, offsets = arrays

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            length, rank = at["n_tokens"].to_numpy(zero_copy_only=False), at["rank"].to_numpy(zero_copy_only=False)
            container, offset = rank % max(n_bins, 1), np.zeros_like(rank)  # items of length 0 are dealt out in turn
            some = length > 0
            if some.any():
                k = np.searchsorted(keys, length[some] * _KEY + rank[some], "right") - 1
                container[some] = bins[k] + rank[some] - ranks[k]
                offset[some] = offsets[k]
            yield pa.RecordBatch.from_arrays([at[n] for n in names] + [pa.array(container), pa.array(offset)], [*names, "container_id", "container_offset"])

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, salts: int | None = None) -> DataFrame:
    """Assign items ``(doc_id, n_tokens)`` to containers of ``capacity``.

    Gives ``(doc_id, piece_no, piece_start, n_tokens, container_id, container_offset)``, one row a piece.  An item
    longer than the capacity is cut into full pieces and a rest; no other item is cut.  Items of length 0 (and of null
    or negative length, counted as 0) take no room and are dealt out over the containers.  Repeated rows are items of
    their own; an empty table gives no rows.  ``items`` is read several times: pass a staged table.

    Ranks within a length are counted in ``salts`` groups of a length by item id (chosen by the number of items if not
    given), so a length that a third of all items share is ranked by many tasks.
    """
    length = F.greatest(F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long"), F.lit(0).cast("long"))
    last = F.greatest(F.ceil(length / capacity) - 1, F.lit(0)).cast("int")
    pieces = items.select("doc_id", length.alias("whole"), F.explode(F.sequence(F.lit(0), last)).alias("piece_no")).select(
        "doc_id",
        "piece_no",
        (F.col("piece_no") * F.lit(capacity).cast("long")).alias("piece_start"),
        F.least(F.col("whole") - F.col("piece_no") * capacity, F.lit(capacity)).cast("long").alias("n_tokens"),
    )
    if salts is None:
        salts = max(1, -(-items.count() // 200_000))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(salts)))
    counts = salted.groupBy("n_tokens", "salt").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("n_tokens").agg(F.sum("n").alias("n")).collect():  # at most capacity + 1 rows
        histogram[row["n_tokens"]] = row["n"]
    plan = plan_bins(histogram, capacity)
    before = Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("n_tokens", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("n_tokens", "salt").orderBy("doc_id", "piece_no")
    ranked = (
        salted.withColumn("k", F.row_number().over(within) - 1)
        .join(starts, ["n_tokens", "salt"])
        .select("doc_id", "piece_no", "piece_start", "n_tokens", (F.col("k") + F.col("before")).alias("rank"))
    )
    names = ["doc_id", "piece_no", "piece_start", "n_tokens"]
    schema = T.StructType([ranked.schema[n] for n in names] + [T.StructField(n, T.LongType()) for n in ("container_id", "container_offset")])
    return ranked.mapInArrow(_assign(plan.arrays(), plan.n_bins, names), schema)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, items, tokens, unused room and the share of the capacity in use (null without items)."""
    each = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("n"))
    return each.agg(
        F.count(F.lit(1)).alias("n_containers"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_items"),
        F.coalesce(F.sum("used"), F.lit(0)).alias("n_tokens"),
        F.coalesce(F.sum(F.lit(capacity) - F.col("used")), F.lit(0)).alias("unused"),
        F.max("used").alias("fullest"),
    ).withColumn("fill", F.try_divide(F.col("n_tokens").cast("double"), F.col("n_containers") * F.lit(capacity)))
