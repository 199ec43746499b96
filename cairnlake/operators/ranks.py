"""Ranks and running sums that no single task has to compute alone.

A group is cut into ``salt`` parts by a hash of the row's id.  Each part is ranked by itself, and the totals of the
parts before it are added: a group that holds a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_A_PART = 200_000


def parts_for(n_rows: int) -> int:
    """How many parts keep a group of all rows at about ``ROWS_A_PART`` a part."""
    return max(1, -(-n_rows // ROWS_A_PART))


def running(df: DataFrame, group: list[str], row_id: str, parts: int, **sums: Column) -> DataFrame:
    """``df`` with ``rank`` (0, 1, ... within the group) and, for each of ``sums``, the sum over the rows before.

    The order within a group is (hash part, ``row_id``), which is deterministic if ``row_id`` is unique in the group.
    Null group values form a group of their own.
    """
    names = list(sums)
    salted = df.withColumns({"_part": F.pmod(F.xxhash64(row_id), F.lit(parts)).cast("int"), **{f"_v_{n}": c for n, c in sums.items()}})
    totals = salted.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    w = Window.partitionBy(*group, "_part").orderBy(row_id)
    rows_before = w.rowsBetween(Window.unboundedPreceding, -1)
    own = salted.withColumns(
        {"_k": F.row_number().over(w).cast("long") - 1, **{f"_s_{n}": zero(F.sum(f"_v_{n}").over(rows_before)) for n in names}}
    )
    if parts == 1:  # nothing comes before a group's only part
        return own.select(*df.columns, F.col("_k").alias("rank"), *[F.col(f"_s_{n}").alias(n) for n in names])
    starts = totals.select(
        *[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)],
        F.col("_part").alias("_p"),
        zero(F.sum("_rows").over(before)).alias("_b_rank"),
        *[zero(F.sum(f"_t_{n}").over(before)).alias(f"_b_{n}") for n in names],
    )
    same = [own[g].eqNullSafe(starts[f"_g{k}"]) for k, g in enumerate(group)]
    return own.join(starts, [*same, own["_part"] == starts["_p"]]).select(
        *df.columns, (F.col("_k") + F.col("_b_rank")).alias("rank"), *[(F.col(f"_s_{n}") + F.col(f"_b_{n}")).alias(n) for n in names]
    )
