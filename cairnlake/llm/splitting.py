"""Splitting oversized items at natural boundaries, by content-defined chunking.

A rolling hash over the last 32 bytes marks landmarks.  From each cut on, the first landmark between the least and the
greatest advance is snapped to the nearest natural boundary there, so the cuts depend on the content since the last cut
only and an edit alters neighbouring pieces until the cuts meet again.  Items made of chunks (manifest entries) have the
chunks' borders as natural boundaries and the chunks' hashes as landmarks.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnlake.session import broadcast_if_small

#: The categories that are cut before the boundary bytes; all others are cut after them.
CUT_BEFORE = ("video", "audio")
_WINDOW, _FACTOR = 32, np.uint64(0x9E3779B97F4A7C15)
_FLUSH = 4 << 20
_BLOCK = 1 << 20


def rolling(data: bytes) -> np.ndarray:
    """At each position the hash of the (up to) 32 bytes before it, by five doublings of the window."""
    h = (np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    factor, width = _FACTOR, 1
    with np.errstate(over="ignore"):
        while width < _WINDOW:
            h[width:] += factor * h[:-width].copy()
            factor, width = factor * factor, width * 2
    return h


def landmarks(data: bytes, spacing: int) -> np.ndarray:
    """Positions (1..len) whose hash has its top bits zero, one in ``spacing`` (a power of two) on average; hashed in
    overlapping blocks, so that an item of any length needs a few MB beside itself."""
    out, shift = [], np.uint64(65 - int(spacing).bit_length())
    for at in range(0, len(data), _BLOCK):
        low = max(0, at - _WINDOW + 1)
        out.append(np.flatnonzero(rolling(data[low : at + _BLOCK])[at - low :] >> shift == 0) + at + 1)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def boundaries(data: bytes, mark: bytes | None, before: bool) -> tuple[list[int], int]:
    """Where the data may be cut naturally, and the longest stretch without a boundary (marks don't overlap)."""
    if not mark:
        return [], len(data)
    out, end, longest = [], 0, 0
    while (at := data.find(mark, end)) >= 0:
        longest = max(longest, at - end)
        end = at + len(mark)
        out.append(at if before else end)
    return out, max(longest, len(data) - end)


def cuts(n: int, max_bytes: int, overlap: int, natural: list[int], marks: list[int]) -> list[tuple[int, bool]]:
    """The ends of all pieces but the last of an item of ``n`` bytes, and whether they are natural.

    A piece begins ``overlap`` bytes before the end of the one before it and has at most ``max_bytes``; ``natural`` and
    ``marks`` are sorted.  A natural place is taken if there is one in reach at all.
    """
    out: list[tuple[int, bool]] = []
    least = max(1, (max_bytes - overlap) // 4)
    start = 0
    while n - start > max_bytes:
        done, high = start + overlap, start + max_bytes
        low = done + least
        k = bisect_left(marks, low)
        mark = marks[k] if k < len(marks) and marks[k] <= high else high
        a, b = bisect_left(natural, low), bisect_right(natural, high)
        if a < b:
            k = bisect_left(natural, mark, a, b)
            near = natural[max(a, k - 1) : min(b, k + 1)]
            end, kind = min(near, key=lambda p: abs(p - mark)), True
        elif a and natural[a - 1] > done:
            end, kind = natural[a - 1], True
        else:
            k = bisect_right(marks, high)
            end, kind = (marks[k - 1] if k and marks[k - 1] >= low else high), False
        out.append((end, kind))
        start = end - overlap
    return out


def spans(n: int, overlap: int, ends: list[tuple[int, bool]]) -> list[tuple[int, int, str]]:
    """(start, end, kind of the cut at the end) of each piece."""
    out, start = [], 0
    for end, is_natural in ends:
        out.append((start, end, "natural" if is_natural else "forced"))
        start = end - overlap
    return [*out, (start, n, "end")]


def _power(x: int) -> int:
    return 1 << max(1, int(x).bit_length() - 1)


def split_bytes(data: bytes, max_bytes: int, overlap: int, mark: bytes | None, before: bool) -> tuple[list[tuple[int, int, str]], int]:
    """The pieces of one item, and its longest stretch without a boundary."""
    natural, longest = boundaries(data, mark, before)
    marks = landmarks(data, _power((max_bytes - overlap) // 4)).tolist()
    return spans(len(data), overlap, cuts(len(data), max_bytes, overlap, natural, marks)), longest


def split_extents(n: int, max_bytes: int, overlap: int, extents: list[dict]) -> list[tuple[int, int, str]]:
    """The pieces of an item of ``n`` bytes made of chunks."""
    known = [e for e in extents or [] if e is not None and e["byte_offset"] is not None]
    borders = {e["byte_offset"] for e in known} | {e["byte_offset"] + e["size"] for e in known if e["size"] is not None}
    marks = {e["byte_offset"] for e in known if (e["hash"] or "").strip()[-1:].lower() in ("0", "4", "8", "c")}
    return spans(n, overlap, cuts(n, max_bytes, overlap, sorted(b for b in borders if 0 < b < n), sorted(marks)))


_SPANS = T.StructType(
    [
        T.StructField("item_key", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("max_bytes", T.LongType()),
        T.StructField("longest_gap", T.LongType()),
        T.StructField("piece_no", T.IntegerType()),
        T.StructField("n_pieces", T.IntegerType()),
        T.StructField("piece_start", T.LongType()),
        T.StructField("piece_end", T.LongType()),
        T.StructField("cut_kind", T.StringType()),
    ]
)
_PIECES = T.StructType([*_SPANS.fields, T.StructField("piece", T.BinaryType())])


def _emit(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(arrow)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.BinaryType(): pa.binary()}
    return pa.schema([(f.name, kinds[f.dataType]) for f in schema])


def _split(schema: T.StructType, of_chunks: bool, with_data: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = _arrow(schema)
        for batch in batches:
            rows, held = [], 0
            for k in range(batch.num_rows):
                key, category, n, most, overlap, mark, body = (batch.column(c)[k].as_py() for c in range(7))
                overlap = max(0, overlap or 0)
                if overlap >= most:
                    raise ValueError(f"{category}: pieces of {most} bytes can't share {overlap}")
                if of_chunks:
                    pieces, gap = split_extents(n, most, overlap, body), None
                else:
                    pieces, gap = split_bytes(body, most, overlap, mark, category in CUT_BEFORE)
                for no, (start, end, kind) in enumerate(pieces):
                    row = (key, category, n, most, gap, no, len(pieces), start, end, kind)
                    rows.append((*row, body[start:end]) if with_data else row)
                    held += end - start if with_data else 64
                if held > _FLUSH:
                    yield _emit(rows, arrow)
                    rows, held = [], 0
            if rows:
                yield _emit(rows, arrow)

    return run


def split_chunks(chunks: DataFrame, limits: DataFrame, with_data: bool = True) -> DataFrame:
    """The pieces of every chunk whose data is longer than ``max_bytes`` of its category.

    One row a piece: item_key (the hash), category, n_bytes, max_bytes, longest_gap (bytes between two boundaries),
    piece_no, n_pieces, piece_start, piece_end, cut_kind (``natural``, ``forced``, ``end``) and, ``with_data``, the
    piece itself.  Pieces have at most max_bytes, consecutive ones share overlap_bytes (null or negative: none; max_bytes and
    more is an error), and without the shared bytes they give back the data.  Rows with equal hash, category and data are split once; rows with
    null data, of a category without limit, or with a limit below 1 are no case.  Other columns are ignored.
    """
    bound = limits.select("category", "max_bytes", "overlap_bytes", "boundary").where(F.col("max_bytes") >= 1).dropDuplicates(["category"])
    size = F.octet_length("data").cast("long")
    over = (
        chunks.select("hash", "category", "data")
        .join(broadcast_if_small(bound), "category")
        .where(size > F.col("max_bytes"))
        .withColumn("digest", F.sha2("data", 256))
        .dropDuplicates(["hash", "category", "digest"])
        .select(F.col("hash").alias("item_key"), "category", size.alias("n"), "max_bytes", "overlap_bytes", "boundary", "data")
    )
    schema = _PIECES if with_data else _SPANS
    return over.mapInArrow(_split(schema, False, with_data), schema)


def entry_bytes() -> Column:
    """The size of a manifest entry: the greater of its size and the end of its last chunk (null if neither is known)."""
    ends = F.transform("chunks", lambda c: c["byte_offset"] + c["size"])
    return F.greatest(F.col("size"), F.array_max(ends))


def split_entries(entries: DataFrame, limits: DataFrame, kind: str = "manifest_entry") -> DataFrame:
    """The pieces of every manifest entry above ``max_bytes`` of ``kind``: the columns of :func:`split_chunks` without
    data, item_key being the entry_id.  Cuts lie at borders of the entry's chunks where one is in reach.  Rows equal in
    entry_id, size and chunks are split once; null chunks or sizes within them give no border.
    """
    bound = limits.where((F.col("category") == kind) & (F.col("max_bytes") >= 1)).select("max_bytes", "overlap_bytes").limit(1)
    over = (
        entries.select("entry_id", "size", "chunks", entry_bytes().alias("n"))
        .join(F.broadcast(bound), F.col("n") > F.col("max_bytes"))  # one row
        .dropDuplicates(["entry_id", "size", "chunks"])
        .select(
            F.col("entry_id").cast("string").alias("item_key"),
            F.lit(kind).alias("category"),
            "n",
            "max_bytes",
            "overlap_bytes",
            F.lit(None).cast("binary").alias("boundary"),
            "chunks",
        )
    )
    return over.mapInArrow(_split(_SPANS, True, False), _SPANS)
