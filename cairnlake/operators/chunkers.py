"""Chunkers of binary data, as table-generating Arrow functions: fixed, normalized, gear, rolling, keyed, local maximum.

Every chunker gives (key, idx, start, size, hash).  Cuts lie between ``least`` and ``most`` bytes after the last one.
Hashes are taken in overlapping blocks, so an item of any length needs a few MB beside itself.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Cutter = Callable[[bytes], list[int]]


def _window_hash(data: bytes, width: int, table: np.ndarray, factor: int) -> np.ndarray:
    """At each position a polynomial hash of the last ``width`` (a power of two) bytes, by doubling."""
    h = table[np.frombuffer(data, np.uint8)]
    f, w = np.uint64(factor), 1
    with np.errstate(over="ignore"):
        while w < width:
            h[w:] += f * h[:-w].copy()
            f, w = f * f, w * 2
    return h


_BLOCK = 1 << 20


def marks(data: bytes, width: int, table: np.ndarray, factor: int, test: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The ends (1..len) of the windows of ``width`` bytes whose hash passes ``test``."""
    out = []
    for at in range(0, len(data), _BLOCK):
        low = max(0, at - width + 1)
        h = _window_hash(data[low : at + _BLOCK], width, table, factor)[at - low :]
        out.append(np.flatnonzero(test(h)) + at + 1)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def cut_marks(n: int, marks: np.ndarray, least: int, most: int) -> list[int]:
    """Ends of chunks: the first mark at least ``least`` after the last end, ``most`` at the latest."""
    out, end = [], 0
    while n - end > least:
        k = np.searchsorted(marks, end + least)
        nxt = int(marks[k]) if k < len(marks) else n
        end = min(nxt, end + most, n)
        out.append(end)
    if end < n:
        out.append(n)
    return out


def fixed(size: int = 1 << 20) -> Cutter:
    return lambda data: [min(k + size, len(data)) for k in range(0, len(data), size)]


def _gear_table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, 256, np.uint64)


def gear(least: int, mean: int, most: int, seed: int = 1) -> Cutter:
    """Content-defined: the hash of the last 32 bytes has log2(mean) zero bits on top."""
    table = _gear_table(seed)
    shift = np.uint64(64 - max(1, int(mean).bit_length() - 1))
    return lambda data: cut_marks(len(data), marks(data, 32, table, 2, lambda h: h >> shift == 0), least, most)


def normalized(least: int, mean: int, most: int, seed: int = 1) -> Cutter:
    """Content-defined with normalised sizes, the chunker of the storage: up to the mean a cut needs one zero bit more than
    log2(mean) on top of the hash, beyond it one bit less, so that most chunks have about the mean size.  Data of at most
    ``least`` bytes is one chunk."""
    table, bits = _gear_table(seed), max(2, int(mean).bit_length() - 1)
    few, many = np.uint64(64 - bits + 1), np.uint64(64 - bits - 1)

    def cut(data: bytes) -> list[int]:
        n, end, out = len(data), 0, []
        loose = marks(data, 32, table, 2, lambda h: h >> few == 0)
        strict = marks(data, 32, table, 2, lambda h: h >> many == 0)
        while n - end > least:
            k = np.searchsorted(strict, end + least)
            if k < len(strict) and strict[k] < end + mean:
                end = int(strict[k])
            else:
                k = np.searchsorted(loose, end + max(mean, least))
                end = min(int(loose[k]) if k < len(loose) else n, end + most, n)
            out.append(end)
        return [*out, n] if end < n else out

    return cut


#: Least, mean and greatest chunk size in KiB by preset.
PRESETS = {"default": (16, 64, 256), "small": (1, 4, 16), "media": (64, 256, 1024), "project": (4, 16, 64), "max_dedup": (2, 8, 32), "fast": (256, 1024, 4096)}
#: The preset of a file category; default for the others.
KIND_PRESETS = {"video": "media", "audio": "media", "image": "media", "model3d": "media", "project": "project", "text": "project", "archive": "fast"}


def preset(name: str) -> Cutter:
    """The normalised chunker of a preset."""
    return normalized(*(k << 10 for k in PRESETS[name]))


def preset_for_size(size: Column) -> Column:
    """The preset for a file of so many bytes: project up to 64 KiB, default up to 10 MiB, then media."""
    return F.when(size <= 65_536, "project").when(size <= 10_485_760, "default").when(size.isNotNull(), "media")


def preset_for_kind(kind: Column) -> Column:
    """The preset for a file category."""
    out = F.lit("default")
    for k, name in KIND_PRESETS.items():
        out = F.when(kind == k, name).otherwise(out)
    return out


def rolling(least: int, mean: int, most: int) -> Cutter:
    """Content-defined: a polynomial of base 31 over 64 bytes, spread by a multiplication, is 0 modulo the mean."""
    table = np.arange(1, 257, dtype=np.uint64)

    def cut(data: bytes) -> list[int]:
        with np.errstate(over="ignore"):
            at = marks(data, 64, table, 31, lambda h: ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(mean) == 0)
        return cut_marks(len(data), at, least, most)

    return cut


def keyed(secret: bytes, least: int, mean: int, most: int) -> Cutter:
    """A gear chunker whose table comes from a secret, so cuts tell nothing about the content."""
    seed = int.from_bytes(hmac.new(secret, b"cuts", hashlib.sha256).digest()[:8], "big")
    return gear(least, mean, most, seed)


def local_maximum(width: int, most: int) -> Cutter:
    """A cut after each byte that exceeds all of the ``width`` bytes before it and is not exceeded by those after."""

    def cut(data: bytes) -> list[int]:
        a = np.frombuffer(data, np.uint8).astype(np.int16)
        if len(a) <= 2 * width:
            return cut_marks(len(a), np.zeros(0, np.int64), 1, most)
        w = np.lib.stride_tricks.sliding_window_view(a, width).max(1)
        at = np.arange(width, len(a) - width)
        return cut_marks(len(a), at[(a[at] > w[at - width]) & (a[at] >= w[at + 1])] + 1, 1, most)

    return cut


#: Chunkers by name with the usual sizes of small files.
REGISTRY: dict[str, Cutter] = {
    "fixed": fixed(256),
    "normalized": normalized(64, 256, 1024),
    "gear": gear(64, 256, 1024),
    "rolling": rolling(64, 256, 1024),
    "keyed": keyed(b"repository", 64, 256, 1024),
    "local_maximum": local_maximum(48, 1024),
}


def chunked(rows: DataFrame, key: str, data: str, cutter: Cutter) -> DataFrame:
    """(key, idx, start, size, hash) of the chunks of every row; null and empty data have none; rows stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                body = batch.column(1)[k].as_py()
                start = 0
                for n, end in enumerate(cutter(body) if body else []):
                    out.append((k, n, start, end - start, hashlib.sha256(body[start:end]).hexdigest()))
                    start = end
            at, *cols = zip(*out, strict=True) if out else [()] * 5
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], [key, "idx", "start", "size", "hash"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, data).mapInArrow(run, f"{key} {kind}, idx int, start long, size long, hash string")
