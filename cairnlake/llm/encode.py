"""Encoding of a whole corpus with a public tokenizer.

Texts of ordinary length are encoded where they are read, without a shuffle.  A text above ``segment_chars`` is cut into
segments which are encoded in parallel and put together again by tree concatenation (see :mod:`cairnlake.llm.bpe`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnlake.llm.bpe import DEFAULT_VOCAB, encoder, segments

SEGMENT_CHARS = 32_768
_STEP = 512  # texts a result batch


def _lists(rows: list[list[int]]) -> pa.ListArray:
    return pa.array(rows, pa.list_(pa.int32()))


def _encode_texts(vocab: str, counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocab)
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                part = batch.slice(at, _STEP)
                ids, bounds = bpe.batch(part.column(1).to_pylist())
                if counts:
                    out = pa.array(np.diff(bounds))
                else:
                    out = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), out], ["doc_id", "n_tokens" if counts else "ids"])

    return run


def _cut_texts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                rows = [(uid, doc, n, *s) for n, s in enumerate(segments(text, size))]
                cols = list(zip(*rows, strict=True))
                arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], batch.column(1).type), pa.array(cols[2], pa.int32())]
                arrays += [pa.array(cols[3], pa.string()), pa.array(cols[4], pa.bool_()), pa.array(cols[5], pa.bool_())]
                yield pa.RecordBatch.from_arrays(arrays, ["uid", "doc_id", "n", "piece", "open_left", "open_right"])

    return run


def _encode_segments(vocab: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocab)
        for batch in batches:
            piece, left, right = (batch.column(k).to_pylist() for k in (3, 4, 5))
            done = [bpe.segment(*x) for x in zip(piece, left, right, strict=True)]
            arrays = [batch.column(0), batch.column(1), batch.column(2), _lists([d[0] for d in done])]
            arrays += [pa.array([d[k] for d in done], pa.int32()) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays(arrays, ["uid", "doc_id", "n", "ids", "head", "tail"])

    return run


def _put_together(vocab: str, counts: bool):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("n")
        parts = [([int(i) for i in ids], int(h), int(t)) for ids, h, t in zip(part["ids"], part["head"], part["tail"], strict=True)]
        ids = encoder(vocab).concat(parts)
        return pd.DataFrame({"doc_id": part["doc_id"].iloc[:1].to_numpy(), "n_tokens" if counts else "ids": [len(ids) if counts else ids]})

    return run


def encode_corpus(docs: DataFrame, vocab: str = DEFAULT_VOCAB, segment_chars: int = SEGMENT_CHARS, counts: bool = False) -> DataFrame:
    """``(doc_id, ids)``, or ``(doc_id, n_tokens)`` with ``counts``, for every row of ``docs`` (columns doc_id, text).

    The ids are exactly those of the whole text without special tokens; strings that look like special tokens are
    ordinary text.  Null and empty texts have the empty list.  A row that comes twice is encoded twice; other columns
    are ignored; an empty table gives no rows.  ``segment_chars`` is at least 64.
    """
    if segment_chars < 64:
        raise ValueError("segment_chars must be at least 64")
    id_type = docs.schema["doc_id"].dataType
    result = T.StructField("n_tokens", T.LongType()) if counts else T.StructField("ids", T.ArrayType(T.IntegerType()))
    schema = T.StructType([T.StructField("doc_id", id_type), result])
    texts = docs.select("doc_id", "text")
    size = F.coalesce(F.length("text"), F.lit(0))
    short = texts.where(size <= segment_chars).mapInArrow(_encode_texts(vocab, counts), schema)
    cut_schema = T.StructType(
        [T.StructField("uid", T.LongType()), T.StructField("doc_id", id_type), T.StructField("n", T.IntegerType()), T.StructField("piece", T.StringType())]
        + [T.StructField(c, T.BooleanType()) for c in ("open_left", "open_right")]
    )
    part_schema = T.StructType(
        cut_schema.fields[:3] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField(c, T.IntegerType()) for c in ("head", "tail")]
    )
    long = texts.where(size > segment_chars).select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    pieces = long.mapInArrow(_cut_texts(segment_chars), cut_schema).repartition("uid", "n")
    joined = pieces.mapInArrow(_encode_segments(vocab), part_schema).groupBy("uid").applyInPandas(_put_together(vocab, counts), schema)
    return short.unionByName(joined)
