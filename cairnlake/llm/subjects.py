"""Subject areas of documents: averaged word and subword embeddings with independent logistic outputs.

A document is the mean of the vectors of its words, each weighted with the square root of its count; a word's vector is
the mean of its own embedding and those of its character n-grams.  Words and n-grams are hashed into buckets, so every
word has a vector, seen in training or not.  One logistic output a subject says whether a substantial share of the text
is about it, so a document may have none, one or several.

The model is trained on a bounded sample of labelled rows.  In each step every partition computes the gradient of its
share of the step's documents from the same parameters; the gradients are added up over all partitions and applied once,
so the result does not depend on the number of partitions.  Then every document is scored where it is read.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.session import broadcast_if_small, shared_dir

#: Bound of the labelled sample, in documents; the sample is taken by a hash of the id.
MAX_LABELLED = 20_000
#: Embeddings of n-grams, then of whole words.
GRAM_BUCKETS, WORD_BUCKETS = 1 << 14, 1 << 15
#: Steps go round BATCHES parts of the sample; the rate falls linearly to a tenth.
DIMENSION, BATCHES, STEPS, RATE = 16, 4, 60, 0.2
#: Documents that a partition holds in training, at least.
DOCS_A_SHARD = 250
THRESHOLD = 0.2
HELD_OUT = 5  # one labelled document in so many is for evaluation only
_token = re.compile(r"[^\W\d_぀-ヿ一-鿿]+|[぀-ヿ一-鿿]+")

_unspaced = re.compile(r"[\u3040-\u30ff\u4e00-\u9fff]").search


def tokens(text: str | None) -> list[str]:
    """Lower-case words, and pairs of characters where there are no spaces between words."""
    words = _token.findall((text or "").lower())
    if not text or not _unspaced(text):
        return words
    out: list[str] = []
    for w in words:
        if w[0] < "\u3040" or len(w) == 1:
            out.append(w)
        else:
            out.extend(w[i : i + 2] for i in range(len(w) - 1))
    return out


def buckets(word: str) -> list[int]:
    """The embeddings of a word: its character n-grams of 3 to 5, and itself."""
    x = f"<{word}>"
    ids = [zlib.crc32(x[i : i + n].encode()) % GRAM_BUCKETS for n in (3, 4, 5) for i in range(len(x) - n + 1)]
    return [*ids, GRAM_BUCKETS + zlib.crc32(x.encode()) % WORD_BUCKETS]


class Sparse:
    """A sparse matrix by rows."""

    def __init__(self, lengths: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int):
        self.lengths, self.columns, self.values, self.width = lengths, columns, values, width
        self.some = np.flatnonzero(lengths)
        self.starts = (np.cumsum(lengths) - lengths)[self.some]

    def dot(self, dense: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.lengths), dense.shape[1]), np.float32)
        if len(self.some):
            out[self.some] = np.add.reduceat(dense[self.columns] * self.values[:, None], self.starts)
        return out

    def transposed(self) -> Sparse:
        rows = np.repeat(np.arange(len(self.lengths)), self.lengths)
        order = np.argsort(self.columns, kind="stable")
        return Sparse(np.bincount(self.columns, minlength=self.width), rows[order], self.values[order], len(self.lengths))


_known_buckets: dict[str, list[int]] = {}


def word_rows(words: list[str]) -> Sparse:
    """Which embeddings make up each word; those of words met before are kept by the worker."""
    if len(_known_buckets) > 300_000:
        _known_buckets.clear()
    each = [_known_buckets.get(w) or _known_buckets.setdefault(w, buckets(w)) for w in words]
    n = np.array([len(x) for x in each], np.int64)
    columns = np.fromiter((i for x in each for i in x), np.int64, int(n.sum()))
    return Sparse(n, columns, np.repeat(1 / np.maximum(n, 1), n).astype(np.float32), GRAM_BUCKETS + WORD_BUCKETS)


def document_rows(numbers: np.ndarray, ends: np.ndarray, width: int) -> Sparse:
    """The weights of the words in each document: ``numbers`` are those of its words, up to the next of ``ends``."""
    n = len(ends) - 1
    doc = np.repeat(np.arange(n), np.diff(ends))
    code, count = np.unique(doc * width + numbers, return_counts=True)
    doc, weight = code // max(width, 1), np.sqrt(count)
    total = np.bincount(doc, weight, minlength=n)
    return Sparse(np.bincount(doc, minlength=n), code % max(width, 1), (weight / total[doc]).astype(np.float32), width)


@dataclass
class Model:
    """The parameters: embeddings, outputs, biases."""

    subjects: list[str]
    params: list[np.ndarray]

    @staticmethod
    def fresh(subjects: list[str], seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        params = [
            rng.normal(0, 0.02, (GRAM_BUCKETS + WORD_BUCKETS, DIMENSION)).astype(np.float32),
            rng.normal(0, 0.5, (DIMENSION, len(subjects))).astype(np.float32),
            np.full(len(subjects), -2, np.float32),
        ]
        return Model(subjects, params)


class Batch:
    """Some labelled documents, prepared for gradients."""

    def __init__(self, texts: list[str | None], targets: np.ndarray):
        self.y = targets.astype(np.float32)
        known: dict[str, int] = {}
        numbers, ends = [], [0]
        for t in texts:
            numbers.extend(known.setdefault(w, len(known)) for w in tokens(t))
            ends.append(len(numbers))
        self.docs = document_rows(np.array(numbers, np.int64), np.array(ends), len(known))
        words = word_rows(list(known))
        self.touched, columns = np.unique(words.columns, return_inverse=True)  # the embeddings that occur
        self.words = Sparse(words.lengths, columns, words.values, len(self.touched))
        self.words_t, self.docs_t = self.words.transposed(), self.docs.transposed()

    def gradient(self, params: list[np.ndarray]) -> list[np.ndarray]:
        """Summed over the documents: of the embeddings that occur (``touched``), the outputs and the biases."""
        e, w, b = params
        h = self.docs.dot(self.words.dot(e[self.touched]))
        dz = 1 / (1 + np.exp(-(h @ w + b))) - self.y
        return [self.words_t.dot(self.docs_t.dot(dz @ w.T)), h.T @ dz, dz.sum(0)]


class Adam:
    """The optimiser, which has its moments for the whole training."""

    def __init__(self, params: list[np.ndarray]):
        self.params, self.step = params, 0
        self.first, self.second = ([np.zeros_like(a) for a in params] for _ in range(2))

    def apply(self, gradients: list[np.ndarray], rate: float) -> None:
        self.step += 1
        for p, m, v, g in zip(self.params, self.first, self.second, gradients, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.99**self.step)) + 1e-7)


class _Known(dict):
    """Word -> its number among the scored words, given on demand."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        number = self[word] = len(self)
        return number


class Scorer:
    """Scores of texts: the weighted means of the scores of their words, which are kept."""

    def __init__(self, model: Model):
        self.model = model
        self.table = model.params[0] @ model.params[1]
        self._forget()

    def _forget(self) -> None:
        self.known = _Known()
        self.scores = np.zeros((0, len(self.model.subjects)), np.float32)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities, one row a text; a text without words has zeros."""
        if len(self.known) > 500_000:
            self._forget()
        numbers: list[int] = []
        ends = [0]
        for t in texts:
            numbers.extend(map(self.known.__getitem__, tokens(t)))
            ends.append(len(numbers))
        if self.known.new:
            self.scores = np.concatenate([self.scores, word_rows(self.known.new).dot(self.table)])
            self.known.new = []
        docs = document_rows(np.array(numbers, np.int64), np.array(ends), len(self.known))
        p = 1 / (1 + np.exp(-(docs.dot(self.scores) + self.model.params[2])))
        p[docs.lengths == 0] = 0
        return p


# -- on Spark ------------------------------------------------------------------------------------------------------


def labelled(docs: DataFrame, labels: DataFrame, subjects: list[str], limit: int = MAX_LABELLED) -> DataFrame:
    """``(doc_id, text, targets, batch, held_out)`` of at most ``limit`` labelled documents, taken by a hash of the id.

    Labels are compared without case and outer white space; copies count once; labels that are none of the subjects say
    that a document was looked at.  A document that comes twice counts once, with its least text.  The sample is chosen
    by ids alone, and the documents are filtered where they are read.
    """
    said = labels.where("doc_id is not null and subject is not null").select("doc_id", F.lower(F.trim("subject")).alias("subject"))
    each = said.groupBy("doc_id").agg(F.collect_set("subject").alias("said")).join(docs.select("doc_id"), "doc_id", "left_semi")
    wanted = F.array(*[F.lit(s.strip().lower()) for s in subjects])
    h = F.xxhash64("doc_id")
    chosen = each.orderBy(h, "doc_id").limit(limit).select(
        "doc_id",
        F.transform(wanted, lambda s: F.array_contains("said", s).cast("float")).alias("targets"),
        F.pmod(F.shiftright(h, 8), F.lit(BATCHES)).cast("int").alias("batch"),
        (F.pmod(F.shiftright(h, 24), F.lit(HELD_OUT)) == 0).alias("held_out"),
    )
    return docs.select("doc_id", "text").join(broadcast_if_small(chosen, limit), "doc_id")


def in_shards(sample: DataFrame) -> DataFrame:
    """The sample as a table in the shared folder, a folder a batch, so that a step reads only its documents."""
    spark = sample.sparkSession
    rows = sample.count()
    shards = max(1, min(spark.sparkContext.defaultParallelism, rows // (DOCS_A_SHARD * BATCHES)))
    path = f"{shared_dir(spark)}/p9-labelled-{uuid.uuid4().hex}"
    once = sample.repartition(shards, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), *[F.first(c).alias(c) for c in ("targets", "batch", "held_out")])
    once.write.partitionBy("batch").parquet(path)
    return spark.read.schema(once.schema).parquet(path)


_prepared: dict[tuple, Batch] = {}


def _batch(part: pd.DataFrame, run: str, n_subjects: int) -> Batch:
    """A partition's documents, kept by the worker for the later rounds of the same training."""
    part = part.sort_values("doc_id")
    key = (run, int(part["batch"].iloc[0]), len(part), str(part["doc_id"].iloc[0]))
    if key not in _prepared:
        if len(_prepared) > 64 or any(k[0] != run for k in _prepared):
            _prepared.clear()
        targets = np.array(part["targets"].to_list(), np.float32).reshape(len(part), n_subjects)
        _prepared[key] = Batch(part["text"].to_list(), targets)
    return _prepared[key]


def _gradients(params, n_subjects: int, run: str):
    def step(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [p for p in parts if len(p)]
        if held:
            batch = _batch(pd.concat(held), run, n_subjects)
            g = batch.gradient(params.value)
            rest = np.concatenate([g[1].ravel(), g[2]]).astype("<f4")
            yield pd.DataFrame({"n": [len(batch.y)], "touched": [batch.touched.astype("<i4").tobytes()], "embeddings": [g[0].astype("<f4").tobytes()], "rest": [rest.tobytes()]})

    return step


def _summed(rows: list, params: list[np.ndarray]) -> list[np.ndarray]:
    """The mean gradient over all documents of all partitions."""
    out = [np.zeros_like(a) for a in params]
    for r in rows:
        out[0][np.frombuffer(r["touched"], "<i4")] += np.frombuffer(r["embeddings"], "<f4").reshape(-1, DIMENSION)
        rest = np.frombuffer(r["rest"], "<f4")
        out[1] += rest[: out[1].size].reshape(out[1].shape)
        out[2] += rest[out[1].size :]
    n = sum(r["n"] for r in rows)
    return [a / n for a in out]


def train(sample: DataFrame, subjects: list[str], steps: int = STEPS) -> Model:
    """Train on a result of :func:`in_shards`; a table without rows gives a model that finds nothing.  A job a step, of
    which each partition returns one gradient (bounded by the number of embeddings)."""
    spark = sample.sparkSession
    model, run = Model.fresh(subjects), uuid.uuid4().hex
    adam = Adam(model.params)
    for k in range(steps):
        params = spark.sparkContext.broadcast(model.params)
        part = sample.where(F.col("batch") == k % BATCHES).select("doc_id", "text", "targets", "batch")
        rows = part.mapInPandas(_gradients(params, len(subjects), run), "n long, touched binary, embeddings binary, rest binary").collect()  # a row a partition
        params.destroy()
        if rows:
            adam.apply(_summed(rows, model.params), RATE * (1 - 0.9 * k / steps))
        elif k >= BATCHES - 1 and not adam.step:
            break
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, subject, probability)``: every document with every subject; other columns are ignored.

    Null, empty and wordless texts have probability 0.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.subjects, model.params))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, k = Scorer(Model(*shared.value)), len(shared.value[0])
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                p = scorer(part.column(1).to_pylist())
                ids = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), k)))
                names = pa.array(scorer.model.subjects * part.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays([ids, names, pa.array(p.reshape(-1).astype(np.float64))], ["doc_id", "subject", "probability"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, subject string, probability double")


def subject_names(subjects: DataFrame, most: int = 1000) -> list[str]:
    """The subjects in order; there may be at most ``most``."""
    names = [r[0] for r in subjects.where("subject is not null").select("subject").distinct().orderBy("subject").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} subjects")
    return names


def document_subjects(docs: DataFrame, labels: DataFrame, subjects: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, subject, probability)`` of the subjects that a substantial share of a document is about."""
    names = subject_names(subjects)
    sample = in_shards(labelled(docs, labels, names))
    return score(docs, train(sample, names)).where(F.col("probability") >= threshold)


def held_out_quality(docs: DataFrame, labels: DataFrame, subjects: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per subject: right, wrong and missed cases among labelled documents that training did not see."""
    names = subject_names(subjects)
    sample = in_shards(labelled(docs, labels, names))
    model = train(sample.where(~F.col("held_out")), names)
    rest = sample.where("held_out")
    truth = rest.select("doc_id", F.posexplode("targets").alias("k", "target")).withColumn("subject", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("k") + 1))
    hit, case = F.col("probability") >= threshold, F.col("target") > 0.5
    return (
        score(rest, model)
        .join(truth, ["doc_id", "subject"])
        .groupBy("subject")
        .agg(F.count_if(hit & case).alias("right"), F.count_if(hit & ~case).alias("wrong"), F.count_if(~hit & case).alias("missed"))
    )
