"""Quality classifier by nearest-neighbour voting over latent-semantic vectors.

A text's terms are its character-class trigrams (lower case, upper case, digit, blank, line end, every mark for itself)
and how often words repeat, so they describe form in any language. Term weights are square roots of shares times
inverse document frequency; a truncated singular value decomposition of the labelled sample gives the latent space.
The sample's vectors are broadcast, every document's cosines with all of them are computed exactly in blocks, and its
nearest neighbours' labels are averaged with weights that grow with the cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Labelled rows that are learned from at most: those with the smallest hashes of their doc_id.
MAX_LABELLED = 4096
TERMS, LATENT, NEIGHBOURS, SHARPNESS = 1024, 48, 15, 8
HELD_OUT_OF, HELD_OUT = 5, 0
THRESHOLD = 0.3
REPEATS = 3


def _classes() -> np.ndarray:
    """The class of each byte: bytes beyond ASCII count as lower-case letters."""
    of = np.ones(256, np.int64)
    of[:128] = np.arange(64, 192) % 64
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    of[:128] = 0
    of[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = 1
    of[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 2
    of[[ord(c) for c in "0123456789"]] = 3
    of[[10, 13]] = 4
    of[[32, 9]] = 5
    of[marks] = np.arange(6, 6 + len(marks))
    return of


CLASS = _classes()
_TRIGRAM = (C.mix(np.arange(64**3, dtype=np.uint64) + np.uint64(7)) % np.uint64(TERMS)).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of TERMS + REPEATS shares' square roots, for each text; zeros for an empty one."""
    n = len(offsets) - 1
    out = np.zeros((n, TERMS + REPEATS), np.float32)
    row = np.repeat(np.arange(n), np.diff(offsets))
    if len(data) >= 3:
        kind = CLASS[data]
        code = _TRIGRAM[kind[:-2] << 12 | kind[1:-1] << 6 | kind[2:]]
        whole = row[:-2] == row[2:]
        counts = np.bincount(row[:-2][whole] * TERMS + code[whole], minlength=n * TERMS).reshape(n, TERMS)
        out[:, :TERMS] = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    starts, ends, index = C.words(data, offsets)
    if len(starts):
        word = C.byte_hash(data, starts, ends)
        of = np.repeat(np.arange(n), np.diff(index))
        total = np.maximum(np.diff(index), 1)
        for k in range(1, REPEATS + 1):  # words equal to the k-th before
            same = (word[k:] == word[:-k]) & (of[k:] == of[:-k])
            out[:, TERMS + k - 1] = np.sqrt(np.bincount(of[k:][same], minlength=n) / total)
    return out


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.steps(batches):
        rows = features(*C.utf8(batch.column(1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary()), batch.column(2)], names=["doc_id", "features", "label"])


class Model:
    """Latent vectors of the labelled sample, their labels, and the map into the latent space."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray):
        self.labels = labels.astype(np.float32)
        self.idf = (np.log((1 + len(rows)) / (1 + (rows > 0).sum(axis=0))) + 1).astype(np.float32)
        weighted = self.weigh(rows)
        gram = (weighted.T @ weighted).astype(np.float64)
        values, vectors = np.linalg.eigh(gram)
        order = np.argsort(-values)[:LATENT]
        vectors = vectors[:, order] * np.sign(vectors[np.abs(vectors[:, order]).argmax(axis=0), order])
        self.space = vectors.astype(np.float32)
        self.vectors = self.latent(rows)
        self.prior = float(self.labels.mean()) if len(labels) else 0.5

    def weigh(self, rows: np.ndarray) -> np.ndarray:
        out = rows * self.idf
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size > 0, size, 1)

    def latent(self, rows: np.ndarray) -> np.ndarray:
        out = self.weigh(rows) @ self.space
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size > 0, size, 1)

    def score(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.prior)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for low in range(0, len(rows), 256):
            mine = self.latent(rows[low : low + 256])
            cosine = mine @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** SHARPNESS
            total = weight.sum(axis=1)
            vote = (weight * self.labels[near]).sum(axis=1) / np.where(total > 0, total, 1)
            known = (total > 0) & mine.any(axis=1)
            out[low : low + 256] = np.where(known, vote, self.prior)
        return np.clip(out, 0, 1)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """The model of at most max_labelled rows of labels (doc_id, quality) that are not held out and have a document.

    Of a doc_id with several labels the smallest counts. The sample is all that reaches the driver: max_labelled rows
    of about 4 KB.
    """
    held = C.bucket_of("doc_id", HELD_OUT_OF) == HELD_OUT
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("doc_id is not null and label is not null").where(~held)
    known = known.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = rows.join(F.broadcast(known), "doc_id").select("doc_id", "text", "label").mapInArrow(_featured, "doc_id long, features binary, label int")
    found = sorted(sample.collect(), key=lambda r: (r.doc_id, bytes(r.features)))[:max_labelled]
    matrix = np.frombuffer(b"".join(bytes(r.features) for r in found), np.float32).reshape(len(found), TERMS + REPEATS)
    return Model(matrix, np.array([r.label for r in found], np.float32))


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in C.steps(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(features(*C.utf8(batch.column(1)))).astype(np.float64))], names=["doc_id", "score"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) of each row of docs (doc_id, text).

    Null and empty texts, and texts like none of the sample, score the sample's share of label 1 (0.5 without labels).
    Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _score(it, shared.value), "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from the threshold on) of each row of docs."""
    held = C.bucket_of("doc_id", HELD_OUT_OF) == HELD_OUT
    return score(docs, train(docs, labels, max_labelled)).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _accept(batches: Iterator[pa.RecordBatch], model: Model, threshold: float, text: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        name = batch.schema.names[text]
        for step in C.steps(iter([batch]), name):
            yield step.filter(pa.array(model.score(features(*C.utf8(step.column(text)))) >= threshold))


def keep_accepted(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs (doc_id, text and any others) that score the threshold or more, with all their columns.

    Null and empty texts score the sample's share of label 1 and so stay, unless most labels are 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_labelled))
    text = docs.columns.index("text")
    return docs.mapInArrow(lambda it: _accept(it, shared.value, threshold, text), docs.schema)
