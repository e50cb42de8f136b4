"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) its letters' vectors, permuted
twice, once and not at all; a text's vector bundles (adds) its trigrams' vectors, and a language's prototype bundles
all trigrams of its training texts. A text gets the language whose prototype has the highest cosine with it.
Prototypes are sums of integers, so they don't depend on partitions, and training keeps one vector for each language,
however many texts there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

DIMENSIONS = 1024
UNKNOWN = "und"
HELD_OUT_OF, HELD_OUT = 3, 1
#: Code points in one numpy step, and cells of the matrix of rows and codes in one product.
STEP, CODES = 1 << 20, 4096


@lru_cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() if not 0xD800 <= i < 0xE000 else False for i in range(0x110000)])


def _trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Row and code of every trigram over lower-case letters, where a run of other characters is one blank; 21 bits a letter."""
    parts = [np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), "<u4") if text else np.zeros(0, "<u4") for text in texts]
    row = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
    points = np.concatenate([np.zeros(0, "<u4"), *parts])
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:-1] |= letter[1:] & (row[:-1] == row[1:])
    keep[:1] = True
    points, row, letter = np.where(letter, points, 0)[keep].astype(np.int64), row[keep], letter[keep]
    # Of a run of blanks, keep the first, unless it opens the text.
    again = np.zeros(len(points), bool)
    again[1:] = ~letter[1:] & ~letter[:-1] & (row[1:] == row[:-1])
    points, row = points[~again], row[~again]
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = points[:-2] << 42 | points[1:-1] << 21 | points[2:]
    ok = (row[:-2] == row[2:]) & (points[1:-1] > 0)
    return row[:-2][ok], code[ok]


def _letter_vectors(points: np.ndarray, dimensions: int) -> np.ndarray:
    words = (dimensions + 63) // 64
    seed = (points.astype(np.uint64)[:, None] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    bits = np.unpackbits(C.mix(C.mix(seed)).view(np.uint8).reshape(len(points), -1), axis=1)[:, :dimensions]
    return bits.astype(np.int8) * 2 - 1


def ngram_vectors(codes: np.ndarray, dimensions: int) -> np.ndarray:
    """The bound vector of each trigram code."""
    letters = np.stack([codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF])
    points, at = np.unique(letters, return_inverse=True)
    at = at.reshape(letters.shape)
    own = _letter_vectors(points, dimensions)
    return np.roll(own, 2, axis=1)[at[0]] * np.roll(own, 1, axis=1)[at[1]] * own[at[2]]


def bundles(row: np.ndarray, code: np.ndarray, n: int, dimensions: int) -> np.ndarray:
    """The sums of the bound vectors of each of n rows' codes. Codes are taken CODES at a time and rows 256 at a time,
    so the memory is the same however many different codes a text has."""
    out = np.zeros((n, dimensions), np.float32 if len(code) < 1 << 24 else np.float64)
    order = np.lexsort((row, code))
    row, code = row[order], code[order]
    new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (code[1:] != code[:-1]))[: len(row)])
    times = np.diff(np.append(new, len(row)))
    row, code = row[new], code[new]
    codes, at = np.unique(code, return_inverse=True)
    for low in range(0, len(codes), CODES):
        own = slice(np.searchsorted(at, low), np.searchsorted(at, low + CODES))
        vectors = ngram_vectors(codes[low : low + CODES], dimensions).astype(out.dtype)
        rows, of = np.unique(row[own], return_inverse=True)
        for some in range(0, len(rows), 256):
            mine = (of >= some) & (of < some + 256)
            counts = np.zeros((min(256, len(rows) - some), len(vectors)), out.dtype)
            counts[of[mine] - some, at[own][mine] - low] = times[own][mine]
            out[rows[some : some + 256]] += counts @ vectors
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return C.steps(batches, limit=STEP)


def _train(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in _slices(batches):
        langs = np.array(batch.column(1).to_pylist(), dtype=object)
        row, code = _trigrams(batch.column(0).to_pylist())
        if not len(code):
            continue
        names, of = np.unique(langs.astype(str), return_inverse=True)
        sums = np.rint(bundles(of[row], code, len(names), dimensions)).astype(np.int64)
        for name, vector in zip(names, sums, strict=True):
            total[name] = total.get(name, 0) + vector
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))], names=["lang", "vector"])


def train(labelled: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """lang, dimension, value: the prototype of each language in labelled (text, lang); rows without either don't count."""
    rows = labelled.where("text is not null and lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sums = rows.mapInArrow(lambda it: _train(it, dimensions), "lang string, vector array<long>")
    return sums.select("lang", F.posexplode("vector").alias("dimension", "value")).groupBy("lang", "dimension").agg(F.sum("value").alias("value"))


def _predict(batches: Iterator[pa.RecordBatch], langs: list[str], prototypes: np.ndarray, dimensions: int) -> Iterator[pa.RecordBatch]:
    names = np.array([*langs, UNKNOWN], dtype=object)
    scale = np.linalg.norm(prototypes, axis=1, keepdims=True)
    unit = (prototypes / np.where(scale > 0, scale, 1)).astype(np.float32)
    for batch in _slices(batches):
        texts = batch.column(1).to_pylist()
        row, code = _trigrams(texts)
        best, score = np.full(len(texts), len(langs)), np.zeros(len(texts))
        if len(code) and langs:
            rows, of = np.unique(row, return_inverse=True)
            bundle = bundles(of, code, len(rows), dimensions)
            size = np.linalg.norm(bundle, axis=1, keepdims=True)
            cosine = (bundle / np.where(size > 0, size, 1)) @ unit.T
            best[rows] = cosine.argmax(axis=1)
            score[rows] = np.clip(cosine.max(axis=1), 0, 1)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(score.astype(np.float64))], names=["doc_id", "lang_pred", "score"])


def predict(docs: DataFrame, prototypes: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """doc_id, lang_pred, score (the highest cosine, at least 0) of each row of docs (doc_id, text).

    `und` with score 0 if the text is null or has no letter, or if no language was learned. Of equal cosines the
    language that sorts first wins. Prototypes, one vector a language, are collected; other columns are ignored.
    """
    rows = prototypes.collect()
    langs = sorted({r.lang for r in rows})
    matrix = np.zeros((len(langs), dimensions))
    for r in rows:
        matrix[langs.index(r.lang), r.dimension] = r.value
    inputs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return inputs.mapInArrow(lambda it: _predict(it, langs, matrix, dimensions), "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """predict() for all of docs (doc_id, text, lang), with prototypes of the rows that are not held out, and held_out."""
    held = C.bucket_of("doc_id", HELD_OUT_OF) == HELD_OUT
    prototypes = train(docs.where(~held), dimensions)
    return predict(docs, prototypes, dimensions).select("doc_id", held.alias("held_out"), "lang_pred", "score")
