"""Alignment of two tokenizers' tokens by pointer jumping.

Each task encodes its texts with both tokenizers, a chunk at a time, and lays the tokens of all texts of a chunk on one
line of bytes. Every token points to its farthest-right overlapping token of the other tokenizer; doubling the
pointers (each takes its target's target) converges, in the logarithm of the longest chain, to the last token of its
component, which labels the group.

How often an id pair is linked in the whole corpus is counted from one row for each pair and chunk. These counts go
back to the chunks whose pairs they are, by joins alone, so nothing grows with the vocabularies in any one place.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import common as C
from .tokens import default_vocabulary, encoder

#: Bytes of text in a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 4 << 20
_FIELDS = "doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>"
CHUNKS = f"chunk long, {_FIELDS}, codes array<long>, total array<long>, sizes array<int>, at binary, times binary"
SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters are themselves,
    all other bytes, in order, are the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Side:
    """A tokenizer and the bytes of its tokens."""

    def __init__(self, encode: Callable[[str], list[int]], entries: list[bytes]):
        self.encode, self.sizes = encode, np.array([len(b) for b in entries], np.int64)
        self.first, self.bytes = (np.cumsum(self.sizes) - self.sizes).astype(np.int32), np.frombuffer(b"".join(entries), np.uint8)
        # Each id in decimal with a comma (row 0), a bar (1) or a semicolon (2) behind it, in eight bytes.
        self.decimals = np.array([[b"%d%s" % (i, end) for i in range(len(entries))] for end in (b",", b"|", b";")], "S8")

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all tokens, one after the other."""
        sizes = self.sizes[ids].astype(np.int32)
        ends = np.cumsum(sizes, dtype=np.int32)
        return self.bytes[np.arange(ends[-1] if len(ends) else 0, dtype=np.int32) + np.repeat(self.first[ids] - ends + sizes, sizes)]


@lru_cache(maxsize=2)
def byte_level(path: str) -> Side:
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    alphabet = byte_alphabet()
    entries = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        entries[i] = bytes(alphabet[c] for c in token)
    return Side(encoder(path), entries)


@lru_cache(maxsize=2)
def pieces(path: str) -> Side:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def entry(i: int) -> bytes:
        piece = model.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if model.is_byte(i) else piece.replace("\u2581", " ").encode()

    return Side(model.encode, [entry(i) for i in range(model.get_piece_size())])


def links(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The token of A and that of B of every overlap, one for each stretch between neighbouring ends of either, from
    left to right; and whether the stretch ends with its token of A, and with that of B."""
    end = np.zeros((int(a_ends[-1]) if len(a_ends) else 0) + 1, np.int8)
    end[a_ends] = 1
    end[b_ends] += 2
    kind = end[np.flatnonzero(end)]
    ends_a, ends_b = (kind & 1).astype(bool), (kind & 2).astype(bool)
    return np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b, ends_a, ends_b


def successors(link_a: np.ndarray, link_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """For the tokens of A and behind them those of B, the farthest-right token that overlaps: that of the stretch
    with which it ends. A token of A that ends where one of B does is the last of its component: it points to itself.
    """
    over_a, over_b = link_b[ends_a], link_a[ends_b]
    return np.concatenate([np.where(ends_b[ends_a], np.arange(len(over_a)), len(over_a) + over_a), over_b])


def jump(pointers: np.ndarray) -> np.ndarray:
    """The token at which each chain of pointers ends, by doubling."""
    while True:
        further = pointers[pointers]
        if np.array_equal(further, pointers):
            return pointers
        pointers = further


def groups(pointers: np.ndarray, n_a: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of its group, from 0 and from left to right, of each of the n_a tokens of A and of those of B."""
    last = jump(pointers)
    number = np.cumsum(last[:n_a] == np.arange(n_a)) - 1
    return number[last[:n_a]], number[last[n_a:]]


def packed(numbers: np.ndarray) -> bytes:
    """Small non-negative numbers, compressed by planes of bytes."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _before(group: np.ndarray, other: np.ndarray, shift: int) -> np.ndarray:
    """For each token's group, the tokens of the other side in the groups before it (shift 0) or up to it (1)."""
    count = np.bincount(other, minlength=1)
    return np.append(0, np.cumsum(count))[group + shift]


def _listed(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, side_a: Side, side_b: Side) -> tuple[bytes, np.ndarray]:
    """`a1,a2|b1;a3|b2;` of all groups, and the place after each token in it."""
    text = np.zeros(len(a) + len(b), "S8")
    for ids, group, at, side, last in ((a, in_a, _before(in_a, in_b, 0), side_a, 1), (b, in_b, _before(in_b, in_a, 1), side_b, 2)):
        end = np.append(group[1:] != group[:-1], len(group) > 0)[: len(group)]
        text[np.arange(len(ids)) + at] = side.decimals[end * last, ids]
    raw = text.view(np.uint8)
    full = raw != 0
    return raw[full].tobytes(), np.cumsum(full.reshape(-1, 8).sum(axis=1))


def _encoded(texts: list, side_a: Side, side_b: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of A and of B of all texts that both give back byte by byte, and how many each text has of either."""
    wholes = [(" " + text).encode() if text else b"" for text in texts]
    length = np.array([len(w) for w in wholes], np.int64)
    lists = [side_a.encode(" " + text) if text else [] for text in texts], [side_b.encode(text) if text else [] for text in texts]
    counts = [np.array([len(ids) for ids in own], np.int64) for own in lists]
    flat = [np.array(list(chain.from_iterable(own)), np.int64) for own in lists]
    fine = length > 0
    for side, n, ids in zip((side_a, side_b), counts, flat):
        fine &= np.diff(np.append(0, np.cumsum(side.sizes[ids]))[np.append(0, np.cumsum(n))]) == length
    for k, side in enumerate((side_a, side_b)):
        whole = np.frombuffer(b"".join(wholes), np.uint8)
        ids, kept, start = flat[k], fine | (length == 0), np.cumsum(length) - length
        if not kept.all():
            ids, whole = ids[np.repeat(kept, counts[k])], whole[np.repeat(kept, length)]
            start = np.cumsum(length * kept) - length * kept
        differs = np.flatnonzero(side.spelled(ids) != whole)
        fine[np.searchsorted(start, differs, side="right") - 1] = False
    if not (fine | (length == 0)).all():
        flat = [ids[np.repeat(fine, n)] for ids, n in zip(flat, counts)]
    return *flat, counts[0] * fine, counts[1] * fine


def align(doc_ids: list, texts: list, side_a: Side, side_b: Side) -> dict[str, object]:
    """One row of CHUNKS, without chunk, for some texts."""
    a, b, n_a, n_b = _encoded(texts, side_a, side_b)
    first_a, first_b = np.append(0, np.cumsum(n_a)), np.append(0, np.cumsum(n_b))
    # Texts end where tokens of both end, so no group and no link goes from one to the next.
    link_a, link_b, ends_a, ends_b = links(np.cumsum(side_a.sizes[a]), np.cumsum(side_b.sizes[b]))
    in_a, in_b = groups(successors(link_a, link_b, ends_a, ends_b), len(a))
    listed, after = _listed(a, b, in_a, in_b, side_a, side_b)
    edges = np.append(0, after)[first_a + first_b].tolist()
    hashes = [hashlib.sha256(listed[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(edges, edges[1:])]

    label, codes = pd.factorize(a[link_a] << 32 | b[link_b])
    wide = max(len(codes), 1)
    first_link = np.searchsorted(link_a, first_a)
    own = np.sort(np.repeat(np.arange(len(doc_ids)) * wide, np.diff(first_link)) + label)
    new = np.flatnonzero(np.append(True, own[1:] != own[:-1])[: len(own)])
    owner, at = np.divmod(own[new], wide)
    return {
        "doc_id": doc_ids,
        "n_a": n_a,
        "n_b": n_b,
        "n_groups": np.diff(np.append(0, in_a + 1)[first_a]),
        "n_links": np.diff(first_link),
        "groups_sha256": hashes,
        "codes": codes,
        "total": np.bincount(label, minlength=len(codes)),
        "sizes": np.bincount(owner, minlength=len(doc_ids)),
        "at": packed(at),
        "times": packed(np.diff(np.append(new, len(own)))),
    }


def _chunks(batches: Iterator[pa.RecordBatch], schema: pa.Schema, path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    side_a, side_b = byte_level(path_a), pieces(path_b)
    number = TaskContext.get().partitionId() << 32
    for batch in C.steps(batches, limit=CHUNK_BYTES):
        row = align(batch.column(0).to_pylist(), batch.column(1).to_pylist(), side_a, side_b) | {"chunk": number}
        number += 1
        yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)


def _sums(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA from chunks that have count and best of each of their pairs, in the order of codes."""
    for batch in batches:
        for row in range(batch.num_rows):
            one = {name: batch.column(i)[row] for i, name in enumerate(batch.schema.names)}
            n = len(one["doc_id"].values)
            known = one["known"].values
            place, count, best = (known.field(name).to_numpy(zero_copy_only=False) if known is not None else np.zeros(0, np.int64) for name in ("place", "count", "best"))
            order = np.argsort(place)
            at, times = unpacked(one["at"].as_py()), unpacked(one["times"].as_py())
            owner = np.repeat(np.arange(n), one["sizes"].values.to_numpy())
            out = {name: one[name].values for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
            for name, weight in (("n_best", best), ("count_sum", count)):
                summed = np.zeros(n, np.int64)
                np.add.at(summed, owner, times * weight[order][at].astype(np.int64))
                out[name] = pa.array(summed)
            yield pa.RecordBatch.from_arrays([out[f.name].cast(f.type) for f in schema], schema=schema)


def alignment(docs: DataFrame, vocabulary: str | None = None, piece_model: str | None = None) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is a byte-level vocabulary that encodes a space and the text, B a sentencepiece model that encodes the text.
    Groups are the stretches between bytes at which tokens of both end; links are the pairs of tokens that share
    bytes. count_sum adds up, over the links, how many links of all documents have the same two ids; n_best counts
    the links whose pair is the most frequent one of its id of B (ties included). groups_sha256 is of the groups' ids
    (`a1,a2|b1;a3|b2,b3`). Texts that are null or empty, or that a tokenizer does not give back byte by byte, have no
    tokens: all numbers 0, an empty string. Strings of special tokens are plain text. Repeated rows count each, rows
    without doc_id stay; other columns are ignored; an empty table gives none.
    """
    path_a, path_b = vocabulary or default_vocabulary(), piece_model or default_pieces()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunk_type, out_type = (to_arrow_schema(StructType.fromDDL(names)) for names in (CHUNKS, SCHEMA))
    with C.Scratch() as tmp:
        chunks = tmp.written(rows.mapInArrow(lambda it: _chunks(it, chunk_type, path_a, path_b), CHUNKS), "chunks")
        pairs = chunks.select("chunk", F.posexplode(F.arrays_zip("codes", "total")).alias("place", "pair")).select("chunk", "place", "pair.codes", "pair.total")
        counts = tmp.written(pairs.groupBy("codes").agg(F.sum("total").alias("count")), "counts")
        of_b = F.col("codes").bitwiseAND(F.lit((1 << 32) - 1))
        highest = counts.groupBy(of_b.alias("b")).agg(F.max("count").alias("highest"))
        rated = counts.withColumn("b", of_b).join(highest, "b").select("codes", "count", (F.col("count") == F.col("highest")).cast("int").alias("best"))
        known = pairs.select("chunk", "place", "codes").join(rated, "codes").groupBy("chunk").agg(F.collect_list(F.struct("place", "count", "best")).alias("known"))
        done = chunks.drop("codes", "total").join(known, "chunk", "left").mapInArrow(lambda it: _sums(it, out_type), SCHEMA)
        return C.written(done, "aligned")
