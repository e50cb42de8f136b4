"""Packing by sum of squares.

Each task packs its rows as they come. With N(h) the number of open windows filled to level h, a document's last,
short piece goes to the level that makes the sum of all N(h)**2 least, a new window being level 0; the sum's change
follows from two entries of the level array. Full windows leave at once. At most OPEN windows are open: where a piece
fits none of so many, its head fills the fullest one and its rest is placed by the level array again. When the rows
end, the fullest windows keep their pieces and are filled up with pieces of the emptiest; the last, partly filled
window is cut into windows of lengths that need no padding. Sequence numbers are unique over all tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import default_vocabulary, encoder

CONTEXT = 1024
END_ID = 0
#: Windows of one task that are open at a time.
OPEN = 16
FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


class Packer:
    """Sum-of-squares packing of one stream. Pieces are (doc_id, start, ids as little-endian uint32, doc_tokens)."""

    def __init__(self, context: int, first_sequence: int):
        self.context, self.next = context, first_sequence
        self.level = np.zeros(context + 1, np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(context + 1)]

    def close(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, offset
            offset += len(ids)
        self.next += 1

    def add(self, doc: int, ids: np.ndarray) -> Iterator[tuple]:
        total, whole = len(ids), len(ids) // self.context * self.context
        for start in range(0, whole, self.context):
            yield from self.close([(doc, start, ids[start : start + self.context], total)])
        start = whole
        while start < total:
            at = self._level(total - start)
            if at is None:
                at = int(np.flatnonzero(self.level)[-1])
            part = ids[start : start + self.context - at]
            window = self._take(at)
            window.append((doc, start, part, total))
            start += len(part)
            if at + len(part) == self.context:
                yield from self.close(window)
            else:
                self.open[at + len(part)].append(window)
                self.level[at + len(part)] += 1

    def _level(self, size: int) -> int | None:
        """The level whose window takes a piece of this size; 0 is a new window, None that no window can."""
        # Moving a window from h to h + size changes the sum by 2 (N(h + size) - N(h) + 1); opening one by 2 N(size) + 1.
        never = np.iinfo(np.int64).max
        change = 2 * (self.level[size:] - self.level[: len(self.level) - size] + 1)
        change[-1] = 1 - 2 * self.level[self.context - size]
        change[self.level[: len(self.level) - size] == 0] = never
        change[0] = 2 * self.level[size] + 1 if self.level.sum() < OPEN else never
        at = len(change) - 1 - int(np.argmin(change[::-1]))  # of equal changes the fullest window
        return None if change[at] == never else at

    def _take(self, at: int) -> list[tuple]:
        if not at:
            return []
        self.level[at] -= 1
        return self.open[at].pop()

    def finish(self) -> Iterator[tuple]:
        """Closes what is open: the fullest windows, filled up from the emptiest, then the last one by powers of two."""
        left = [window for windows in self.open for window in windows]
        self.level[:], self.open = 0, [[] for _ in range(self.context + 1)]
        low, high = 0, len(left) - 1
        while low < high:
            room = self.context - sum(len(x[2]) for x in left[high])
            while room and low < high:
                doc, start, ids, total = left[low].pop()
                left[high].append((doc, start, ids[:room], total))
                if len(ids) > room:
                    left[low].append((doc, start + room, ids[room:], total))
                room -= min(room, len(ids))
                low += not left[low]
            if not room:
                yield from self.close(left[high])
                high -= 1
        if low == high:
            yield from self._last(left[low])

    def _last(self, pieces: list[tuple]) -> Iterator[tuple]:
        """One window's pieces, in windows of the powers of two that make up their length."""
        size = sum(len(x[2]) for x in pieces)
        window: list[tuple] = []
        room = 1 << size.bit_length() - 1
        for doc, start, ids, total in pieces:
            while len(ids):
                part, ids = ids[:room], ids[room:]
                window.append((doc, start, part, total))
                start, room, size = start + len(part), room - len(part), size - len(part)
                if not room:
                    yield from self.close(window)
                    window, room = [], 1 << max(size, 1).bit_length() - 1


def _pack(batches: Iterator[pa.RecordBatch], path: str, context: int, end_id: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(path, special=True)
    packer = Packer(context, TaskContext.get().partitionId() << 40)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * len(FIELDS))], names=list(FIELDS))

    for batch in batches:
        rows: list[tuple] = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = encode(text.as_py())
            ids.append(end_id)
            rows += packer.add(doc, np.array(ids, "<u4"))
        yield batch_of(rows)
    yield batch_of(list(packer.finish()))


def pack(docs: DataFrame, context: int = CONTEXT, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """Pieces of all rows of docs (doc_id, text), each document's ids followed by end_id, in windows of context ids.

    A row per piece: doc_id, start, length, ids_crc32 (of the piece's ids as little-endian uint32), doc_tokens,
    sequence_id, offset. Ids are those of the vocabulary file as it is: the string of a special token inside a text is
    that token. A null or empty text is end_id alone. Repeated rows are packed as often as they occur; null
    doc_ids stay null. Only windows whose fill is a power of two are short, so no window needs padding. Which windows
    result depends on the order of rows in a task; the pieces' contents don't. Other columns are ignored.
    """
    path = vocabulary or default_vocabulary()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _pack(it, path, context, end_id), ", ".join(f"{x} long" for x in FIELDS))
