"""Near-duplicates by DartMinHash over word shingles.

A text is a weighted set: its runs of SHINGLE words with their numbers of occurrences. Every unit of weight of every
element receives darts at the times of a Poisson process that its hash drives, each at a hashed coordinate; a text's
signature is the earliest dart at each coordinate. Two texts share a coordinate's dart with a probability equal to
their weighted Jaccard similarity. Only darts before a time that the total weight sets are thrown, so most elements
of a long text throw none; the few texts left with an empty coordinate throw on.

Banded signatures name candidates, which are compared exactly. Equal sets count once. A bucket's members are compared
with its hub, the member that shares most buckets with others, and with their neighbours in the order of another band:
most links that matter for classes run through hubs, so these pairs stay linear in a bucket's size. The members of all
buckets that then hold several classes are joined once more, each with those of all other classes, by a prefix filter
that loses no pair; so no pair of different classes in a common bucket stays uncompared, unless it can't be similar.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
#: Members that share a unit and meet in one task; more are dealt by a salt.
MEET = 256
_SYMBOL = C.Powers(0x9FB21C651E98DF25)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each unit of weight: the c-th occurrence of a run of words differs from the others. A text with
    fewer words than width, but not none, is one run."""
    starts, ends, index = C.words(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = C.byte_hash(data, starts, ends)
    row, _, run = C.windows(word, index, width)
    count = np.diff(index)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        row = np.concatenate([row, short])
        run = np.concatenate([run, C.span_hash(word, index[short], index[short + 1], _SYMBOL)])
    order = np.lexsort((run, row))
    row, run = row[order], run[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (run[1:] != run[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
    copy = (np.arange(len(row)) - first).astype(np.uint64)
    return row, C.mix(run + copy * np.uint64(0x9E3779B97F4A7C15))


def signatures(row: np.ndarray, unit: np.ndarray, n: int, k: int) -> np.ndarray:
    """The n x k matrix of each text's earliest darts; zeros for a text without weight."""
    out = np.zeros((n, k), np.uint64)
    weight = np.bincount(row, minlength=n)
    limit = np.where(weight > 0, k * (np.log(k) + 2) / np.maximum(weight, 1), 0)
    todo = weight > 0
    while todo.any():
        mine = todo[row]
        where, what, time = row[mine], unit[mine], np.zeros(int(mine.sum()))
        slots, times, darts = [], [], []
        throw = 0
        while len(where):
            throw += 1
            dart = C.mix(what + np.uint64(throw * 0xC2B2AE3D27D4EB4F % 2**64))
            time = time - np.log(((dart >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53)
            early = time < limit[where]
            where, what, time, dart = where[early], what[early], time[early], dart[early]
            slots.append(where * k + (C.mix(dart) % np.uint64(k)).astype(np.int64))
            times.append(time)
            darts.append(dart)
        slot, time, dart = np.concatenate(slots), np.concatenate(times), np.concatenate(darts)
        order = np.lexsort((dart, time, slot))
        slot, dart = slot[order], dart[order]
        first = np.ones(len(slot), bool)
        first[1:] = slot[1:] != slot[:-1]
        filled = np.zeros(n * k, bool)
        filled[slot[first]] = True
        done = todo & filled.reshape(n, k).all(axis=1)
        take = first & done[slot // k]
        out.ravel()[slot[take]] = dart[take]
        todo &= ~done
        limit[todo] *= 2
    return out


def bands(signature: np.ndarray, count: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """The n x count matrix of hashes of rows coordinates each."""
    parts = signature.reshape(len(signature), count, rows)
    total = np.arange(1, count + 1, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93)
    for i in range(rows):
        total = C.mix(total ^ parts[:, :, i])
    return total


def _signed(batches: Iterator[pa.RecordBatch], count: int, rows: int, width: int) -> Iterator[pa.RecordBatch]:
    """For each text with words: doc_id, a 128-bit key of its weighted set, and its bands."""
    for batch in C.steps(batches):
        n = batch.num_rows
        row, unit = shingles(*C.utf8(batch.column(1)), width)
        weight = np.bincount(row, minlength=n)
        cut = np.cumsum(weight)
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(C.mix(unit ^ np.uint64(salt)))]) for salt in (0x1B873593, 0xE6546B64)]
        keys = [C.mix((s[cut] - s[cut - weight]) + weight.astype(np.uint64)) for s in sums]
        own = bands(signatures(row, unit, n, count * rows), count, rows)
        full = weight > 0
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).filter(pa.array(full)), *(pa.array(C.signed(k[full])) for k in keys), pa.FixedSizeListArray.from_arrays(pa.array(C.signed(own[full]).ravel()), count).cast(pa.list_(pa.int64()))],
            names=["doc_id", "key_a", "key_b", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """doc_id and its weighted set: sorted 32-bit hashes of its units of weight."""
    for batch in C.steps(batches):
        row, unit = shingles(*C.utf8(batch.column(1)), width)
        short = (unit >> np.uint64(32)).astype("<u4")
        order = np.lexsort((short, row))
        cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
        short = short[order]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([short[cut[i] : cut[i + 1]].tobytes() for i in range(batch.num_rows)], pa.binary())], names=["doc_id", "units"])


def _similar(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for one, other in zip(batch.column(2), batch.column(3), strict=True):
            a, b = np.frombuffer(one.as_buffer(), "<u4"), np.frombuffer(other.as_buffer(), "<u4")
            if min(len(a), len(b)) < least * max(len(a), len(b)):
                keep.append(False)
                continue
            both = np.sort(np.concatenate([a, b]), kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            keep.append(common >= least * (len(a) + len(b) - common))
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """doc_id, label: for each document in edges (a, b) the smallest one it is connected with.

    First every document moves to the smallest of itself and its neighbours, and edges move along: those that become
    loops or the same go, so what a class of many links leaves is few edges, and all links are read once only. Along
    the rest labels spread and are then looked up in one another, so the number of rounds grows with the logarithm of
    the paths' lengths; each round's labels are cut off from their lineage.
    """
    both = edges.select("a", "b").union(edges.select("b", "a"))
    moved = C.cut(both.groupBy(F.col("a").alias("doc_id")).agg(F.least(F.min("b"), F.min("a")).alias("to")))
    left = edges.join(moved.select(F.col("doc_id").alias("a"), F.col("to").alias("low")), "a").join(moved.select(F.col("doc_id").alias("b"), F.col("to").alias("high")), "b")
    left = left.where("low <> high").select(F.least("low", "high").alias("a"), F.greatest("low", "high").alias("b")).distinct()
    both = C.cut(left.union(left.select("b", "a")))
    labels = C.cut(both.groupBy(F.col("a").alias("doc_id")).agg(F.least(F.min("b"), F.min("a")).alias("label")))
    while not both.isEmpty():
        near = both.join(labels.withColumnRenamed("doc_id", "b"), "b").groupBy(F.col("a").alias("doc_id")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "doc_id").select("doc_id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        through = labels.select(F.col("doc_id").alias("label"), F.col("label").alias("through"))
        now = C.cut(spread.join(through, "label", "left").select("doc_id", "was", F.least("label", F.coalesce("through", "label")).alias("label")))
        labels = now.select("doc_id", "label")
        if now.where("label <> was").isEmpty():
            break
    return moved.join(labels.withColumnRenamed("doc_id", "to"), "to", "left").select("doc_id", F.coalesce("label", "to").alias("label"))


def _pairs(members: DataFrame, hubs: DataFrame) -> DataFrame:
    pair = members.join(hubs, ["band", "bucket"]).where("doc_id <> hub")
    return pair.select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    first = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("units").alias("one")), "a")
    second = first.join(sets.select(F.col("doc_id").alias("b"), F.col("units").alias("other")), "b")
    return second.select("a", "b", "one", "other").mapInArrow(lambda it: _similar(it, least), "a long, b long")


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, label, size and unit: a row for each unit of weight of the sets (doc_id, label, units)."""
    for batch in batches:
        sets = [np.unique(np.frombuffer(x.as_buffer(), "<u4")) for x in batch.column(2)]
        sizes = np.array([len(x) for x in sets], np.int64)
        at = pa.array(np.repeat(np.arange(len(sets)), sizes))
        unit = np.concatenate([*sets, np.zeros(0, "<u4")]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(sizes).take(at), pa.array(unit)], names=["doc_id", "label", "size", "unit"])


def _across(members: DataFrame, labels: DataFrame, sets: DataFrame, least: float, tmp: C.Scratch) -> DataFrame:
    """Pairs (a, b) of different classes, among the members of buckets with several classes, that can be similar.

    Units that only one class has come first in the order, then rare ones. Similar sets have their first common unit
    among the first size - least * size + 1 of both, and at a place after which enough is left in both.
    """
    classed = members.select("doc_id", "band", "bucket").join(labels, "doc_id", "left").select("doc_id", "band", "bucket", F.coalesce("label", "doc_id").alias("label"))
    mixed = classed.groupBy("band", "bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("band", "bucket")
    left = classed.join(mixed, ["band", "bucket"]).select("doc_id", "label").distinct()
    units = tmp.written(sets.join(left, "doc_id").select("doc_id", "label", "units").mapInArrow(_units, "doc_id long, label long, size long, unit long"), "units")
    common = C.counted_apart(units, ["unit"], F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("unit", F.col("n").alias("having"))
    own = Window.partitionBy("doc_id")
    place = F.col("size") - F.count("*").over(own) + F.row_number().over(own.orderBy("having", "unit"))
    placed = units.join(common, "unit").withColumn("place", place)
    prefix = tmp.written(placed.where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1).select("unit", "doc_id", "label", "size", "place"), "prefix")
    parts = C.counted_apart(prefix, ["unit"], F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("unit", F.ceil(F.col("n") / MEET).alias("parts"))
    dealt = prefix.join(parts, "unit")
    one = dealt.select("unit", F.pmod(F.xxhash64("doc_id"), F.col("parts")).alias("part"), *(F.col(c).alias(f"{c}_a") for c in ("doc_id", "label", "size", "place")))
    other = dealt.select("unit", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), *(F.col(c).alias(f"{c}_b") for c in ("doc_id", "label", "size", "place")))
    rest = 1 + F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    fits = (F.col("doc_id_a") < F.col("doc_id_b")) & (F.col("label_a") != F.col("label_b")) & (rest >= (F.col("size_a") + F.col("size_b")) * (least / (1 + least)) - 1e-9)
    return one.join(other, (one["unit"] == other["unit"]) & (one["part"] == other["part"]) & fits).select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, width: int = SHINGLE, count: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id of each row of docs (doc_id, text).

    A class is what links connect: two texts are linked if the weighted Jaccard similarity of their runs of `width`
    words is at least `similarity`. class_id is the smallest doc_id of the class. Equal texts share a class. Null
    texts and texts without words are classes of their own; a text with fewer words than width is one run. Rows
    without doc_id are left out; rows of one doc_id are classed each by its own text; other columns are ignored.

    A pair at the threshold shares no band with a probability of (1 - similarity**rows)**count, three in a million.
    """
    with C.Scratch() as tmp:
        if again := C.numbered(docs, tmp):
            classes = _classes_of_rows(*again, similarity=similarity, width=width, count=count, rows=rows)
            return C.written(classes.select("doc_id", "class_id"), "classes")
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
        signed = tmp.written(texts.mapInArrow(lambda it: _signed(it, count, rows, width), "doc_id long, key_a long, key_b long, bands array<long>"), "bands")
        first = C.counted_apart(signed, ["key_a", "key_b"], F.min("doc_id").alias("rep"))
        of_set = signed.select("doc_id", "key_a", "key_b").join(first, ["key_a", "key_b"]).select("doc_id", "rep")
        reps = signed.join(first.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
        # A bucket's order is that of the next band, so texts with both bands in common lie side by side.
        placed = reps.select("doc_id", F.col("bands"), F.posexplode("bands").alias("band", "bucket")).select("doc_id", "band", "bucket", F.element_at("bands", (F.col("band") + 1) % count + 1).alias("next"))
        sizes = C.counted_apart(placed, ["band", "bucket"]).where("n > 1").withColumnRenamed("n", "size")
        members = tmp.written(placed.join(sizes, ["band", "bucket"]), "members")
        central = members.groupBy("doc_id").agg(F.sum("size").alias("degree"))
        members = tmp.written(members.drop("size").join(central, "doc_id"), "members")
        hubs = members.groupBy("band", "bucket").agg(F.max(F.struct("degree", (-F.col("doc_id")).alias("hub"))).alias("best")).select("band", "bucket", (-F.col("best.hub")).alias("hub"))
        side = Window.partitionBy("band", "bucket", F.pmod("next", F.lit(64))).orderBy("next", "doc_id")
        chain = members.select(F.lag("doc_id").over(side).alias("a"), F.col("doc_id").alias("b")).where("a is not null")
        chain = chain.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = tmp.written(_pairs(members, hubs).union(chain).distinct(), "pairs")
        needed = members.select("doc_id").distinct()
        sets = tmp.written(texts.join(needed, "doc_id", "left_semi").mapInArrow(lambda it: _sets(it, width), "doc_id long, units binary"), "sets")
        links = tmp.written(_verified(pairs, sets, similarity), "links")
        labels = C.cut(components(links))
        # What hubs and neighbours don't show: all members of buckets that still hold several classes.
        more = tmp.written(_across(members, labels, sets, similarity, tmp).join(pairs, ["a", "b"], "left_anti"), "pairs")
        found = tmp.written(_verified(more, sets, similarity), "links")
        if not found.isEmpty():
            # Classes go on as stars: their links need not be read again.
            labels = components(labels.select(F.col("label").alias("a"), F.col("doc_id").alias("b")).union(found))
        classes = of_set.join(labels.withColumnRenamed("doc_id", "rep"), "rep", "left").select("doc_id", F.coalesce("label", "rep").alias("class_id"))
        # What was written for it goes, so the result, two numbers a row, is written too.
        return C.written(texts.select("doc_id").join(classes, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id")), "classes")


def _classes_of_rows(own: DataFrame, row: str, **options) -> DataFrame:
    """number, doc_id, class_id, first (the number of the class's first row) of the rows that numbered() gives."""
    classes = near_duplicates(C.as_documents(own, row), **options)
    ids = own.select(F.col(row).alias("number"), F.col("doc_id").cast("long").alias("doc_id"))
    placed = ids.join(classes.select(F.col("doc_id").alias("number"), F.col("class_id").alias("group")), "number")
    least = placed.groupBy("group").agg(F.min(F.struct("doc_id", "number")).alias("least"))
    return placed.join(least, "group").select("number", "doc_id", F.col("least.doc_id").alias("class_id"), F.col("least.number").alias("first"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that are the first of their class, with all their columns; rows without doc_id stay.

    The first has the smallest doc_id; of several rows with that doc_id one stays.
    """
    if again := C.numbered(docs, C.Scratch()):
        rows, row = again
        later = C.written(_classes_of_rows(rows, row, **options).where("number <> first").select(F.col("number").alias(row)), "later")
        return rows.join(later, row, "left_anti").select(*docs.columns)
    later = near_duplicates(docs, **options).where("doc_id <> class_id").select(F.col("doc_id").alias("_later"))
    return docs.join(later, docs["doc_id"] == later["_later"], "left_anti")
