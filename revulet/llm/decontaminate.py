"""Benchmark decontamination over a distributed positional inverted index. DataFrame functions only.

The index stores a row (term, doc_id, position) for every training word that is a test word, and a row with an empty
term and the word count for each document. A test window's terms are ordered by the number of their postings. The
lists of the two rarest, shifted by their offsets in the window, are intersected first; what is left is intersected
with the lists of all other terms, of the documents concerned, and matches where all lists meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WINDOW = 10
#: Rows up to which a side of a join is broadcast; beyond it, the join shuffles both sides.
BROADCAST_ROWS = 500_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text with A-Z in lower case; none for null. Only ASCII letters change."""
    plain = F.octet_length(text) == F.char_length(text)
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def test_windows(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Two tables: window (a digest of its words), terms, and window, item_id.

    A window is `window` consecutive words of an item (item_id, text); a shorter item with words is one window.
    """
    n = F.size("w")
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text").cast("string")).alias("w")).where(n > 0)
    starts = F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1)))
    cut = rows.select("item_id", "w", F.explode(starts).alias("at")).select("item_id", F.slice("w", F.col("at"), window).alias("terms"))
    cut = cut.withColumn("window", F.md5(F.concat_ws(" ", "terms"))).distinct()
    return cut.select("window", "terms").dropDuplicates(["window"]), cut.select("window", "item_id").where("item_id is not null").distinct()


def build_index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Postings term, doc_id, position (from 0) of all words of docs that occur in vocabulary (term).

    For each document also a row with term '' whose position is its number of words.
    """
    every = vocabulary.select("term").where("term <> ''").distinct().union(vocabulary.sparkSession.createDataFrame([("",)], "term string"))
    tokens = words(F.col("text").cast("string"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tokens.alias("tokens")).where("doc_id is not null")
    flat = rows.select("doc_id", F.posexplode(F.concat("tokens", F.array(F.lit("")))).alias("position", "term"))
    return flat.join(bounded(every), "term").select("term", "doc_id", "position")


def _offsets(windows: DataFrame, index: DataFrame) -> DataFrame:
    """window, length, offset, term, rank: each window's places, from the term with the fewest postings on; only
    windows all of whose terms have postings."""
    counts = index.where("term <> ''").groupBy("term").agg(F.count("*").alias("postings"))
    flat = windows.select("window", F.size("terms").alias("length"), F.posexplode("terms").alias("offset", "term")).join(counts, "term")
    order = Window.partitionBy("window").orderBy("postings", "term", "offset")
    ranked = flat.withColumn("rank", F.row_number().over(order)).withColumn("found", F.count("*").over(Window.partitionBy("window")))
    return ranked.where("found = length").select("window", "length", "offset", "term", "rank")


def phrase_matches(index: DataFrame, windows: DataFrame, tmp: C.Scratch | None = None) -> DataFrame:
    """doc_id, window, start, length: every exact occurrence of every window (window, terms)."""
    tmp = tmp or C.Scratch()
    offsets = tmp.written(_offsets(windows, index), "offsets")

    def shifted(rank: int) -> DataFrame:
        own = bounded(offsets.where(F.col("rank") == rank))
        return index.join(own, "term").select("doc_id", "window", (F.col("position") - F.col("offset")).alias("start"), "length").where("start >= 0")

    single = shifted(1).where("length = 1")
    begun = shifted(1).where("length > 1").join(shifted(2).select("doc_id", "window", "start"), ["doc_id", "window", "start"], "left_semi")
    begun = tmp.written(begun, "begun")
    own = bounded(begun.select("doc_id").distinct())
    lists = index.join(own, "doc_id", "left_semi")
    wanted = begun.join(bounded(offsets.where("rank > 2").select("window", "offset", "term")), "window").select("doc_id", "window", "start", "length", (F.col("start") + F.col("offset")).alias("position"), "term")
    met = wanted.join(lists, ["doc_id", "position", "term"]).groupBy("doc_id", "window", "start", "length").agg(F.count("*").alias("met")).where("met = length - 2").drop("met")
    return single.union(begun.where("length = 2").select(single.columns)).union(met.select(single.columns))


def proximity_matches(index: DataFrame, windows: DataFrame, slop: int) -> DataFrame:
    """doc_id, window, position: places of a window's rarest term with each of its other terms within slop words."""
    slop = max(slop, 1)
    offsets = C.written(_offsets(windows, index), "offsets")
    terms = offsets.select("window", "term").distinct()
    total = terms.groupBy("window").agg(F.count("*").alias("total"))
    rarest = offsets.where("rank = 1").select("window", "term").join(total, "window")
    around = index.join(rarest, "term").select("doc_id", "window", F.col("position").alias("at"), "total")
    block = F.floor(F.col("at") / slop).cast("long")
    wanted = around.join(terms, "window").withColumn("block", F.explode(F.array(block - 1, block, block + 1)))
    lists = index.withColumn("block", F.floor(F.col("position") / slop).cast("long"))
    near = wanted.join(lists, ["doc_id", "term", "block"]).where(F.abs(F.col("position") - F.col("at")) <= slop)
    found = near.select("doc_id", "window", "at", "total", "term").distinct().groupBy("doc_id", "window", "at", "total").agg(F.count("*").alias("n"))
    return found.where("n = total").select("doc_id", "window", F.col("at").alias("position"))


def _matches(docs: DataFrame, items: DataFrame, window: int, tmp: C.Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    windows, of_items = test_windows(items, window)
    windows = tmp.written(windows, "windows")
    index = tmp.written(build_index(docs, windows.select(F.explode("terms").alias("term"))), "postings")
    return index, of_items, tmp.written(phrase_matches(index, windows, tmp), "matches")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in an occurrence of a window of items (item_id, text). n_items counts the items with
    occurring windows; items_sha256 is of their ids, sorted as strings and joined by commas. Null and empty texts have
    no words. Rows without doc_id or item_id are left out; rows of one doc_id are judged each by its own text; other
    columns are ignored.
    """
    with C.Scratch() as tmp:
        if again := C.numbered(docs, tmp):
            return C.written(C.own_ids(*again, contamination(C.as_documents(*again), items, window)), "contamination")
        index, of_items, matches = _matches(docs, items, window, tmp)
        covered = matches.select("doc_id", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("position")).distinct()
        hits = covered.groupBy("doc_id").agg(F.count("*").alias("n_hit"))
        found = matches.select("doc_id", "window").distinct().join(of_items, "window").select("doc_id", F.col("item_id").cast("string").alias("item")).distinct()
        lists = found.groupBy("doc_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
        marks = hits.join(lists, "doc_id", "full_outer")
        base = index.where("term = ''").select("doc_id", F.col("position").cast("long").alias("n_words"))
        items_of = F.coalesce("items", F.array().cast("array<string>"))
        out = base.join(marks, "doc_id", "left").select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.size(items_of).cast("long").alias("n_items"),
            F.sha2(F.concat_ws(",", items_of), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
        return C.written(out, "contamination")


def keep_clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs in which no window of items occurs, with all their columns; rows without doc_id stay."""
    if again := C.numbered(docs, C.Scratch()):
        rows, row = again
        with C.Scratch() as tmp:
            hit = C.written(_matches(C.as_documents(rows, row), items, window, tmp)[2].select(F.col("doc_id").alias(row)).distinct(), "hit")
        return rows.join(hit, row, "left_anti").select(*docs.columns)
    with C.Scratch() as tmp:
        hit = C.written(_matches(docs, items, window, tmp)[2].select(F.col("doc_id").alias("_hit")).distinct(), "hit")
    return docs.join(hit, docs["doc_id"] == hit["_hit"], "left_anti")
