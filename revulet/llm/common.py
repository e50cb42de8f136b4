"""Shared pieces of the text operators: input adaptation, batching, hashing of words and windows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step handles; a longer text is a step of its own.
STEP_BYTES = 1 << 19


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(plain_table(spark, sf_dir, name))


def plain_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as its files are split."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows, dealt out to all cores where the files have fewer splits than there are cores: a table of one row group
    is a single task's work otherwise. Tables of many splits stay as they are and are not exchanged."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a local one where that is unset."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir", None)
    if where:
        return where
    if sc.getCheckpointDir() is None:
        import tempfile

        sc.setCheckpointDir(tempfile.mkdtemp(prefix="revulet-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df by way of a reliable checkpoint: its lineage ends at files in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df by way of Parquet in the shared folder; it stays there."""
    return Scratch().written(df, name)


def written_alone(df: DataFrame, name: str) -> DataFrame:
    """df by way of Parquet as written() does it; its exchanges' files go when it is written, not when the driver's
    memory happens to be cleared. For tables whose exchanges hold whole texts."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = conf.get(key, None)
    conf.set(key, "true")
    try:
        return written(df, name)
    finally:
        conf.unset(key) if was is None else conf.set(key, was)


class Scratch:
    """Tables in the shared folder that go when the block ends: with Scratch() as tmp: tmp.written(df, name)."""

    def __init__(self) -> None:
        self.paths: list[tuple[SparkSession, str]] = []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
        self.paths.append((df.sparkSession, path))
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *failure) -> None:
        for spark, path in self.paths:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def counted_apart(df: DataFrame, keys: list[str], *measures) -> DataFrame:
    """keys, n (their number of rows) and measures, to be joined with the rows that were counted.

    Grouping by one column more keeps the groups' exchange from serving the join too. So the join has an exchange on
    either side, and adaptive execution splits the keys that very many rows have.
    """
    return df.groupBy(*keys, F.pmod(F.xxhash64(*keys), F.lit(2)).alias("_half")).agg(F.count("*").alias("n"), *measures).drop("_half")


def numbered(docs: DataFrame, tmp: Scratch, *order) -> tuple[DataFrame, str] | None:
    """Where a doc_id occurs twice: docs, written, with a column that tells its rows apart, and that column's name.

    Its numbers follow `order`, if given. Usually doc_ids are unique; this then returns None and costs an aggregation
    of the ids.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("_id")).where("_id is not null")
    if ids.groupBy("_id").agg(F.count("*").alias("_n")).where("_n > 1").isEmpty():
        return None
    row = "_row"
    while row in docs.columns:
        row += "_"
    if order:
        docs = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    return tmp.written(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def as_documents(rows: DataFrame, row: str) -> DataFrame:
    """The rows of numbered() that have a doc_id, under their own numbers: doc_id (the number), text."""
    return rows.where(F.col("doc_id").cast("long").isNotNull()).select(F.col(row).alias("doc_id"), F.col("text").cast("string").alias("text"))


def own_ids(rows: DataFrame, row: str, found: DataFrame) -> DataFrame:
    """found (doc_id is a number of numbered(), and more) with the doc_ids of its rows."""
    ids = rows.select(F.col(row).alias("_number"), F.col("doc_id").cast("long").alias("_doc_id"))
    return found.join(ids, found["doc_id"] == ids["_number"]).select(F.col("_doc_id").alias("doc_id"), *(found[c] for c in found.columns if c != "doc_id"))


def bucket_of(col: str, modulus: int):
    """crc32 of the id as text, modulo modulus."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % modulus


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most limit bytes of text; one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n+1 offsets of its rows in them; nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    kind = np.int64 if wide else np.int32
    _, index, data = column.buffers()
    if n == 0 or index is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(index, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    low, high = int(offsets[0]), int(offsets[-1])
    body = np.frombuffer(data, np.uint8)[low:high] if data is not None else np.zeros(0, np.uint8)
    return body, offsets - low


def longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


# --- hashing: polynomials modulo 2**64 over mixed symbols -------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """base**i and base**-i modulo 2**64, grown as needed."""

    def __init__(self, base: int):
        self.base = base | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = -(-n // (1 << 16)) << 16
            for name, base in (("up", self.base), ("down", self.inverse)):
                factor = np.full(size, base, np.uint64)
                factor[0] = 1
                setattr(self, name, np.multiply.accumulate(factor))
        return self.up[:n], self.down[:n]


BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE, _WORD_A, _WORD_B = Powers(0x5851F42D4C957F2D), Powers(0xD1342543DE82EF95), Powers(0x2545F4914F6CDD1D)


def span_hash(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of symbols[start:end] for every pair; equal runs of symbols have equal hashes."""
    up, down = powers.to(len(symbols) + 1)
    total = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * up[: len(symbols)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def byte_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(BYTES[data], starts, ends, _BYTE)


SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends in data of the runs without ASCII white space, and the n+1 offsets of each row's words."""
    full = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = True
    before[1:] = ~full[:-1]
    starts = np.flatnonzero(full & (before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = True
    after[:-1] = ~full[1:]
    ends = np.flatnonzero(full & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def windows(symbols: np.ndarray, offsets: np.ndarray, width: int, two: bool = False):
    """Row and place in the row of every window of width symbols within one row, with one or two 64-bit hashes."""
    n = len(symbols)
    count = np.maximum(np.diff(offsets) - width + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = offsets[:-1][row] + place
    first = span_hash(symbols, at, at + width, _WORD_A) if n else np.zeros(0, np.uint64)
    if not two:
        return row, place, first
    return row, place, first, span_hash(symbols, at, at + width, _WORD_B) if n else np.zeros(0, np.uint64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def covered(at: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in a window of width that starts at one of at."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, np.minimum(at + width, n), -1)
    return np.cumsum(step[:n]) > 0
