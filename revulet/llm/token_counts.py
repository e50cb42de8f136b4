"""Token counts by an exact length histogram.

Documents are aggregated by encoded length. The histogram has a row for each length that occurs, however many
documents there are, and running sums over it answer every context limit exactly: documents within and beyond it,
quantiles, and tokens left after truncation.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .tokens import default_vocabulary, encoder

#: Lengths in one block of the running sums.
BLOCK = 512


def _lengths(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encode = encoder(path)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(encode(x.as_py())) for x in batch.column(1)], pa.int64())], names=["doc_id", "n_tokens"])


def token_lengths(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens of each row of docs (doc_id, text); null and empty texts have none. Other columns are ignored."""
    path = vocabulary or default_vocabulary()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda it: _lengths(it, path), "doc_id long, n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, docs: a row for each length that occurs."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("docs"))


def limits(counts: DataFrame) -> DataFrame:
    """For each length in counts (n_tokens, docs), taken as a context limit, the exact figures over all documents.

    context_limit, docs (of just that length), docs_within (at most that long), docs_beyond, quantile (docs_within of
    all), tokens_within, tokens_truncated (left if each document is cut to the limit), tokens_total. An empty table has
    no limits. Sums run within blocks of lengths and then over the blocks, so no task holds all lengths of a large
    range.
    """
    h = counts.withColumn("tokens", F.col("n_tokens") * F.col("docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    blocks = h.groupBy("block").agg(F.sum("docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    sums = blocks.select(
        "block",
        F.coalesce(F.sum("block_docs").over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.sum("block_tokens").over(before), F.lit(0)).alias("tokens_before"),
        F.sum("block_docs").over(whole).alias("docs_total"),
        F.sum("block_tokens").over(whole).alias("tokens_total"),
    )
    inner = Window.partitionBy("block").orderBy("n_tokens")
    out = h.join(sums, "block").select(
        F.col("n_tokens").alias("context_limit"),
        "docs",
        (F.col("docs_before") + F.sum("docs").over(inner)).alias("docs_within"),
        (F.col("tokens_before") + F.sum("tokens").over(inner)).alias("tokens_within"),
        "docs_total",
        "tokens_total",
    )
    return out.select(
        "context_limit",
        "docs",
        "docs_within",
        (F.col("docs_total") - F.col("docs_within")).alias("docs_beyond"),
        (F.col("docs_within") / F.col("docs_total")).alias("quantile"),
        "tokens_within",
        (F.col("tokens_within") + F.col("context_limit") * (F.col("docs_total") - F.col("docs_within"))).alias("tokens_truncated"),
        "tokens_total",
    )


def at_limit(counts: DataFrame, limit: int) -> DataFrame:
    """One row for any limit, whether or not a document has that length: docs_within, docs_beyond, tokens_truncated."""
    cut = F.least(F.col("n_tokens"), F.lit(limit))
    return counts.agg(
        F.coalesce(F.sum(F.when(F.col("n_tokens") <= limit, F.col("docs"))), F.lit(0)).alias("docs_within"),
        F.coalesce(F.sum(F.when(F.col("n_tokens") > limit, F.col("docs"))), F.lit(0)).alias("docs_beyond"),
        F.coalesce(F.sum(cut * F.col("docs")), F.lit(0)).alias("tokens_truncated"),
    )


def length_at_quantile(counts: DataFrame, q: float) -> DataFrame:
    """One row, n_tokens: the least length that at least the share q of all documents stays within."""
    return limits(counts).where(F.col("quantile") >= q).agg(F.min("context_limit").alias("n_tokens"))


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """limits() of all rows of docs (doc_id, text). Texts are encoded once; the histogram is cut off from them."""
    return limits(cut(histogram(token_lengths(docs, vocabulary))))
