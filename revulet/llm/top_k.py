"""Exact top-k by inner product, aggregating sorted lists without random access.

Queries and candidates are dealt out as a table of query blocks against candidate parts. Within a part, each block of
candidates has two lists of (value, id) for every component, by falling value and by falling negated value, so that a
query's weights are never negative: it reads the first where its component is positive, the second where it is
negative. Lists are read in step, from their heads on. An entry read raises its candidate's lower bound from the
list's far end to the value, and clears the list in the mask of those where the candidate is unread; the upper bound
adds, for each of these, what the last value read allows. A candidate is out once its upper bound is below the k-th
best of all lower bounds and of the scores known from earlier blocks; entries of candidates that are out for all queries
that read together are passed over. Reading stops for a query when every candidate left has been met in all lists that
can change its score, which resolves its score: it is then its lower bound, made of entries alone. Bounds are looked at each time the depth has doubled.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K, SCALE, EVERY = 10, 1024, 100
#: Queries of one block, candidates of one part, candidates whose lists are sorted together, queries that read together.
QUERY_BLOCK, PART, BLOCK, TOGETHER = 16384, 65536, 4096, 64
#: The depth of the first look at the bounds, as a part of a list.
FIRST_LOOK = 1 / 16
SCHEMA = "query_id long, vec_id long, score long"
#: Below every score.
NONE = np.iinfo(np.int64).min


def quantise(values: np.ndarray) -> np.ndarray:
    """floor(SCALE x) as integers; components of 2**62 and more after that raise an error."""
    scaled = np.floor(SCALE * values.astype(np.float64))
    if scaled.size and np.abs(scaled).max() >= 2.0**62:
        raise ArithmeticError("a component is too large for a score that is a long")
    return scaled.astype(np.int64)


class Search:
    """The best k candidates so far of a block of queries of one length."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.weight = np.concatenate([np.maximum(queries, 0), np.maximum(-queries, 0)], axis=1)
        self.score = np.full((len(ids), k), NONE)
        self.best = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.entries = 0

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Takes a block of candidates in."""
        if not len(ids) or not len(self.ids):
            return
        values = np.concatenate([x, -x], axis=1)
        if (self.weight.astype(np.float64) @ np.abs(values).max(axis=0)).max() >= 9.2e18:
            raise ArithmeticError("inner products are too large for a score that is a long")
        order = np.argsort(-values, axis=0, kind="stable")
        values = np.take_along_axis(values, order, 0)
        for low in range(0, len(self.ids), TOGETHER):
            self._read(np.arange(low, min(low + TOGETHER, len(self.ids))), ids, order, values)

    def _read(self, own: np.ndarray, ids: np.ndarray, order: np.ndarray, values: np.ndarray) -> None:
        """Reads the lists (places in ids, values) in step for the queries at own, until none can gain from them."""
        n, far = len(values), values[-1]
        weight = self.weight[own]
        lower = np.repeat((weight @ far)[None, :], n, axis=0)
        unread = np.ones(values.shape)
        alive = ids[:, None] != self.ids[own][None, :]
        read, until = 0, min(n, max(4 * self.k, int(FIRST_LOOK * n)))
        while len(own):
            wanted = alive.any(axis=1)
            for j in np.flatnonzero(weight.any(axis=0)):
                rows, gain = order[read:until, j], values[read:until, j] - far[j]
                if read:
                    rows, gain = rows[wanted[rows]], gain[wanted[rows]]
                lower[rows] += gain[:, None] * weight[:, j]
                unread[rows, j] = 0
                self.entries += len(rows) * int(np.count_nonzero(weight[:, j]))
            read = until
            if read == n:
                self._merge(own, ids, np.where(alive, lower, NONE))
                return
            # In floating point, with room for rounding: an upper bound may be too high, never too low.
            gain = unread @ (weight * (values[read - 1].astype(np.float64) - far)).T
            upper = lower + gain
            upper += 1e-9 * (np.abs(lower) + gain) + 1
            known = np.concatenate([np.where(alive, lower, NONE), self.score[own].T])
            need = np.partition(known, len(known) - self.k, axis=0)[len(known) - self.k]
            out = alive & (upper < need)
            alive &= ~out
            done = ~(alive & (gain > 0)).any(axis=0)
            if done.any():
                self._merge(own[done], ids, np.where(alive[:, done], lower[:, done], NONE))
                own, weight, lower, alive = own[~done], weight[~done], lower[:, ~done], alive[:, ~done]
            until = min(n, 2 * read)

    def _merge(self, own: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Keeps the best k of these scores (a column for each query at own) and those known; of equal scores, the smaller id."""
        n, k = len(score), self.k
        kth = np.partition(score, n - k, axis=0)[n - k] if n > k else np.full(len(own), NONE)
        c, q = np.nonzero((score > NONE) & (score >= np.maximum(kth, self.score[own].min(axis=1))))
        value = np.concatenate([self.score[own].ravel(), score[c, q]])
        who = np.concatenate([self.best[own].ravel(), ids[c]])
        q = np.concatenate([np.repeat(np.arange(len(own)), k), q])
        order = np.lexsort((who, ~value, q))  # ~ falls as the value rises, without overflow
        q, who, value = q[order], who[order], value[order]
        at = np.searchsorted(q, np.arange(len(own)))[:, None] + np.arange(k)
        self.best[own], self.score[own] = who[at], value[at]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        known = self.score > NONE
        return np.repeat(self.ids, known.sum(axis=1)), self.best[known], self.score[known]


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and quantised components of rows whose vectors have one length and no nulls."""
    ids = table["vec_id"].to_numpy()
    flat = table["embedding"].combine_chunks().flatten().to_numpy()
    return ids, quantise(flat.reshape(len(ids), -1))


def _searches(k: int, entries: Accumulator | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def search(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)] * 3
        if queries.num_rows and candidates.num_rows:
            own = Search(*_matrix(queries), k)
            for low in range(0, candidates.num_rows, BLOCK):
                own.add(*_matrix(candidates.slice(low, BLOCK)))
            found = own.rows()
            if entries is not None:
                entries.add(own.entries)
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in found], names=["query_id", "vec_id", "score"])

    return search


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, entries: Accumulator | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows of vectors (vec_id, embedding) for each query.

    Queries are the rows whose vec_id is divisible by every (of repeated ids, the smallest vector); components count as
    floor(1024 x) and scores are exact; where products are too large for a long, the job raises ArithmeticError. Of
    equal scores the smaller vec_id is first. Rows take no part if their vec_id or vector is null or a component is null or
    not finite; only vectors of the same length are compared. An empty table gives no rows. Repeated candidates count as
    often as they occur. Nothing but two counts comes to the driver: query blocks and candidate parts meet by a cogroup,
    whose groups have bounded sizes. entries, an accumulator, gets the number of list entries that
    went into bounds, for all queries together.
    """
    kind = vectors.schema["embedding"].dataType.simpleString()
    vector = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding")).where("vec_id is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    rows = rows.withColumn("size", F.size("embedding"))
    asked = F.col("vec_id") % every == 0
    n, queries = rows.agg(F.count("*"), F.count_if(asked)).first()
    blocks = max(1, -(-queries // QUERY_BLOCK))
    parts = max(1, -(-n // PART), min(vectors.sparkSession.sparkContext.defaultParallelism, n // 1024))

    def every_one(count: int):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    own = rows.where(asked).groupBy("vec_id", "size").agg(F.min("embedding").alias("embedding"))
    own = own.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("part", every_one(parts))
    others = rows.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int")).withColumn("block", every_one(blocks))
    keys = ["size", "block", "part"]
    found = own.groupBy(*keys).cogroup(others.groupBy(*keys)).applyInArrow(_searches(k, entries), SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
