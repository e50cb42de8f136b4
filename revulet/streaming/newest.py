"""The newest record of each review, kept as keyed state.

The state of a key is small: when its newest record was updated, that record's place and the key's first place. A
micro-batch is compared with the state of its own keys, and what changes is appended to a log, so a batch costs as much
as it holds, however large the table has grown. The table is the log's last word on each key; compact() shortens it.

State needs the RocksDB store: set spark.sql.streaming.stateStore.providerClass as in STATE_STORE.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.reviews import KEY, _cleaned, _keyed

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
STATE = "updated long, ordinal long, position long"


class Newest(StatefulProcessor):
    """Keeps (updated, ordinal, position) of a key and puts out its newest record of a batch if it beats the state's:
    updated later, or at the same time from an earlier place. Where only the first place changes, the record is null."""

    def __init__(self, forget_after_ms: int | None = None):
        self.forget_after_ms = forget_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("newest", STATE, self.forget_after_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.get() if self.state.exists() else None
        best, record = ((known[0], -known[1]) if known else None), None
        position = known[2] if known else None
        for batch in rows:
            order = batch.sort_values(["updated_ms", "ordinal"], ascending=[False, True]).iloc[0]
            first = int(batch["ordinal"].min())
            position = first if position is None else min(position, first)
            mine = (int(order["updated_ms"]), -int(order["ordinal"]))
            if best is None or mine > best:
                best, record = mine, order["record"]
        if record is not None or known is None or position != known[2]:
            self.state.update((best[0], -best[1], position))
            yield pd.DataFrame({**{name: [value] for name, value in zip(KEY, key)}, "updated_ms": [best[0]], "ordinal": [-best[1]], "position": [position], "record": [record]})

    def close(self) -> None:
        """Nothing is held outside the state."""


CHANGE = ", ".join(f"{k} string" for k in KEY) + ", updated_ms long, ordinal long, position long, record string"


def changes(stream: DataFrame, run_time: datetime, forget_after_ms: int | None = None) -> DataFrame:
    """The stream of changes (CHANGE) of a stream of raw records, which need an ordinal; record is the review as JSON.

    run_time stands in for dates that can't be read. With forget_after_ms a key that brings nothing new for so long
    loses its state, and counts as new when it comes back.
    """
    rows = _keyed(stream, run_time)
    keyed = rows.select(*KEY, F.unix_millis("updated_at").alias("updated_ms"), "ordinal", F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("record"))
    mode = "none" if forget_after_ms is None else "processingTime"
    return keyed.groupBy(*KEY).transformWithStateInPandas(Newest(forget_after_ms), CHANGE, "update", mode)


def follow(stream: DataFrame, table: str, checkpoint: str, run_time: datetime, forget_after_ms: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Appends the changes of each micro-batch to the folder table. A batch that is run again replaces what it wrote."""

    def apply(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number:010d}")

    writer = changes(stream, run_time, forget_after_ms).writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _latest(log: DataFrame) -> DataFrame:
    """CHANGE of each key, of all its changes: the record updated last, the first of equals, and the first place."""
    some = F.col("record").isNotNull()
    order = F.when(some, F.struct("updated_ms", (-F.col("ordinal")).alias("early")))
    newest = F.max_by(F.struct("updated_ms", "ordinal", "record"), order)
    return log.groupBy(*KEY).agg(newest.alias("r"), F.min("position").alias("position")).select(*KEY, "r.updated_ms", "r.ordinal", "position", "r.record")


def table_of(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """The cleaned newest reviews with position, as operators.reviews.latest() gives them for all records at once; schema is
    that of changes()' records (see record_schema)."""
    log = spark.read.schema(CHANGE).option("recursiveFileLookup", True).parquet(table)
    rows = _latest(log).select(F.from_json("record", schema).alias("r"), "position").select("r.*", "position")
    return _cleaned(rows)


def record_schema(raw: DataFrame, run_time: datetime) -> str:
    """The DDL of the records that changes() makes of such raw records."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in _keyed(raw, run_time).schema.fields)


def compact(spark: SparkSession, table: str, target: str) -> None:
    """Writes the log's last word on each key to target, which then takes the place of table for a new query."""
    _latest(spark.read.schema(CHANGE).option("recursiveFileLookup", True).parquet(table)).write.mode("errorifexists").parquet(f"{target}/batch={0:010d}")
