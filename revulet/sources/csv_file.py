"""One CSV file as a sink: df.write.format("csv-file").option("path", file).mode("append" or "overwrite").save()

Tasks write parts beside the file, in the order of their partitions; the commit joins them behind a byte order mark and
the header, a piece at a time, and puts the result in place by renaming it. A job that fails leaves neither parts nor a
file, and a file that is there stays as it was. All cells are quoted, lines end with CRLF. "append" wants a new file: one
that is there is an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .feed_source import _files

BOM, PIECE = "﻿".encode(), 1 << 22


@dataclass
class Part(WriterCommitMessage):
    number: int
    path: str


def line(cells) -> bytes:
    return (",".join('"' + ("" if c is None else str(c)).replace('"', '""') + '"' for c in cells) + "\r\n").encode()


class Writer(DataSourceWriter):
    def __init__(self, path: str, columns: list[str], overwrite: bool):
        self.path, self.columns, self.overwrite = path, columns, overwrite
        self.parts = f"{path}.{uuid.uuid4().hex}.parts"
        self._absent()

    def _absent(self) -> None:
        from pyarrow import fs

        system, path = _files(self.path)
        if not self.overwrite and system.get_file_info(path).type != fs.FileType.NotFound:
            raise FileExistsError(f"{self.path} is there already.")

    def write(self, rows: Iterator) -> Part:
        task = TaskContext.get()
        system, folder = _files(self.parts)
        system.create_dir(folder, recursive=True)
        path = f"{folder}/{task.partitionId():08d}-{task.taskAttemptId()}"
        with system.open_output_stream(path) as out:
            for row in rows:
                out.write(line(row))
        return Part(task.partitionId(), path)

    def commit(self, messages: list[Part | None]) -> None:
        self._absent()
        system, path = _files(self.path)
        _, folder = _files(self.parts)
        system.create_dir(folder, recursive=True)
        joined = f"{folder}/joined"
        with system.open_output_stream(joined) as out:
            out.write(BOM + line(self.columns))
            for part in sorted((m for m in messages if m), key=lambda m: m.number):
                with system.open_input_stream(part.path) as own:
                    while piece := own.read(PIECE):
                        out.write(piece)
        system.move(joined, path)
        system.delete_dir(folder)

    def abort(self, messages: list[Part | None]) -> None:
        from pyarrow import fs

        system, folder = _files(self.parts)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class CsvFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "csv-file"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if not self.options.get("path"):
            raise ValueError("csv-file needs a path.")
        return Writer(self.options["path"], schema.names, overwrite)


def save(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """rows, of strings, as one CSV file in their order."""
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(CsvFile)
    rows.write.format("csv-file").option("path", path).mode("overwrite" if overwrite else "append").save()
