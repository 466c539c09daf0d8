"""A sink for ordered reports: tasks write their lines apart, the driver's commit joins them in order into one file."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

#: Bytes that the commit copies at a time.
COPY = 1 << 20
FORMAT = "glossa_ordered_text"


def at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class Part(WriterCommitMessage):
    partition: int
    file: str


class OrderedWriter(DataSourceWriter):
    """Lines of one string column. Parts are named by task attempt, so one that is done again disturbs nothing."""

    def __init__(self, path: str):
        self.path, self.parts = path, f"_parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Part:
        system, root = at(self.path)
        context = TaskContext.get()
        name = f"{root}/{self.parts}/{context.partitionId():08d}-{context.taskAttemptId()}"
        system.create_dir(f"{root}/{self.parts}")
        with system.open_output_stream(name) as out:
            for row in iterator:
                out.write(f"{'' if row[0] is None else row[0]}\n".encode())
        return Part(context.partitionId(), name)

    def commit(self, messages: list[Part | None]) -> None:
        system, root = at(self.path)
        old = [f.path for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.type == fs.FileType.File]
        new = f"{root}/{self.parts}/report"
        with system.open_output_stream(new) as out:
            for part in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
                with system.open_input_stream(part.file) as source:
                    while block := source.read(COPY):
                        out.write(block)
        for f in old:
            system.delete_file(f)
        system.move(new, f"{root}/part-00000.txt")
        system.delete_dir(f"{root}/{self.parts}")

    def abort(self, messages: list[Part | None]) -> None:
        system, root = at(self.path)
        if system.get_file_info(f"{root}/{self.parts}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.parts}")


class OrderedText(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> OrderedWriter:
        return OrderedWriter(self.options["path"])


def write_ordered(rows: DataFrame, path: str) -> None:
    """The string column of ``rows``, whose partitions and rows stand in order, as one text file in the folder ``path``, in place of what it held.

    A failed task leaves an earlier report as it was, and none where there was
    none; tasks that still ran then may leave parts in a folder whose name
    readers pass over.
    """
    rows.sparkSession.dataSource.register(OrderedText)
    rows.write.format(FORMAT).mode("overwrite").save(path)
