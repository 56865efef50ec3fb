"""A stream source over a journal: offsets are log positions, and what a query has committed is acknowledged.

The journal's parts are Parquet folders named by their last position.  A micro-batch
reads whole parts between two positions, one partition a file; once it is committed,
the position is written next to the journal, and parts up to the least position that
all readers have acknowledged may be reclaimed.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

FORMAT = "change_log"


def place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it, wherever Arrow can read."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:")))


def parts_of(path: str) -> list[tuple[int, str]]:
    """(last position, folder) of a journal's parts, in order."""
    system, root = place(path)
    found = system.get_file_info(pafs.FileSelector(f"{root}/parts", allow_not_found=True))
    return sorted((int(f.base_name.split("-")[1]), f.path) for f in found if f.base_name.startswith("lsn-"))


class Part(InputPartition):
    def __init__(self, file: str, after: int):
        self.file, self.after = file, after


class ChangeLogReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.reader, self.schema = options["path"], options.get("reader", "default"), schema
        self.start = int(options.get("startingPosition", 0))

    def initialOffset(self) -> dict:
        return {"position": self.start}

    def latestOffset(self) -> dict:
        return {"position": max((lsn for lsn, _ in parts_of(self.path)), default=self.start)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        system, _ = place(self.path)
        chosen = [folder for lsn, folder in parts_of(self.path) if start["position"] < lsn <= end["position"]]
        files = [f.path for folder in chosen for f in system.get_file_info(pafs.FileSelector(folder)) if f.path.endswith(".parquet")]
        return [Part(f, start["position"]) for f in sorted(files)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        system, _ = place(self.path)
        names = self.schema.fieldNames()
        with system.open_input_file(partition.file) as f:
            for batch in pq.ParquetFile(f).iter_batches(columns=names):
                mask = pc.greater(batch.column("end_lsn"), partition.after)
                yield batch.filter(mask).select(names)

    def commit(self, end: dict) -> None:
        system, root = place(self.path)
        system.create_dir(f"{root}/acknowledged")
        with system.open_output_stream(f"{root}/acknowledged/{self.reader}") as out:
            out.write(str(end["position"]).encode())


class ChangeLog(DataSource):
    """``spark.readStream.format("change_log").schema(...).load(journal root)``; options reader and startingPosition."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamReader(self, schema: StructType) -> ChangeLogReader:
        return ChangeLogReader(self.options, schema)


def stream(spark: SparkSession, journal: str, schema: StructType, reader: str = "default", start: int = 0):
    """A stream of the journal's transactions after a position."""
    spark.dataSource.register(ChangeLog)
    return spark.readStream.format(FORMAT).schema(schema).option("reader", reader).option("startingPosition", start).load(journal)


def acknowledged(journal: str) -> int:
    """The position that every reader has committed; 0 without readers."""
    system, root = place(journal)
    found = system.get_file_info(pafs.FileSelector(f"{root}/acknowledged", allow_not_found=True))
    return min((int(system.open_input_stream(f.path).readall()) for f in found), default=0)
