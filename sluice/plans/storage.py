"""Files of table metadata by Hadoop's file systems, so tables may be wherever Spark reads and writes."""

from __future__ import annotations

import json
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


class ConflictError(RuntimeError):
    """Another writer was first."""


def workspace(spark: SparkSession) -> str:
    """The folder shared by driver and executors: ``spark.checkpoint.dir``, or a temporary one where it is unset."""
    context = spark.sparkContext
    found = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir", "")
    if not found:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sluice-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def persist(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the workspace and read it back: a cut of lineage that survives lost executors."""
    path = f"{workspace(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: File systems that create a name for one writer only and rename in one step.
EXCLUSIVE = ("file", "hdfs", "viewfs")


class Store:
    """Small files below a root path."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._jvm = jvm
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self._path(name if "://" in name or name.startswith(("/", "file:")) else f"{self.root}/{name}")

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.path(name))

    def read(self, name: str) -> dict:
        stream = self._fs.open(self.path(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def create(self, name: str, content: dict) -> None:
        """Write a file that must not exist yet; this is the compare-and-swap of commits.

        Object stores neither create exclusively nor rename in one step by this interface, so they are refused for metadata.
        """
        from py4j.protocol import Py4JJavaError

        if (scheme := self._fs.getUri().getScheme()) not in EXCLUSIVE:
            raise ValueError(f"commits need a file system that creates exclusively, not {scheme}")

        if self.exists(name):
            raise ConflictError(name)
        staged = self.path(f"{name}.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(staged, True)
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()
        try:
            # Creating the final name exclusively decides; the content follows by a rename over the empty file.
            self._fs.create(self.path(name + ".lock"), False).close()
        except Py4JJavaError as e:
            self._fs.delete(staged, False)
            self._clear_stale(name)
            raise ConflictError(name) from e
        if not self._fs.rename(staged, self.path(name)):
            raise ConflictError(name)

    def _clear_stale(self, name: str, seconds: int = 60) -> None:
        """A lock whose writer died before its rename is removed, so that the next attempt may take the name."""
        lock = self.path(name + ".lock")
        if self._fs.exists(lock) and not self.exists(name) and time.time() * 1000 - self._fs.getFileStatus(lock).getModificationTime() > seconds * 1000:
            self._fs.delete(lock, False)

    def list(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self.path(folder)))

    def put(self, name: str, content: dict) -> None:
        """Write a file of one writer's own."""
        out = self._fs.create(self.path(name), True)
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()

    def sizes(self, folder: str, suffix: str = ".parquet") -> list[tuple[str, int]]:
        """(full path, bytes) of the files right below a folder."""
        found = self._fs.listStatus(self.path(folder)) if self.exists(folder) else []
        return sorted((s.getPath().toString(), s.getLen()) for s in found if s.getPath().getName().endswith(suffix))

    def footer(self, path: str, column: str | None) -> tuple[int, str | None, str | None]:
        """Rows of a Parquet file and the least and greatest value of a column, as text, from its footer."""
        parquet = self._jvm.org.apache.parquet.hadoop
        opened = parquet.util.HadoopInputFile.fromPath(self._path(path), self.spark.sparkContext._jsc.hadoopConfiguration())
        reader = parquet.ParquetFileReader.open(opened)
        try:
            lower = upper = None
            for block in reader.getFooter().getBlocks() if column else ():
                for chunk in block.getColumns():
                    if chunk.getPath().toDotString() == column and chunk.getStatistics().hasNonNullValue():
                        low, high = (v.toStringUsingUTF8() if hasattr(v, "toStringUsingUTF8") else v for v in (chunk.getStatistics().genericGetMin(), chunk.getStatistics().genericGetMax()))
                        lower, upper = low if lower is None else min(lower, low), high if upper is None else max(upper, high)
            return reader.getRecordCount(), None if lower is None else str(lower), None if upper is None else str(upper)
        finally:
            reader.close()

    def delete(self, name: str) -> bool:
        return self._fs.delete(self.path(name), True)
