"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``, by any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent (tests, a laptop) a temporary folder takes its
    place, which is right only because driver and executors are one machine.
    """
    context = spark.sparkContext
    found = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir", "")
    if not found:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sluice-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: While a table is written, its shuffle files go as soon as it is there, and workers get batches of a few MB.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def persist(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: whatever reads the result no longer repeats the work, and
    a lost executor costs nothing that was already written.  :func:`discard` deletes it.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    before = {name: spark.conf.get(name, None) for name in WRITING}
    try:
        for name, value in WRITING.items():
            spark.conf.set(name, value)
        df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)  # a writer holds a row group
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`persist` wrote and nothing reads any more."""
    for t in tables:
        if files := t.inputFiles():
            spark = t.sparkSession
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            if not shared_dir(spark).rstrip("/").endswith(folder.getParent().toUri().getPath().rstrip("/")):
                raise ValueError(f"{folder} isn't in the shared folder")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def whole_row(df: DataFrame) -> F.Column:
    """All columns of ``df``, whatever their names, in one: what an operator adds can't clash with them."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns])


def fields(df: DataFrame, column: str, rest: str) -> T.StructType:
    """A schema of ``column`` as it is in ``df``, whatever its type, and the fields of ``rest``."""
    return T.StructType([T.StructField(column, df.schema[column].dataType), *T.StructType.fromDDL(rest).fields])


def map_batches(df: DataFrame, schema: str | T.StructType, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]]) -> DataFrame:
    """Apply a per-task worker to the Arrow batches of ``df``.

    ``make`` runs once in each task, so models and caches are built once; the
    function it returns turns one batch into any number of batches.  It gets
    batches in parts of a few MB, so that what it builds of them stays small.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in parts(batch):
                yield from work(part)

    return df.mapInArrow(run, schema)


def lean(run: Callable) -> Callable:
    """``run``, a task over Arrow batches, after which its worker gives free memory back: idle workers live on next to busy ones."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return task


def release() -> None:
    """Give memory that Arrow and the C library hold free back to the system, where they can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def parts(batch: pa.RecordBatch, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``size`` bytes, of one row at least."""
    step = max(1, int(batch.num_rows * size / max(1, batch.nbytes)))
    for low in range(0, batch.num_rows, step):
        yield batch.slice(low, step)


def crc_mod(column: str, modulus: int) -> F.Column:
    """crc32 of the column as text, modulo ``modulus``; 0 for a null."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus), F.lit(0))
