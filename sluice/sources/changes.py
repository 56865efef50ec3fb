"""Change-event sources: schemas, validation, the journal of transactions, and initial copies."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.plans.storage import Store

#: The schema of a replication stream.
STREAM = "position long, kind string, xid long, subxid long, table_id long, begin_lsn long, commit_lsn long, end_lsn long, commit_ts timestamp_ntz, key long, payload string"
KINDS = ("begin", "commit", "relation", "insert", "update", "delete", "truncate", "start", "stop", "abort", "metadata")


def changes_schema(keys: list[T.StructField], columns: list[T.StructField]) -> T.StructType:
    """The schema of a change log with these key and value columns."""
    order = (("end_lsn", T.LongType()), ("ordinal", T.LongType()), ("half", T.IntegerType()), ("op", T.StringType()), ("unchanged", T.ArrayType(T.StringType())))
    return T.StructType([*keys, *columns, *[T.StructField(n, t) for n, t in order]])


def faults(stream: DataFrame) -> DataFrame:
    """(position, fault) of stream rows that break the protocol's framing."""
    fault = (
        F.when(F.col("position").isNull(), "no position")
        .when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "unknown kind")
        .when(F.col("kind").isin("insert", "update", "delete") & (F.col("xid").isNull() | F.col("table_id").isNull()), "change without transaction or table")
        .when((F.col("kind") == "commit") & ~F.coalesce((F.col("begin_lsn") <= F.col("commit_lsn")) & (F.col("commit_lsn") < F.col("end_lsn")), F.lit(False)), "commit positions")
    )
    return stream.withColumn("fault", fault).where("fault is not null").select("position", "fault")


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """Events as files arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def project_columns(changes: DataFrame, columns: list[str], meta: tuple[str, ...] = ("end_lsn", "ordinal", "half", "op", "unchanged")) -> DataFrame:
    """The configured columns and the order of changes; what is excluded is never read."""
    return changes.select(*columns, *[c for c in meta if c in changes.columns])


class Journal:
    """Committed transactions in a folder: one Parquet part for each appended batch, named by its last position."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.store = spark, root.rstrip("/"), Store(spark, root)

    def _parts(self) -> list[tuple[int, str]]:
        return [(int(n.split("-")[1]), n) for n in self.store.list("parts") if n.startswith("lsn-")]

    def append(self, transactions: DataFrame) -> int:
        """Add a batch; what it holds up to the last position is a replay and left out.  Returns the new last position."""
        last = self.last_lsn()
        staged = f"{self.root}/staged-{uuid.uuid4().hex}"
        # Assembling is most of the work, so what was written tells the last position.
        transactions.where(F.col("end_lsn") > last).write.parquet(staged)
        written = self.spark.read.schema(transactions.schema).parquet(staged)
        top = written.agg(F.max("end_lsn")).first()[0]
        if top is None:
            self.store.delete(staged)
            return last
        self.store.put(f"checks/lsn-{top:020d}.json", self._check(written))
        part = self.store.path(f"parts/lsn-{top:020d}")
        self.store._fs.mkdirs(self.store.path("parts"))
        if not self.store._fs.rename(self.store.path(staged), part):
            raise OSError(f"can't add {part}")
        return top

    def _check(self, rows: DataFrame) -> dict:
        """Number of rows and a checksum that doesn't depend on their order."""
        found = rows.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).alias("sum")).first()
        return {"rows": found["rows"], "sum": str(found["sum"])}

    def damaged(self) -> list[str]:
        """Parts whose rows aren't those that were appended."""
        return [n for _, n in self._parts() if self.store.exists(f"checks/{n}.json") and self._check(self.spark.read.parquet(f"{self.root}/parts/{n}")) != self.store.read(f"checks/{n}.json")]

    def last_lsn(self) -> int:
        return max((lsn for lsn, _ in self._parts()), default=0)

    def after(self, lsn: int) -> DataFrame | None:
        """Transactions beyond a position; whole parts before it aren't read."""
        names = [f"{self.root}/parts/{n}" for top, n in self._parts() if top > lsn]
        return self.spark.read.parquet(*names).where(F.col("end_lsn") > lsn) if names else None

    def reclaim(self, lsn: int) -> int:
        """Delete parts that lie before a position as a whole."""
        old = [n for top, n in self._parts() if top <= lsn]
        for n in old:
            self.store.delete(f"parts/{n}")
            self.store.delete(f"checks/{n}.json")
        return len(old)
