"""Publishing an epoch: collapse, bind to live rows, write files, commit once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators.collapse import collapse, numbered
from sluice.plans.schema import project
from sluice.plans.storage import persist
from sluice.plans.table import META, Snapshot, Table, with_retry


def bind(changes: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """Collapsed changes with the place and metadata of the row they replace; a key whose presence isn't what the log requires raises."""
    own = index.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(c).alias(f"_o{c}") for c in (*META, "_path", "_pos")], F.struct(*[c for c in index.columns if c not in (*META, "_path", "_pos")]).alias("_old"))
    # Files of narrow rows are far smaller than these with their paths and old values, so Spark must not judge by their size whether to send them to all.
    met = changes.join(own.hint("merge"), [F.col(k) == F.col(f"_k_{k}") for k in keys], "left")
    there = F.col("_o_path").isNotNull()
    return met.withColumn("required", F.when(there != F.col("required"), F.raise_error(F.concat(F.lit("presence conflict for key "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys])))).otherwise(F.col("required")))


def index_files(table: Table, snapshot: Snapshot, changes: DataFrame) -> DataFrame:
    """Data files whose range of the first key column meets the changes' range: all that binding has to read."""
    key = table.spec.key[0]
    kind = next(c.type for c in snapshot.spec.columns if c.name == key)
    span = changes.agg(F.min(key).alias("_low"), F.max(key).alias("_high"))
    files = table.entries(snapshot).where("kind = 'data'").crossJoin(F.broadcast(span))
    meets = F.col("key_lower").isNull() | ((F.col("key_upper").cast(kind) >= F.col("_low")) & (F.col("key_lower").cast(kind) <= F.col("_high")))
    return files.where(meets)


def publish(table: Table, log: DataFrame, epoch_id: str, files: int | None = None) -> Snapshot:
    """Apply an epoch of changes in one snapshot; an epoch that was published already is found and not applied again.

    An epoch without effect adds no snapshot.
    """

    def attempt() -> Snapshot:
        if done := table.committed_epoch(epoch_id) or table.recover(epoch_id):
            return done
        base = table.snapshot()
        spec, keys = base.spec, list(base.spec.key)
        if not keys:
            return append(table, numbered(log) if "ordinal" in log.columns else log, epoch_id, files, base)
        columns = [c for c in spec.names if c not in keys]
        changes = persist(collapse(log, keys, columns), "collapsed")
        index = table.live(base, index_files(table, base, changes))
        bound = persist(bind(changes, index, keys), "bound")
        gone = bound.where("_o_path is not null").select(F.col("_o_path").alias("path"), F.col("_o_pos").alias("pos"))
        value = lambda c: F.when(F.array_contains("unresolved", c), F.col(f"_old.{c}")).otherwise(F.col(c)).alias(c)
        images = bound.where("present").select(
            *keys, *map(value, columns), (F.coalesce(F.col("_o_version"), F.lit(0)) + 1).alias("_version"), F.col("end_lsn").alias("_lsn"), F.col("_o_row_id").alias("_row_id"), F.lit(None).cast("long").alias("_changed_at")
        )
        return write(table, base, images, gone, epoch_id, files)

    return with_retry(attempt)


def write(table: Table, base: Snapshot, images: DataFrame, gone: DataFrame, epoch_id: str, files: int | None) -> Snapshot:
    sequence = base.id + 1
    made = table.write_data(images, base.spec, sequence, 0, base.next_row_id, "epoch", files)
    lost = table.write_deletes(gone, sequence, base.spec.format_version, table.deletes(base) if base.spec.format_version == 3 else None)
    entries = [*made.collect(), *lost.collect()]  # a row a file
    if not entries:
        return base
    rows, fewer = (sum(e.record_count for e in entries if (e.kind == "data") is data) for data in (True, False))
    operation = "overwrite" if rows and fewer else "append" if rows else "delete"
    return table.commit(base, operation, table.spark.createDataFrame(entries, made.schema), {"epoch_id": epoch_id, "level": "L0", "operation": "ingest"}, next_row_id=base.next_row_id + rows)


def append(table: Table, rows: DataFrame, epoch_id: str, files: int | None = None, base: Snapshot | None = None, level: int = 0) -> Snapshot:
    """Add rows without deletes: the base copy of a table (``level`` 1) or an epoch of a table without a key."""
    base = base or table.snapshot()
    kept = project(rows, base.spec).withColumn("_version", F.lit(1).cast("long")).withColumn("_lsn", F.lit(0).cast("long"))
    if "end_lsn" in rows.columns:
        kept = rows.select(*base.spec.names, F.lit(1).cast("long").alias("_version"), F.col("end_lsn").alias("_lsn"))
    made = table.write_data(kept, base.spec, base.id + 1, level, base.next_row_id, "copy" if level else "epoch", files)
    n = sum(r.record_count for r in made.select("record_count").collect())  # a row a file
    return table.commit(base, "append", made, {"epoch_id": epoch_id, "operation": "ingest"}, next_row_id=base.next_row_id + n)


def copy(table: Table, rows: DataFrame, cut_lsn: int, files: int | None = None) -> Snapshot:
    """The base copy at a position of the log; changes up to it are suppressed by :func:`after_cut`."""
    return append(table, rows, f"copy-{cut_lsn}-{uuid.uuid4().hex[:8]}", files, level=1)


def after_cut(log: DataFrame, cut_lsn: int) -> DataFrame:
    return log.where(F.col("end_lsn") > cut_lsn)
