"""Acknowledgement over the complete prefix of transactions, epoch admission and lag."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Limits of an epoch.
EPOCH_MUTATIONS = 10_000
EPOCH_BYTES = 32 << 20
EPOCH_DESCRIPTOR_BYTES = 4 << 20


def completion(transactions: DataFrame, published: DataFrame) -> DataFrame:
    """(end_lsn, complete): a transaction is complete when all its tables are published; one without tables is."""
    wanted = transactions.select("end_lsn", "table_id")
    done = published.select("end_lsn", "table_id").distinct().withColumn("_done", F.lit(True))
    joined = wanted.join(done, ["end_lsn", "table_id"], "left")
    return joined.groupBy("end_lsn").agg(F.bool_and(F.col("table_id").isNull() | F.coalesce("_done", F.lit(False))).alias("complete"))


def watermarks(transactions: DataFrame, published: DataFrame, received: int | None = None) -> DataFrame:
    """One row: received, journal-durable and materialized positions.  The last is the end of the complete prefix."""
    state = completion(transactions, published)
    marks = state.agg(F.max("end_lsn").alias("journal_durable_lsn"), F.min(F.when(~F.col("complete"), F.col("end_lsn"))).alias("_open"))
    prefix = state.crossJoin(F.broadcast(marks.select("_open"))).where("_open is null or end_lsn < _open").agg(F.coalesce(F.max("end_lsn"), F.lit(0)).alias("materialized_lsn"))
    seen = F.greatest(F.lit(received or 0), F.coalesce("journal_durable_lsn", F.lit(0)))
    return marks.crossJoin(prefix).select(seen.cast("long").alias("received_lsn"), F.coalesce("journal_durable_lsn", F.lit(0)).alias("journal_durable_lsn"), "materialized_lsn")


def registration_faults(transactions: DataFrame) -> DataFrame:
    """(end_lsn, fault): what makes a page of transactions illegal."""
    by_end = Window.partitionBy("end_lsn")
    fault = (
        F.when(~((F.col("begin_lsn") <= F.col("commit_lsn")) & (F.col("commit_lsn") < F.col("end_lsn"))), "position order")
        .when(F.min(F.struct("xid", "begin_lsn", "commit_lsn")).over(by_end) != F.max(F.struct("xid", "begin_lsn", "commit_lsn")).over(by_end), "replay differs")
        .when(F.count("*").over(Window.partitionBy("end_lsn", "table_id")) > 1, "duplicate table")
    )
    return transactions.withColumn("fault", fault).where("fault is not null").select("end_lsn", "fault").distinct()


def admit(transactions: DataFrame, mutations: int = EPOCH_MUTATIONS, payload: int = EPOCH_BYTES, memory: int = EPOCH_DESCRIPTOR_BYTES, count: int | None = None) -> DataFrame:
    """(table_id, end_lsn, epoch): the epoch, from 0, of each pending transaction of each table.

    Transactions are taken in order and never split; a large one is an epoch of its
    own.  The rule depends on all that came before, so each table's descriptors
    stream through one task in order; the state is a few numbers.
    Input: table_id, end_lsn, mutations (null: unknown), payload_bytes, descriptor_bytes.
    """
    ordered = transactions.select("table_id", "end_lsn", "mutations", "payload_bytes", "descriptor_bytes").repartition("table_id").sortWithinPartitions("table_id", "end_lsn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = epoch = None
        held_payload = held_memory = held_count = 0
        closed = True
        for batch in batches:
            rows = []
            for t, end, rows_n, size, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if t != table:
                    table, epoch, closed = t, -1, True
                alone = rows_n is None or rows_n > mutations or size > payload
                full = held_memory > 0 and (alone or held_payload + size > payload or held_memory + own > memory or count is not None and held_count >= count)
                if closed or full:
                    epoch, held_payload, held_memory, held_count = epoch + 1, 0, 0, 0
                held_payload, held_memory, held_count = held_payload + size, held_memory + own, held_count + 1
                closed = alone or held_payload >= payload or held_memory >= memory or count is not None and held_count >= count
                rows.append((t, end, epoch))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["table_id", "end_lsn", "epoch"])

    return ordered.mapInArrow(run, "table_id long, end_lsn long, epoch long")


def epoch_summary(transactions: DataFrame) -> DataFrame:
    """(table_id, epoch, first_lsn, last_lsn, transactions, oldest_commit, initial): what an epoch spans; all xid 0 marks a base copy."""
    return transactions.groupBy("table_id", "epoch").agg(
        F.min("end_lsn").alias("first_lsn"), F.max("end_lsn").alias("last_lsn"), F.count("*").alias("transactions"), F.min("commit_ts").alias("oldest_commit"), F.every(F.col("xid") == 0).alias("initial")
    )


def lag(pending: DataFrame, durable_lsn: int, now: F.Column) -> DataFrame:
    """(table_id, lag_bytes, lag_seconds) by each table's oldest pending transaction."""
    return pending.groupBy("table_id").agg(
        F.greatest(F.lit(durable_lsn) - F.min("begin_lsn"), F.lit(0)).alias("lag_bytes"), (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.min("commit_ts").cast("timestamp"))).alias("lag_seconds")
    )
