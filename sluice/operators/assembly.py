"""Transactions from a replication stream.

Stream rows have ``position`` (total order), ``kind`` (begin, commit, start, stop,
abort, insert, update, delete, truncate), ``xid``, ``subxid``, ``table_id`` and, on
commits, ``begin_lsn``, ``commit_lsn`` and ``end_lsn``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHANGES = ("insert", "update", "delete", "truncate")


def rollback_ranges(stream: DataFrame) -> DataFrame:
    """(xid, low, high): positions [low, high) that savepoint rollbacks remove.

    An abort of a subtransaction removes every change from its first surviving one
    on, descendants included; what arrives after the abort stays.  An abort of an
    unknown or already removed subtransaction removes nothing, which makes aborts
    depend on one another, so they are folded in order.  What is folded is small:
    between two aborts only the first change of each subtransaction counts, and that
    is aggregated before.
    """
    aborts = stream.where("kind = 'abort' and subxid <> xid")
    with_aborts = aborts.select("xid").distinct()
    own = stream.join(with_aborts, "xid", "left_semi").where(F.col("kind").isin(*CHANGES) | ((F.col("kind") == "abort") & (F.col("subxid") != F.col("xid"))))
    w = Window.partitionBy("xid").orderBy("position")
    marked = own.withColumn("era", F.sum((F.col("kind") == "abort").cast("int")).over(w))
    firsts = marked.where("kind <> 'abort'").groupBy("xid", "era", "subxid").agg(F.min("position").alias("position")).withColumn("abort", F.lit(False))
    steps = firsts.unionByName(marked.where("kind = 'abort'").select("xid", "era", "subxid", "position", F.lit(True).alias("abort")))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xid, first = None, {}
        for batch in batches:
            cut: list[tuple[int, int, int]] = []
            for x, subxid, position, abort in zip(*(batch.column(c).to_pylist() for c in ("xid", "subxid", "position", "abort")), strict=True):
                if x != xid:
                    xid, first = x, {}
                if not abort:
                    first.setdefault(subxid, position)
                elif subxid in first:
                    low = first[subxid]
                    cut.append((x, low, position))
                    first = {s: p for s, p in first.items() if p < low}
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in cut], pa.int64()) for i in range(3)], names=["xid", "low", "high"])

    # Transactions follow one another through a partition: a call for each of them would cost far more than its steps.
    return steps.repartition("xid").sortWithinPartitions("xid", "position").mapInArrow(fold, "xid long, low long, high long")


def surviving(stream: DataFrame) -> DataFrame:
    """Changes that no savepoint rollback removed."""
    changes = stream.where(F.col("kind").isin(*CHANGES))
    cut = rollback_ranges(stream).groupBy("xid").agg(F.collect_list(F.struct("low", "high")).alias("cuts"))  # as many as a transaction's aborts
    joined = changes.join(cut, "xid", "left")
    hit = F.exists(F.coalesce("cuts", F.array().cast("array<struct<low:bigint,high:bigint>>")), lambda c: (F.col("position") >= c["low"]) & (F.col("position") < c["high"]))
    return joined.where(~hit).drop("cuts")


def without_excluded(changes: DataFrame, excluded: DataFrame) -> DataFrame:
    """Replayed changes without subtransactions known to be rolled back (xid, subxid)."""
    return changes.join(excluded.select("xid", "subxid").distinct(), ["xid", "subxid"], "left_anti")


def assemble(stream: DataFrame) -> DataFrame:
    """Changes of committed transactions with their commit's positions and ``ordinal`` within the transaction."""
    commits = stream.where("kind = 'commit'").select("xid", "begin_lsn", "commit_lsn", "end_lsn")
    dropped = stream.where("kind = 'abort' and subxid = xid").select("xid").distinct()
    commits = commits.join(dropped, "xid", "left_anti").dropDuplicates(["end_lsn"])
    kept = surviving(stream).drop("begin_lsn", "commit_lsn", "end_lsn").join(commits, "xid")
    return kept.withColumn("ordinal", F.row_number().over(Window.partitionBy("xid", "end_lsn").orderBy("position")).cast("long") - 1)


def transaction_counts(stream: DataFrame) -> DataFrame:
    """(xid, begin_lsn, commit_lsn, end_lsn, table_id, mutations): exact counts of what survives; null table for none."""
    commits = stream.where("kind = 'commit'").select("xid", "begin_lsn", "commit_lsn", "end_lsn")
    counts = surviving(stream).groupBy("xid", "table_id").agg(F.count("*").alias("mutations"))
    return commits.dropDuplicates(["end_lsn"]).join(counts, "xid", "left").withColumn("mutations", F.coalesce("mutations", F.lit(0)))


def configured(changes: DataFrame, tables: list[int], blocked: DataFrame | None = None) -> DataFrame:
    """Changes of the configured tables that aren't blocked; transactions of others stay, empty."""
    kept = changes.where(F.col("table_id").isin(tables))
    return kept if blocked is None else kept.join(blocked.select("table_id"), "table_id", "left_anti")


def blocks(changes: DataFrame, append_only: list[int]) -> DataFrame:
    """(table_id, reason, position) of the first change that a table can't take."""
    reason = F.when(F.col("kind") == "truncate", "truncate").when(F.col("table_id").isin(append_only) & F.col("kind").isin("update", "delete"), "append_only_mutation")
    found = changes.withColumn("reason", reason).where("reason is not null")
    return found.groupBy("table_id").agg(F.min_by("reason", "position").alias("reason"), F.min("position").alias("position"))


def quarantined(changes: DataFrame, legal: F.Column, identity: tuple[str, ...] = ("position", "xid", "subxid", "table_id")) -> tuple[DataFrame, DataFrame]:
    """Changes whose payload can be decoded, and the dead letters: where they stood and of which table, no cell of the row.

    Of a stream's changes take :func:`surviving` first: what a savepoint rollback removes was quarantined for the time being.
    """
    good = F.coalesce(legal, F.lit(False))
    return changes.where(good), changes.where(~good).select([c for c in identity if c in changes.columns])


def unseen(transactions: DataFrame, staged_lsn: int) -> DataFrame:
    """Transactions beyond what is staged already, each end position once."""
    return transactions.where(F.col("end_lsn") > staged_lsn).dropDuplicates(["end_lsn"])
