"""Collapse of an ordered change log to one change for each key.

A change has key columns, value columns, ``op`` (I, U or D), the order
(``end_lsn``, ``ordinal``, ``half``) and ``unchanged``, the names of columns that
an update left out.  A change of key is two halves of one ordinal: D of the old
key, I of the new.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.plans.storage import persist

ORDER = ("end_lsn", "ordinal", "half")


def order_of() -> F.Column:
    return F.struct(*ORDER)


def split_key_changes(changes: DataFrame, keys: list[str], old: str = "old_key") -> DataFrame:
    """Updates whose ``old`` key (a struct, null if unchanged) differs become a delete and an insert.

    Such an update may not omit values, since its insert starts a row.
    """
    moved = (F.col("op") == "U") & F.col(old).isNotNull() & ~F.col(old).eqNullSafe(F.struct(*keys))
    checked = F.when(moved & (F.size("unchanged") > 0), F.raise_error(F.lit("a change of key omits values"))).otherwise(F.col("op"))
    halves = F.when(moved, F.array(F.lit(0), F.lit(1))).otherwise(F.array("half"))
    rows = changes.withColumn("op", checked).withColumn("_moved", moved).withColumn("half", F.explode(halves))
    op = F.when(F.col("_moved"), F.when(F.col("half") == 0, "D").otherwise("I")).otherwise(F.col("op"))
    own = [F.when(F.col("_moved") & (F.col("half") == 0), F.col(f"{old}.{k}")).otherwise(F.col(k)).alias(k) for k in keys]
    return rows.select(*own, *[c for c in changes.columns if c not in (*keys, "op", old)], op.alias("op"))


def with_conflicts(changes: DataFrame, keys: list[str]) -> DataFrame:
    """``conflict``: why a change is illegal after the one before it, else null."""
    before = F.lag("op").over(Window.partitionBy(*keys).orderBy(*ORDER))
    why = (
        F.when((F.col("op") == "I") & (F.size("unchanged") > 0), "insert omits values")
        .when((F.col("op") == "I") & before.isin("I", "U"), "insert of a present key")
        .when(F.col("op").isin("U", "D") & (before == "D"), "change of an absent key")
    )
    return changes.withColumn("conflict", why)


def collapse(changes: DataFrame, keys: list[str], columns: list[str], check: bool = True) -> DataFrame:
    """One row for each key: ``required`` (the key must exist before), ``present`` (it exists after), the columns'
    last values and ``unresolved``, names of columns whose value is the one before the log.

    The window and the aggregates share one shuffle by key.  Without ``check`` the
    aggregates alone run, combined before their shuffle, which suits hot keys.
    """
    rows = with_conflicts(changes, keys) if check else changes.withColumn("conflict", F.lit(None).cast("string"))
    place = order_of()
    told = {c: (F.col("op") != "D") & ~F.array_contains("unchanged", c) for c in columns}
    found = rows.groupBy(*keys).agg(
        F.min_by("op", place).alias("_first"),
        F.max_by("op", place).alias("_last"),
        F.max(F.when(F.col("op") != "U", place)).alias("_start"),
        F.max("conflict").alias("_conflict"),
        F.max("end_lsn").alias("end_lsn"),
        # A struct around the value keeps a real null apart from none at all.
        *[F.max_by(F.when(told[c], F.struct(place.alias("at"), F.col(c).alias("v"))), F.when(told[c], place)).alias(f"_{c}") for c in columns],
    )
    valid = {c: F.col(f"_{c}").isNotNull() & (F.col("_start").isNull() | (F.col(f"_{c}.at") >= F.col("_start"))) for c in columns}
    present = F.when(F.col("_conflict").isNotNull(), F.raise_error(F.concat(F.lit("change log conflict: "), F.col("_conflict")))).otherwise(F.col("_last") != "D")
    lost = F.filter(F.array(*[F.when(~valid[c], F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    return found.select(
        *keys,
        (F.col("_first") != "I").alias("required"),
        present.alias("present"),
        "end_lsn",
        *[F.when(valid[c], F.col(f"_{c}.v")).alias(c) for c in columns],
        F.when(F.col("_last") == "D", F.array().cast("array<string>")).otherwise(lost).alias("unresolved"),
    )


def combine(first: DataFrame, second: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The collapse of two adjoining logs from their own collapses (a prefold): equal to collapsing both at once."""
    a, b = first.alias("a"), second.alias("b")
    both = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full_outer")
    has_a, has_b = F.col("a.required").isNotNull(), F.col("b.required").isNotNull()
    clash = has_a & has_b & (F.col("a.present") != F.col("b.required"))
    carried = lambda c: has_a & F.array_contains("b.unresolved", c)
    return both.select(
        *[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys],
        F.when(clash, F.raise_error(F.lit("change log conflict"))).otherwise(F.coalesce("a.required", "b.required")).alias("required"),
        F.coalesce("b.present", "a.present").alias("present"),
        F.coalesce("b.end_lsn", "a.end_lsn").alias("end_lsn"),
        *[F.when(has_b & ~carried(c), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in columns],
        F.when(~has_b, F.col("a.unresolved")).when(~has_a, F.col("b.unresolved")).otherwise(F.array_intersect("a.unresolved", "b.unresolved")).alias("unresolved"),
    )


def numbered(changes: DataFrame) -> DataFrame:
    """``ordinal`` of each change of an append-only table within its epoch, from 0: the identity of rows without a key.

    Ranges of log positions keep the order over partitions; each partition is
    numbered on its own and offset by the counts before it, so no single task
    sees all rows.
    """
    parts = changes.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).withColumn("_part", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id())
    parts = persist(parts, "numbered")  # partition ids must be the same for both readers
    bounds = parts.groupBy("_part").agg(F.count("*").alias("n"), F.min("_nth").alias("base"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row for each partition.
    bounds = F.broadcast(bounds.select("_part", "base", before.alias("before")))
    return parts.join(bounds, "_part").withColumn("row_number", F.col("_nth") - F.col("base") + F.col("before")).drop("_part", "_nth", "base", "before")
