"""Judging snapshots of other writers, and proving that a rewrite changed no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def classify(changes: DataFrame) -> DataFrame:
    """``class`` of each foreign snapshot.

    Input: parent_id, expected_parent, schema_changed, spec_changed, is_service, known_service, operation, and the counts
    added_data, removed_data, added_deletes, removed_deletes.
    """
    data = (F.col("added_data") > 0) | (F.col("removed_data") > 0)
    deletes = (F.col("added_deletes") > 0) | (F.col("removed_deletes") > 0)
    replaces = F.col("operation") == "replace"
    return changes.withColumn(
        "class",
        F.when(~F.col("parent_id").eqNullSafe(F.col("expected_parent")), "pause_missing_history")
        .when(F.col("schema_changed") | F.col("spec_changed"), "pause_schema_or_spec")
        .when(F.col("is_service") & F.col("known_service"), "service_operation")
        .when(F.col("is_service"), "pause_unknown_service")
        .when(~data & ~deletes, "metadata_only")
        .when(~data & replaces, "verify_delete_rewrite")
        .when(~data, "pause_logical_mutation")
        .when(replaces & (F.col("removed_data") > 0), "reconcile_data_rewrite")
        .otherwise("pause_logical_mutation"),
    )


def delete_set_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: positions that only one of two delete sets has; both 0 if they are equal."""
    a = before.select("path", "pos").distinct().withColumn("_a", F.lit(1))
    b = after.select("path", "pos").distinct().withColumn("_b", F.lit(1))
    both = a.join(b, ["path", "pos"], "full_outer")
    return both.agg(F.coalesce(F.sum(F.when(F.col("_b").isNull(), 1)), F.lit(0)).alias("only_before"), F.coalesce(F.sum(F.when(F.col("_a").isNull(), 1)), F.lit(0)).alias("only_after"))


def reconcile_keyed(removed: DataFrame, added: DataFrame, keys: list[str]) -> DataFrame:
    """One row of counts: how live rows of removed files and rows of added files meet by key and fingerprint.

    A rewrite is faithful if missing, extra, changed and repeated are all 0.
    """
    a = removed.groupBy(*keys).agg(F.count("*").alias("_na"), F.max("fingerprint").alias("_fa"))
    b = added.groupBy(*keys).agg(F.count("*").alias("_nb"), F.max("fingerprint").alias("_fb"))
    both = a.join(b, keys, "full_outer")
    count = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0))
    return both.agg(
        count(F.col("_na").isNotNull() & F.col("_nb").isNotNull() & (F.col("_fa") == F.col("_fb"))).alias("matched"),
        count(F.col("_nb").isNull()).alias("missing"),
        count(F.col("_na").isNull()).alias("extra"),
        count(F.col("_fa") != F.col("_fb")).alias("changed"),
        count((F.col("_na") > 1) | (F.col("_nb") > 1)).alias("repeated"),
    )


def reconcile_multiset(removed: DataFrame, added: DataFrame) -> DataFrame:
    """One row of counts for rows without identity: equal fingerprints must be as many on both sides.

    Counting per fingerprint, with partial counts first, is the pairing of ranks without ranking: a row that
    a third of the table repeats costs one row in the shuffle.
    """
    a = removed.groupBy("fingerprint").agg(F.count("*").alias("_na"))
    b = added.groupBy("fingerprint").agg(F.count("*").alias("_nb"))
    na, nb = F.coalesce("_na", F.lit(0)), F.coalesce("_nb", F.lit(0))
    return a.join(b, "fingerprint", "full_outer").agg(
        F.coalesce(F.sum(F.least(na, nb)), F.lit(0)).alias("matched"), F.coalesce(F.sum(F.greatest(na - nb, F.lit(0))), F.lit(0)).alias("missing"), F.coalesce(F.sum(F.greatest(nb - na, F.lit(0))), F.lit(0)).alias("extra")
    )


def multiset_pairs(removed: DataFrame, added: DataFrame) -> DataFrame:
    """(fingerprint, nth, old_path, old_pos, new_path, new_pos): equal rows paired in order of place, so identities move along."""
    w = Window.partitionBy("fingerprint").orderBy("path", "pos")
    a = removed.select("fingerprint", F.row_number().over(w).alias("nth"), F.col("path").alias("old_path"), F.col("pos").alias("old_pos"))
    b = added.select("fingerprint", F.row_number().over(w).alias("nth"), F.col("path").alias("new_path"), F.col("pos").alias("new_pos"))
    return a.join(b, ["fingerprint", "nth"], "full_outer")


def file_set_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) between two snapshots' files."""
    gone = before.select("path").subtract(after.select("path")).withColumn("change", F.lit("removed"))
    return after.select("path").subtract(before.select("path")).withColumn("change", F.lit("added")).unionByName(gone)


def resolve_unchanged(partial: DataFrame, original: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Values that updates left out, from the row before the log; a row that isn't there any more raises."""
    o = original.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(c).alias(f"_o_{c}") for c in columns], F.lit(True).alias("_there"))
    joined = partial.join(o, [F.col(k) == F.col(f"_k_{k}") for k in keys], "left")
    lost = (F.size("unresolved") > 0) & F.col("_there").isNull()
    pick = lambda c: F.when(lost, F.raise_error(F.lit("no row to take omitted values from"))).when(F.array_contains("unresolved", c), F.col(f"_o_{c}")).otherwise(F.col(c)).alias(c)
    return joined.select(*[pick(c) if c in columns else F.col(c) for c in partial.columns if c != "unresolved"])
