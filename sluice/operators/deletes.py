"""Position deletes and deletion vectors: applicability, union, residuals, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def applicable(deletes: DataFrame, files: DataFrame) -> DataFrame:
    """(delete, target) pairs of file entries: a delete applies to a data file of the same partition that isn't newer
    than it and whose path it references or has within its bounds; a vector hides older deletes of its target.

    ``deletes``: path, kind, target, lower_path, upper_path, sequence, partition.  ``files``: path, sequence, partition.
    Deletes of one target meet it by an equality; only those of path ranges meet files by range, within their partition.
    """
    d, f = deletes.alias("d"), files.alias("f")
    same = (F.col("d.partition").eqNullSafe(F.col("f.partition"))) & (F.col("d.sequence") >= F.col("f.sequence"))
    pair = [F.col("d.path").alias("delete_path"), F.col("d.kind").alias("kind"), F.col("f.path").alias("target")]
    exact = d.where("d.target is not null").join(f, same & (F.col("d.target") == F.col("f.path"))).select(*pair)
    lower = F.col("d.lower_path").isNull() | (F.col("d.lower_path") <= F.col("f.path"))
    upper = F.col("d.upper_path").isNull() | (F.col("d.upper_path") >= F.col("f.path"))
    ranged = d.where("d.target is null").join(f, same & lower & upper).select(*pair)
    pairs = exact.unionByName(ranged)
    has_vector = F.max((F.col("kind") == "dv").cast("int")).over(Window.partitionBy("target"))
    return pairs.withColumn("_vector", has_vector).where("kind = 'dv' or _vector = 0").select("delete_path", "target", "kind")


def effective_positions(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """(path, pos) that delete rows (delete_path, path, pos, kind) take from the live data files of ``entries``."""
    data = entries.where("kind = 'data'").select("path", F.col("sequence").alias("data_sequence"))
    made = entries.where("kind <> 'data'").select(F.col("path").alias("delete_path"), F.col("sequence").alias("delete_sequence")).distinct()
    vectors = entries.where("kind = 'dv'").select(F.col("target").alias("path")).distinct().withColumn("_vector", F.lit(True))
    found = rows.join(data, "path").join(made, "delete_path").where("delete_sequence >= data_sequence")
    found = found.join(vectors, "path", "left").where("kind = 'dv' or _vector is null")
    return found.select("path", "pos").distinct()


def sorted_positions(positions: DataFrame) -> DataFrame:
    return positions.select("path", "pos").distinct().orderBy("path", "pos")


def vectors(positions: DataFrame) -> DataFrame:
    """One row a target: its distinct positions in order.  A target's positions are bounded by its rows."""
    return positions.groupBy("path").agg(F.sort_array(F.collect_set("pos")).alias("positions"))


def residual(positions: DataFrame, rewritten: DataFrame) -> DataFrame:
    """Positions that stay after the data files in ``rewritten`` (path) went."""
    return positions.join(rewritten.select("path"), "path", "left_anti").select("path", "pos").distinct()


def still_needed(deletes: DataFrame, survivors: DataFrame) -> DataFrame:
    """Delete files (delete_path, target) that a surviving data file (path) still needs."""
    return deletes.join(survivors.select(F.col("path").alias("target")), "target", "left_semi").select("delete_path").distinct()


def merge_runs(runs: list[DataFrame], kept: DataFrame | None = None) -> DataFrame:
    """The union of sorted delete runs without repeats, restricted to targets in ``kept`` (path)."""
    every = runs[0]
    for r in runs[1:]:
        every = every.unionByName(r)
    every = every.select("path", "pos").distinct()
    return every if kept is None else every.join(kept.select("path"), "path", "left_semi")


def dense(files: DataFrame, percent: int = 30) -> DataFrame:
    """Files of which at least ``percent`` of the rows are deleted."""
    return files.where((F.col("row_count") > 0) & (F.col("deleted_rows") * 100 >= F.col("row_count") * percent))
