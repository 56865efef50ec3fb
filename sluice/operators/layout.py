"""Sort order, sortedness, overlap of file ranges and position runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.plans.schema import SortField


def sort_columns(order: list[SortField]) -> list[Column]:
    """Ordering expressions; nulls go where the field says in either direction."""
    made = {(True, True): "asc_nulls_first", (True, False): "asc_nulls_last", (False, True): "desc_nulls_first", (False, False): "desc_nulls_last"}
    return [getattr(F.col(s.column), made[s.ascending, s.nulls_first])() for s in order]


def parse_sort(text: str) -> list[SortField]:
    """``a, b desc nulls last``; anything but plain columns is refused."""
    fields = []
    for part in text.split(","):
        words = part.split()
        if not words or not words[0].replace("_", "a").isalnum():
            raise ValueError(f"unsupported sort field: {part.strip()!r}")
        rest = [w.lower() for w in words[1:]]
        ascending = rest[:1] != ["desc"]
        rest = rest[1:] if rest[:1] in (["asc"], ["desc"]) else rest
        if rest not in ([], ["nulls", "first"], ["nulls", "last"]):
            raise ValueError(f"unsupported sort field: {part.strip()!r}")
        fields.append(SortField(words[0], ascending, rest[1] == "first" if rest else ascending))
    return fields


def inversions(rows: DataFrame, order: list[SortField], file: str, position: str) -> DataFrame:
    """(file, rows, inversions): neighbours of a file that are in the wrong order; 0 proves that it is sorted."""
    w = Window.partitionBy(file).orderBy(position)
    wrong, equal = F.lit(False), F.lit(True)
    for s in order:
        now, before = F.col(s.column), F.lag(s.column).over(w)
        first, last = (before, now) if s.ascending else (now, before)
        out = F.coalesce(first > last, F.lit(False)) | ((now.isNull() & before.isNotNull()) if s.nulls_first else (now.isNotNull() & before.isNull()))
        wrong = wrong | (equal & out)
        equal = equal & now.eqNullSafe(before)
    has = F.lag(F.lit(1)).over(w).isNotNull()
    marked = rows.withColumn("_wrong", (has & wrong).cast("int"))
    return marked.groupBy(file).agg(F.count("*").alias("rows"), F.sum("_wrong").alias("inversions"))


def disjoint_in_order(files: DataFrame) -> DataFrame:
    """One row ``key_order``: whether sorted files with bounds follow each other without overlap, so that reading them by key keeps order."""
    w = Window.orderBy("lower", "upper", "path")  # one row a file
    bad = F.col("lower").isNull() | F.col("upper").isNull() | ~F.col("sorted") | F.coalesce(F.lag("upper").over(w) >= F.col("lower"), F.lit(False))
    return files.withColumn("_bad", bad).agg((F.max(F.col("_bad").cast("int")) == 0).alias("key_order"))


def overlap(files: DataFrame) -> DataFrame:
    """(path, files, rows_met): for each file how many files' closed ranges meet its own, itself included.

    A range meets all but those that start after it ends or end before it starts, so
    two running sums over sorted bounds count without pairing files.
    """
    bound = files.where("lower is not null and upper is not null")
    events = bound.select(F.col("lower").alias("at"), F.lit(0).alias("side"), "row_count").unionByName(bound.select(F.col("upper").alias("at"), F.lit(1).alias("side"), "row_count"))
    # At a point: starts up to and including it, and ends strictly before it.
    points = events.groupBy("at").agg(F.sum(F.when(F.col("side") == 0, 1).otherwise(0)).alias("s"), F.sum(F.when(F.col("side") == 1, 1).otherwise(0)).alias("e"), F.sum(F.when(F.col("side") == 0, F.col("row_count")).otherwise(0)).alias("sr"), F.sum(F.when(F.col("side") == 1, F.col("row_count")).otherwise(0)).alias("er"))
    w = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)  # two rows a file at most
    sums = points.select("at", F.sum("s").over(w).alias("started"), F.sum("sr").over(w).alias("started_rows"), (F.sum("e").over(w) - F.col("e")).alias("ended"), (F.sum("er").over(w) - F.col("er")).alias("ended_rows"))
    low = sums.select(F.col("at").alias("lower"), "ended", "ended_rows")
    high = sums.select(F.col("at").alias("upper"), "started", "started_rows")
    return bound.join(low, "lower").join(high, "upper").select("path", "row_count", (F.col("started") - F.col("ended")).alias("files"), (F.col("started_rows") - F.col("ended_rows")).alias("rows_met"))


def depth(files: DataFrame) -> DataFrame:
    """One row ``max_files``: the most file ranges that share a point."""
    bound = files.where("lower is not null and upper is not null")
    events = bound.select(F.col("lower").alias("at"), F.lit(0).alias("side"), F.lit(1).alias("delta")).unionByName(bound.select(F.col("upper").alias("at"), F.lit(1).alias("side"), F.lit(-1).alias("delta")))
    w = Window.orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("_open", F.sum("delta").over(w)).agg(F.coalesce(F.max("_open"), F.lit(0)).alias("max_files"))


def report(files: DataFrame) -> DataFrame:
    """One row: level counts, sorted shares, and how file ranges overlap."""
    totals = files.agg(
        F.count("*").alias("data_files"), F.sum("row_count").alias("data_rows"), F.sum("size_bytes").alias("data_bytes"),
        *[F.sum((F.col("level") == i).cast("long")).alias(f"l{i}_files") for i in range(3)],
        F.sum(F.when(F.col("sorted"), 1).otherwise(0)).alias("sorted_files"), F.sum(F.when(F.col("sorted"), F.col("row_count")).otherwise(0)).alias("sorted_rows"),
        F.sum(F.when(~F.col("sorted") & (F.col("level") != 0), F.col("size_bytes")).otherwise(0)).alias("unsorted_bytes"), F.sum(F.when(F.col("lower").isNull() | F.col("upper").isNull(), 1).otherwise(0)).alias("files_without_bounds"),
    )
    met = overlap(files)
    means = met.agg((F.sum(F.col("row_count") * F.col("files")) / F.greatest(F.sum("row_count"), F.lit(1))).alias("mean_files"), (F.sum(F.col("row_count") * F.col("rows_met")) / F.pow(F.greatest(F.sum("row_count"), F.lit(1)), 2)).alias("lookup_rows_ratio"))
    return totals.crossJoin(means).crossJoin(depth(files))


def remap_runs(moves: DataFrame, width: int = 1 << 16) -> DataFrame:
    """(old_path, old_start, new_path, new_start, length): rows that moved side by side, as runs.  Input: old_path, old_pos, new_path, new_pos.

    Runs are found within blocks of ``width`` positions; only those that reach a block's edge are sorted over all blocks of their files.
    """
    own = ["old_path", "new_path", "_shift"]
    rows = moves.withColumn("_shift", F.col("new_pos") - F.col("old_pos")).withColumn("_block", F.floor(F.col("old_pos") / width))
    islands = rows.withColumn("_island", F.col("old_pos") - F.row_number().over(Window.partitionBy(*own, "_block").orderBy("old_pos")))
    parts = islands.groupBy(*own, "_block", "_island").agg(F.min("old_pos").alias("old_start"), F.count("*").alias("length"))
    end = F.col("old_start") + F.col("length")
    edge = (F.col("old_start") == F.col("_block") * width) | (end == (F.col("_block") + 1) * width)
    parts = parts.withColumn("_end", end).withColumn("_lane", F.when(~edge, F.col("_block")))  # null: may go on in another block
    w = Window.partitionBy(*own, "_lane").orderBy("old_start")
    fresh = (~F.lag("_end").over(w).eqNullSafe(F.col("old_start"))).cast("long")
    runs = parts.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = runs.groupBy(*own, "_lane", "_run").agg(F.min("old_start").alias("old_start"), F.sum("length").alias("length"))
    return found.select("old_path", "new_path", "old_start", (F.col("old_start") + F.col("_shift")).alias("new_start"), "length")


def translate(positions: DataFrame, runs: DataFrame, width: int = 4096) -> DataFrame:
    """(path, pos) of old positions in the new files, by the run that holds them.

    A range join by equality: runs are listed in the blocks of ``width`` positions they touch.
    """
    r = runs.withColumn("_block", F.explode(F.sequence(F.floor(F.col("old_start") / width), F.floor((F.col("old_start") + F.col("length") - 1) / width))))
    p = positions.select(F.col("path").alias("old_path"), F.col("pos").alias("old_pos")).withColumn("_block", F.floor(F.col("old_pos") / width))
    met = p.join(r, ["old_path", "_block"]).where("old_pos >= old_start and old_pos < old_start + length")
    return met.select("old_path", "old_pos", F.col("new_path").alias("path"), (F.col("new_start") + F.col("old_pos") - F.col("old_start")).alias("pos"))
