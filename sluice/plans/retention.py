"""Which snapshots expire, and which files nothing needs any more."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def expiration(snapshots: DataFrame, now_ms: int, window_ms: int = 3_600_000, retain_last: int = 128, cap: int = 1000, protected: DataFrame | None = None, table_window_ms: int | None = None) -> DataFrame:
    """``fate`` of each snapshot (id, parent, sequence, ts_ms) of a linear history.

    protected: the newest ``retain_last``, and bases with all that came after them; forced: the oldest others while there are more
    than ``cap`` (not within the table's own window); window: younger than the cutoff; aged: what is left, which expires too.
    """
    place = F.struct("sequence", "id")
    base = F.lit(False)
    rows = snapshots
    if protected is not None:
        oldest = snapshots.join(F.broadcast(protected.select("id")), "id", "left_semi").agg(F.min("sequence").alias("_base"))
        rows = rows.crossJoin(F.broadcast(oldest))
        base = F.coalesce(F.col("sequence") >= F.col("_base"), F.lit(False))
    # The newest ``n`` are told by the place of the last of them, so that no task sorts the whole history.
    since = lambda of, n, name: of.select(place.alias("_at")).orderBy(F.desc("_at")).limit(max(n, 0)).agg(F.min("_at").alias(name))
    rows = rows.crossJoin(F.broadcast(since(snapshots, retain_last, "_held")))
    held = base | F.coalesce(place >= F.col("_held"), F.lit(False))
    cutoff = now_ms - max(window_ms, table_window_ms or 0)
    may_force = ~held & (F.lit(True) if table_window_ms is None else F.col("ts_ms") < now_ms - table_window_ms)
    rows = rows.withColumn("_may_force", may_force)
    # All but ``cap`` are forced, the oldest first, so of those that may be the newest (their number - all + cap) aren't: ``cap`` at most.
    counts = rows.agg((F.count(F.when(F.col("_may_force"), 1)) - F.count("*") + cap).alias("_spared"))
    newest = rows.where("_may_force").select(place.alias("_at")).orderBy(F.desc("_at")).limit(max(cap, 0))
    ranked = newest.withColumn("_nth", F.row_number().over(Window.orderBy(F.desc("_at"))))  # ``cap`` rows
    spared = ranked.crossJoin(F.broadcast(counts)).where("_nth <= _spared").agg(F.min("_at").alias("_last"))
    rows = rows.crossJoin(F.broadcast(spared))
    forced = F.col("_may_force") & F.coalesce(place < F.col("_last"), F.lit(True))
    fate = F.when(held, "protected").when(forced, "forced").when(F.col("ts_ms") >= cutoff, "window").otherwise("aged")
    return rows.withColumn("fate", fate).select(*snapshots.columns, "fate")


def reachable(*manifests: DataFrame) -> DataFrame:
    """Paths that any retained snapshot's manifest names."""
    every = manifests[0].select("path")
    for m in manifests[1:]:
        every = every.unionByName(m.select("path"))
    return every.distinct()


def unreferenced(registered: DataFrame, needed: DataFrame, pending: DataFrame | None, now_ms: int, grace_ms: int = 24 * 3_600_000, enabled: bool = True) -> DataFrame:
    """Registered files (path, unreferenced_since_ms) that nothing needs for longer than the grace."""
    if not enabled:
        return registered.limit(0)
    found = registered.join(needed.select("path"), "path", "left_anti")
    if pending is not None:
        found = found.join(pending.select("path"), "path", "left_anti")
    return found.where(F.col("unreferenced_since_ms") < now_ms - grace_ms)
