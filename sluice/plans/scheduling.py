"""When a table's pending work is due, and which table is next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Latency budgets by priority, and the longest wait of the first, in milliseconds.
BUDGETS = {"realtime": 900, "balanced": 3000, "efficient": 15_000}
REALTIME_WAIT = 400
UNKNOWN_SERVICE = 300
SAMPLES = 32


def service_estimate(samples: DataFrame) -> DataFrame:
    """(table_id, estimate_ms): the 95th percentile (nearest rank) of each table's last 32 service times.  Input: table_id, at, ms."""
    recent = samples.withColumn("_age", F.row_number().over(Window.partitionBy("table_id").orderBy(F.desc("at")))).where(F.col("_age") <= SAMPLES)
    ranked = recent.withColumn("_rank", F.row_number().over(Window.partitionBy("table_id").orderBy("ms", "at"))).withColumn("_n", F.count("*").over(Window.partitionBy("table_id")))
    return ranked.where(F.col("_rank") == F.floor((F.col("_n") * 95 + 99) / 100)).select("table_id", F.col("ms").alias("estimate_ms"))


def due(pending: DataFrame, estimates: DataFrame, max_rows: int = 10_000, max_bytes: int = 32 << 20) -> DataFrame:
    """``ready_at`` of each table's pending work: (table_id, priority, first_ms, source_age_ms, rows or null, bytes)."""
    joined = pending.join(estimates, "table_id", "left").withColumn("_estimate", F.coalesce("estimate_ms", F.lit(UNKNOWN_SERVICE)))
    budget = F.coalesce(*[F.when(F.col("priority") == k, v) for k, v in BUDGETS.items()])
    wait = F.greatest(F.greatest(budget - F.col("_estimate"), F.lit(0)) - F.col("source_age_ms"), F.lit(0))
    wait = F.when(F.col("priority") == "realtime", F.least(wait, F.lit(REALTIME_WAIT))).otherwise(wait)
    now = F.col("rows").isNull() | (F.col("rows") >= max_rows) | (F.col("bytes") >= max_bytes)
    return joined.withColumn("ready_at", F.col("first_ms") + F.when(now, 0).otherwise(wait)).drop("estimate_ms", "_estimate")


def next_table(ready: DataFrame) -> DataFrame:
    """The table to publish next: earliest due, then the most urgent priority, then its id."""
    rank = F.coalesce(*[F.when(F.col("priority") == k, i) for i, k in enumerate(BUDGETS)])
    return ready.orderBy("ready_at", rank, "table_id").limit(1)
