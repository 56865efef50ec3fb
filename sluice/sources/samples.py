"""Change logs and inventories derived from the sample tables by arithmetic on their keys.

SQL can derive the same, which is what the queries of the catalogue are held against.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER_COLUMNS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def none() -> Column:
    """No column names."""
    return F.array().cast("array<string>")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", *ORDER_COLUMNS)


def base_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base copy: nine of ten orders."""
    return orders(spark, sf_dir).where("o_orderkey % 10 <> 0")


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts of the other orders, updates of every third (price raised, priority left out), deletes of every seventh."""
    o = orders(spark, sf_dir)
    order = lambda base: [(F.lit(base) + F.col("o_orderkey")).alias("end_lsn"), F.lit(0).cast("long").alias("ordinal"), F.lit(0).alias("half")]
    row = lambda op, unchanged: [F.lit(op).alias("op"), unchanged.alias("unchanged")]
    inserts = o.where("o_orderkey % 10 = 0").select("*", *order(1_000_000_000), *row("I", none()))
    updates = o.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("U")).withColumn("o_totalprice", F.col("o_totalprice") + 1).withColumn("o_orderpriority", F.lit(None).cast("string"))
    updates = updates.select("*", *order(2_000_000_000), *row("U", F.array(F.lit("o_orderpriority"))))
    deletes = o.where("o_orderkey % 7 = 0").select("o_orderkey", *[F.lit(None).cast(t).alias(c) for c, t in o.dtypes if c != "o_orderkey"], *order(3_000_000_000), *row("D", none()))
    return inserts.unionByName(updates).unionByName(deletes)


def second_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second epoch: every eleventh order that is left gets a new customer."""
    o = orders(spark, sf_dir).where("o_orderkey % 7 <> 0 and o_orderkey % 11 = 0")
    return o.select(
        "o_orderkey", (F.col("o_custkey") + 1).alias("o_custkey"), *[F.lit(None).cast(t).alias(c) for c, t in o.dtypes if c not in ("o_orderkey", "o_custkey")],
        (F.lit(4_000_000_000) + F.col("o_orderkey")).alias("end_lsn"), F.lit(0).cast("long").alias("ordinal"), F.lit(0).alias("half"), F.lit("U").alias("op"), F.array(*[F.lit(c) for c in ORDER_COLUMNS[1:]]).alias("unchanged"),
    )


def replication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a stream: each user's events are one transaction that commits at its end, each type a table.

    Every fifth user's transaction has a rolled-back savepoint: the events whose id is 3 modulo 4 belong to
    subtransaction 1, which aborts after the user's last event.  Every ninth user's transaction aborts as a whole.
    """
    e = table(spark, sf_dir, "events").select((F.col("event_id") * 10).alias("position"), F.col("user_id").alias("xid"), "event_type", "event_id")
    kinds = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "click", 2).otherwise(3)
    changes = e.select("position", F.lit("insert").alias("kind"), "xid", F.when((F.col("xid") % 5 == 0) & (F.col("event_id") % 4 == 3), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("subxid"), kinds.cast("long").alias("table_id"))
    ends = e.groupBy("xid").agg(F.min("position").alias("first"), F.max("position").alias("last"))
    none = F.lit(None).cast("long")
    aborts = ends.where("xid % 5 = 0").select((F.col("last") + 1).alias("position"), F.lit("abort").alias("kind"), "xid", F.lit(1).cast("long").alias("subxid"), none.alias("table_id"))
    drops = ends.where("xid % 9 = 0").select((F.col("last") + 2).alias("position"), F.lit("abort").alias("kind"), "xid", F.col("xid").alias("subxid"), none.alias("table_id"))
    body = changes.unionByName(aborts).unionByName(drops)
    for c in ("begin_lsn", "commit_lsn", "end_lsn"):
        body = body.withColumn(c, none)
    commits = ends.where("xid % 9 <> 0").select((F.col("last") + 3).alias("position"), F.lit("commit").alias("kind"), "xid", F.lit(0).cast("long").alias("subxid"), none.alias("table_id"), F.col("first").alias("begin_lsn"), (F.col("last") + 3).alias("commit_lsn"), (F.col("last") + 4).alias("end_lsn"))
    return body.unionByName(commits)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inventory from ``lineitem``: 16 files by order key, with declared sizes, levels, ages and deletes."""
    n = F.col("file")
    rows = table(spark, sf_dir, "lineitem").withColumn("file", F.col("l_orderkey") % 16)
    return rows.groupBy("file").agg(F.count("*").alias("row_count"), F.sum((F.col("l_quantity") < 3 * F.col("file")).cast("long")).alias("deleted_rows"), F.min("l_orderkey").alias("low"), F.max("l_orderkey").alias("high")).select(
        F.format_string("f%02d", n).alias("path"), (n % 3).cast("int").alias("level"), (F.col("row_count") * 1000 * (n + 1)).alias("size_bytes"), "row_count", "deleted_rows", (n % 10).alias("delete_files"), (n * 997).alias("age_ms"),
        (F.col("low") + n * 50).alias("lower"), (F.col("low") + n * 50 + 120).alias("upper"), (n % 4 != 1).alias("sorted"), n.alias("sequence"), F.lit(0).alias("partition"),
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, pos): every thirteenth line of each file, some twice."""
    l = table(spark, sf_dir, "lineitem").where("(l_orderkey * 7 + l_linenumber) % 13 = 0")  # noqa: E741
    rows = l.select(F.format_string("f%02d", F.col("l_orderkey") % 16).alias("path"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"))
    return rows.unionByName(rows.where("pos % 2 = 0"))


def delete_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete files over the inventory: exact, ranged and vectors, of different ages."""
    n = F.col("sequence")
    own = files(spark, sf_dir).select("path", "sequence")
    exact = own.where(n % 2 == 0).select(F.concat(F.lit("d-"), "path").alias("path"), F.lit("pos").alias("kind"), F.col("path").alias("target"), F.col("path").alias("lower_path"), F.col("path").alias("upper_path"), (n + n % 3 - 1).alias("sequence"))
    ranged = own.where(n % 5 == 0).select(F.concat(F.lit("r-"), "path").alias("path"), F.lit("pos").alias("kind"), F.lit(None).cast("string").alias("target"), F.col("path").alias("lower_path"), F.format_string("f%02d", F.least(n + 4, F.lit(15))).alias("upper_path"), (n + 2).alias("sequence"))
    vector = own.where(n % 7 == 3).select(F.concat(F.lit("v-"), "path").alias("path"), F.lit("dv").alias("kind"), F.col("path").alias("target"), F.col("path").alias("lower_path"), F.col("path").alias("upper_path"), (n + 1).alias("sequence"))
    return exact.unionByName(ranged).unionByName(vector).withColumn("partition", F.lit(0))
