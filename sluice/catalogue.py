"""All queries of the engine and the SQL each is held against.

Each query works on whole tables; change logs and inventories are derived from
them by arithmetic (``sluice.sources.samples``), which the SQL repeats.  Queries
without SQL are sequential or produce exact text that SQL can't express; tests hold
them against plain Python.
"""

from __future__ import annotations

import functools
import itertools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import decode, scalars, texts
from sluice.operators import assembly, collapse, deletes, layout, ledger, reconcile
from sluice.plans import compaction, maintenance, publish, retention, scheduling, schema
from sluice.plans.storage import workspace
from sluice.plans.table import Table
from sluice.sources import changes as change_sources
from sluice.sources import samples
from sluice.streaming import ingest

KEYS, COLUMNS = ["o_orderkey"], samples.ORDER_COLUMNS
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: The order log of ``samples`` in SQL, and what each key has become after it.
LOG = """
log AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, 1 AS step, 'I' AS op FROM orders WHERE o_orderkey % 10 = 0
  UNION ALL SELECT o_orderkey, o_custkey, 'U', o_totalprice + 1, NULL, 2, 'U' FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT o_orderkey, NULL, NULL, NULL, NULL, 3, 'D' FROM orders WHERE o_orderkey % 7 = 0
)"""
STATE = """
state AS (
  SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'U' ELSE o_orderstatus END AS o_orderstatus,
         CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderpriority
  FROM orders WHERE o_orderkey % 7 <> 0
)"""


def money(c: str) -> F.Column:
    return F.col(c).cast("decimal(18,2)")


# -- collapse ---------------------------------------------------------------


@query(f"WITH {LOG}, ranked AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY step DESC) AS n FROM log) SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM ranked WHERE n = 1 AND op <> 'D'")
def collapse_final_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse.collapse(samples.order_log(spark, sf_dir), KEYS, COLUMNS).where("present").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query(f"WITH {LOG} SELECT o_orderkey, bool_or(op = 'I') AS was_new FROM log GROUP BY o_orderkey HAVING bool_or(op = 'D')")
def collapse_insert_then_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse.collapse(samples.order_log(spark, sf_dir), KEYS, COLUMNS).where("not present").select("o_orderkey", (~F.col("required")).alias("was_new"))


@query("SELECT CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey + 1000000000 ELSE o_orderkey END AS o_orderkey, o_custkey FROM orders UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 4 = 0")
def collapse_key_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth order moves to another key: its old key is deleted, its new one inserted."""
    o = samples.orders(spark, sf_dir).select("o_orderkey", "o_custkey")
    moved = (F.col("o_orderkey") % 4) == 0
    log = o.select(
        F.when(moved, F.col("o_orderkey") + 1_000_000_000).otherwise(F.col("o_orderkey")).alias("o_orderkey"), "o_custkey", F.struct("o_orderkey").alias("old_key"), F.lit("U").alias("op"),
        F.col("o_orderkey").alias("end_lsn"), F.lit(0).cast("long").alias("ordinal"), F.lit(0).alias("half"), samples.none().alias("unchanged"),
    )
    done = collapse.collapse(collapse.split_key_changes(log, KEYS), KEYS, ["o_custkey"])
    return done.select("o_orderkey", F.when(F.col("present"), F.col("o_custkey")).alias("o_custkey"))


@query(f"WITH {LOG} SELECT o_orderkey, max(CASE WHEN op = 'I' THEN o_orderpriority END) AS o_orderpriority, NOT bool_or(op = 'I') AS is_open FROM log GROUP BY o_orderkey HAVING NOT bool_or(op = 'D')")
def collapse_unchanged_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value that an update left out is the insert's, or is open where the row is older than the log."""
    done = collapse.collapse(samples.order_log(spark, sf_dir), KEYS, COLUMNS).where("present")
    return done.select("o_orderkey", "o_orderpriority", F.array_contains("unresolved", "o_orderpriority").alias("is_open"))


@query("""
WITH log AS (SELECT o_orderkey, 1 AS step, 'I' AS op FROM orders UNION ALL SELECT o_orderkey, 2, CASE WHEN o_orderkey % 5 = 0 THEN 'I' ELSE 'D' END FROM orders UNION ALL SELECT o_orderkey, 3, 'U' FROM orders WHERE o_orderkey % 2 = 0),
before AS (SELECT *, lag(op) OVER (PARTITION BY o_orderkey ORDER BY step) AS p FROM log)
SELECT o_orderkey, CASE WHEN op = 'I' THEN 'insert of a present key' ELSE 'change of an absent key' END AS conflict FROM before WHERE (op = 'I' AND p IN ('I', 'U')) OR (op IN ('U', 'D') AND p = 'D')""")
def collapse_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = samples.orders(spark, sf_dir).select("o_orderkey")
    step = lambda df, n, op: df.select("o_orderkey", op.alias("op"), F.lit(n).cast("long").alias("end_lsn"), F.lit(0).cast("long").alias("ordinal"), F.lit(0).alias("half"), samples.none().alias("unchanged"))
    log = step(o, 1, F.lit("I")).unionByName(step(o, 2, F.when(F.col("o_orderkey") % 5 == 0, "I").otherwise("D"))).unionByName(step(o.where("o_orderkey % 2 = 0"), 3, F.lit("U")))
    return collapse.with_conflicts(log, KEYS).where("conflict is not null").select("o_orderkey", "conflict")


@query(f"WITH {LOG}, ranked AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY step DESC) AS n, min(step) OVER (PARTITION BY o_orderkey) AS s FROM log) SELECT o_orderkey, s <> 1 AS required, op <> 'D' AS present, o_custkey FROM ranked WHERE n = 1")
def collapse_prefold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log folded in two parts and combined: the same as folded at once."""
    log = samples.order_log(spark, sf_dir)
    parts = [collapse.collapse(log.where(c), KEYS, COLUMNS) for c in ("end_lsn < 2000000000", "end_lsn >= 2000000000")]
    return collapse.combine(*parts, KEYS, COLUMNS).select("o_orderkey", "required", "present", F.when(F.col("present"), F.col("o_custkey")).alias("o_custkey"))


@query("SELECT event_id, user_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_number FROM events")
def keyless_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a key are identified by epoch and place in it."""
    e = samples.table(spark, sf_dir, "events")
    log = e.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("end_lsn"), F.col("event_id").alias("ordinal"), F.lit(0).alias("half"))
    return collapse.numbered(log).select("event_id", "user_id", "row_number")


# -- the table format -------------------------------------------------------


def orders_table(spark: SparkSession, sf_dir: str, version: int = 2, epochs: int = 1, files: int = 4) -> Table:
    """``orders`` as a table: a base copy and up to two published epochs."""
    base = samples.base_orders(spark, sf_dir)
    spec = schema.infer_spec(base, "orders", ("o_orderkey",), format_version=version)
    table = Table.create(spark, f"{workspace(spark)}/orders-{uuid.uuid4().hex}", spec)
    publish.copy(table, base, 0, files)
    for n, log in zip(range(epochs), (samples.order_log, samples.second_log), strict=False):
        publish.publish(table, log(spark, sf_dir), f"epoch-{n}", files)
    return table


@query(f"WITH {STATE} SELECT o_orderstatus, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM state GROUP BY o_orderstatus")
def publish_live_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_table(spark, sf_dir).read().groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum(money("o_totalprice")).cast("decimal(38,2)").alias("total"))


@query(f"WITH {STATE} SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM state")
def publish_two_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_table(spark, sf_dir, epochs=2).read()


@query(f"WITH {STATE} SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM state")
def publish_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two epochs into a table whose deletes are vectors, the second one's united with the first's."""
    return orders_table(spark, sf_dir, version=3, epochs=2).read()


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 10 <> 0")
def time_travel_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_table(spark, sf_dir, epochs=2).read(snapshot_id=1)


@query(f"WITH {STATE} SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey, o_orderstatus FROM state")
def compaction_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files rewritten: the same rows."""
    table = orders_table(spark, sf_dir, epochs=2)
    maintenance.rewrite(table, table.paths("data"), 1, files=2)
    return table.read().select("o_orderkey", "o_custkey", "o_orderstatus")


@query(f"WITH {STATE} SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey, o_orderstatus FROM state")
def maintenance_visit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits of maintenance, with limits that small tables reach, until nothing is left to do: the same rows, no fresh files."""
    table = orders_table(spark, sf_dir, epochs=2)
    policy = compaction.Policy(l0_files=(2, 32), delete_files=(2, 16), min_age_ms=0, group=(1, 32))
    done = []
    while (action := maintenance.visit(table, policy)) != "none":
        done.append(action)
        if len(done) > 20:
            raise RuntimeError("maintenance doesn't come to an end")
    if not {"consolidate", "rewrite"} <= set(done) or table.entries().where("level = 0").count():
        raise RuntimeError(f"visits left work: {done}")
    return table.read().select("o_orderkey", "o_custkey", "o_orderstatus")


@query(f"WITH {STATE} SELECT o_orderkey, o_orderstatus FROM state")
def consolidation_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletes consolidated and manifests rewritten: the same rows."""
    table = orders_table(spark, sf_dir)
    maintenance.consolidate(table)
    table.rewrite_manifests()
    return table.read().select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, 1 + CAST(o_orderkey % 3 = 0 AND o_orderkey % 10 <> 0 AS BIGINT) + CAST(o_orderkey % 11 = 0 AS BIGINT) AS row_version FROM orders WHERE o_orderkey % 7 <> 0")
def row_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1, and 1 more for each epoch that touched the row."""
    return orders_table(spark, sf_dir, epochs=2).live().select("o_orderkey", F.col("_version").alias("row_version"))


@query("SELECT count(*) AS n, count(*) AS different_ids, count(*) FILTER (o_orderkey % 3 = 0 OR o_orderkey % 10 = 0) AS changed_last FROM orders WHERE o_orderkey % 7 <> 0")
def row_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row ids stay one each after an epoch and a rewrite; the last change is the epoch's for touched rows."""
    table = orders_table(spark, sf_dir)
    maintenance.rewrite(table, table.paths("data"), 1)
    rows = table.read(lineage=True)
    return rows.agg(F.count("*").alias("n"), F.countDistinct("_row_id").alias("different_ids"), F.sum((F.col("_last_updated_sequence_number") == 2).cast("long")).alias("changed_last"))


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' END AS note FROM orders WHERE o_orderkey % 10 <> 0")
def schema_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nullable column is appended; old rows have null there."""
    base = samples.base_orders(spark, sf_dir).select("o_orderkey", "o_custkey")
    table = Table.create(spark, f"{workspace(spark)}/evolved-{uuid.uuid4().hex}", schema.infer_spec(base, "orders", ("o_orderkey",)))
    publish.copy(table, base, 0, 2)
    wider = base.where("o_orderkey % 3 = 0").withColumn("note", F.lit("new"))
    table.evolve(schema.successor(table.spec, wider.schema))
    log = wider.select("*", F.col("o_orderkey").alias("end_lsn"), F.lit(0).cast("long").alias("ordinal"), F.lit(0).alias("half"), F.lit("U").alias("op"), F.array(F.lit("o_custkey")).alias("unchanged"))
    publish.publish(table, log.withColumn("o_custkey", F.lit(None).cast("long")), "wider", 2)
    return table.read()


@query(f"WITH {STATE} SELECT o_orderkey, o_custkey FROM state WHERE o_orderkey % 100 < 50")
def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of keys looked up at a frozen snapshot, after later epochs."""
    table = orders_table(spark, sf_dir, epochs=2)
    wanted = samples.orders(spark, sf_dir).where("o_orderkey % 100 < 50").select("o_orderkey")
    return table.live(table.snapshot(2)).join(wanted, "o_orderkey", "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT 4 AS files, count(*) FILTER (o_orderkey % 10 <> 0) AS copied, count(*) FILTER (o_orderkey % 10 <> 0 AND (o_orderkey % 3 = 0 OR o_orderkey % 7 = 0)) AS deleted FROM orders")
def file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory of a table's base files after an epoch: rows and rows deleted."""
    return maintenance.inventory(orders_table(spark, sf_dir)).where("level = 1").agg(F.count("*").cast("int").alias("files"), F.sum("row_count").alias("copied"), F.sum("deleted_rows").alias("deleted"))


@query("SELECT * FROM (VALUES (0, NULL, 'create'), (1, 0, 'append'), (2, 1, 'overwrite'), (3, 2, 'overwrite')) t(id, parent, operation)")
def snapshot_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_table(spark, sf_dir, epochs=2).history().select(F.col("id").cast("int"), F.col("parent").cast("int"), "operation")


@query("SELECT 3 AS snapshots, 2 AS again, TRUE AS same")
def publish_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An epoch that is published again, as after a lost response, finds its snapshot; one without effect adds none."""
    table = orders_table(spark, sf_dir)
    before = table.snapshot()
    again = publish.publish(table, samples.order_log(spark, sf_dir), "epoch-0")
    empty = publish.publish(table, samples.order_log(spark, sf_dir).where("op = 'X'"), "epoch-empty")
    return spark.createDataFrame([(len(table.snapshot_ids()), again.id, empty.id == before.id)], "snapshots int, again int, same boolean")


# -- deletes ----------------------------------------------------------------

POSITIONS = "pos AS (SELECT DISTINCT printf('f%02d', l_orderkey % 16) AS path, l_orderkey * 8 + l_linenumber AS pos FROM lineitem WHERE (l_orderkey * 7 + l_linenumber) % 13 = 0)"
FILES = """
inv AS (SELECT l_orderkey % 16 AS n, count(*) AS row_count, count(*) FILTER (l_quantity < 3 * (l_orderkey % 16)) AS deleted_rows, min(l_orderkey) AS low, max(l_orderkey) AS high FROM lineitem GROUP BY 1),
files AS (SELECT printf('f%02d', n) AS path, n AS sequence, CAST(n % 3 AS INT) AS level, row_count * 1000 * (n + 1) AS size_bytes, row_count, deleted_rows, n % 10 AS delete_files, n * 997 AS age_ms, low + n * 50 AS lower, low + n * 50 + 120 AS upper, n % 4 <> 1 AS sorted FROM inv)"""
DELETES = """
dels AS (
  SELECT 'd-' || path AS path, 'pos' AS kind, path AS target, path AS lower_path, path AS upper_path, sequence + sequence % 3 - 1 AS sequence FROM files WHERE sequence % 2 = 0
  UNION ALL SELECT 'r-' || path, 'pos', NULL, path, printf('f%02d', least(sequence + 4, 15)), sequence + 2 FROM files WHERE sequence % 5 = 0
  UNION ALL SELECT 'v-' || path, 'dv', path, path, path, sequence + 1 FROM files WHERE sequence % 7 = 3),
pairs AS (SELECT d.path AS delete_path, d.kind, f.path AS target FROM dels d JOIN files f ON d.sequence >= f.sequence AND d.lower_path <= f.path AND d.upper_path >= f.path),
kept AS (SELECT *, max(CASE WHEN kind = 'dv' THEN 1 ELSE 0 END) OVER (PARTITION BY target) AS v FROM pairs),
applied AS (SELECT delete_path, target, kind FROM kept WHERE kind = 'dv' OR v = 0)"""


@query(f"WITH {POSITIONS} SELECT path, pos FROM pos")
def position_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deletes.sorted_positions(samples.positions(spark, sf_dir))


@query(f"WITH {POSITIONS} SELECT path, list(pos ORDER BY pos) AS positions FROM pos GROUP BY path")
def deletion_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deletes.vectors(samples.positions(spark, sf_dir))


@query(f"WITH {FILES}, {DELETES} SELECT * FROM applied")
def delete_applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deletes.applicable(samples.delete_files(spark, sf_dir), samples.files(spark, sf_dir))


@query(f"WITH {POSITIONS} SELECT path, pos FROM pos WHERE CAST(substr(path, 2) AS INT) % 3 <> 0")
def residual_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deletes.residual(samples.positions(spark, sf_dir), samples.files(spark, sf_dir).where("sequence % 3 = 0"))


@query(f"WITH {FILES}, {DELETES} SELECT DISTINCT delete_path FROM applied WHERE CAST(substr(target, 2) AS INT) % 4 <> 0")
def shared_deletes_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = samples.files(spark, sf_dir)
    return deletes.still_needed(deletes.applicable(samples.delete_files(spark, sf_dir), own), own.where("sequence % 4 <> 0"))


@query(f"WITH {POSITIONS} SELECT path, pos FROM pos WHERE CAST(substr(path, 2) AS INT) >= 8")
def merge_delete_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = samples.positions(spark, sf_dir)
    return deletes.merge_runs([p.where("pos % 3 = 0"), p.where("pos % 3 <> 1"), p.where("pos % 3 = 1")], samples.files(spark, sf_dir).where("sequence >= 8"))


@query(f"WITH {POSITIONS} SELECT path, count(*) AS n FROM pos GROUP BY path")
def consolidate_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete files of different writers, merged and counted by target."""
    return deletes.merge_runs([samples.positions(spark, sf_dir)]).groupBy("path").agg(F.count("*").alias("n"))


@query(f"""WITH {POSITIONS}, a AS (SELECT * FROM pos WHERE pos % 5 <> 0), b AS (SELECT * FROM pos WHERE pos % 7 <> 0)
SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_before, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_after""")
def delete_set_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = samples.positions(spark, sf_dir)
    return reconcile.delete_set_difference(p.where("pos % 5 <> 0"), p.where("pos % 7 <> 0"))


# -- transactions -----------------------------------------------------------

KEPT = """
ends AS (SELECT user_id AS xid, min(event_id * 10) AS first, max(event_id * 10) AS last FROM events GROUP BY user_id),
body AS (SELECT event_id * 10 AS position, user_id AS xid, CASE WHEN user_id % 5 = 0 AND event_id % 4 = 3 THEN 1 ELSE 0 END AS subxid, CAST(CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS BIGINT) AS table_id FROM events),
cut AS (SELECT xid, min(position) AS low FROM body WHERE subxid = 1 GROUP BY xid),
kept AS (SELECT b.* FROM body b LEFT JOIN cut c ON b.xid = c.xid WHERE c.low IS NULL OR b.position < c.low)"""


@query(f"WITH {KEPT} SELECT k.xid, k.position, e.last + 4 AS end_lsn, row_number() OVER (PARTITION BY k.xid ORDER BY k.position) - 1 AS ordinal FROM kept k JOIN ends e ON k.xid = e.xid WHERE k.xid % 9 <> 0")
def txn_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.assemble(samples.replication(spark, sf_dir)).select("xid", "position", "end_lsn", "ordinal")


@query(f"WITH {KEPT} SELECT xid, position FROM kept")
def savepoint_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.surviving(samples.replication(spark, sf_dir)).select("xid", "position")


@query(f"WITH {KEPT}, counts AS (SELECT xid, table_id, count(*) AS mutations FROM kept GROUP BY ALL) SELECT e.xid, e.first AS begin_lsn, e.last + 4 AS end_lsn, c.table_id, coalesce(c.mutations, 0) AS mutations FROM ends e LEFT JOIN counts c ON e.xid = c.xid WHERE e.xid % 9 <> 0")
def transaction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.transaction_counts(samples.replication(spark, sf_dir)).select("xid", "begin_lsn", "end_lsn", "table_id", "mutations")


@query("SELECT user_id + 7 AS xid, event_id AS end_lsn FROM events WHERE event_id > 500")
def duplicate_txn_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions that arrive again, or that are staged already, count once."""
    t = samples.table(spark, sf_dir, "events").select((F.col("user_id") + 7).alias("xid"), F.col("event_id").alias("end_lsn"))
    return assembly.unseen(t.unionByName(t.where("end_lsn % 2 = 0")), 500)


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view') AND event_type <> 'view' GROUP BY event_type")
def table_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of configured tables (clicks and views) without blocked ones (views)."""
    e = samples.table(spark, sf_dir, "events").withColumn("table_id", F.when(F.col("event_type") == "click", 2).when(F.col("event_type") == "view", 3).otherwise(9))
    blocked = spark.createDataFrame([(3,)], "table_id int")
    return assembly.configured(e, [2, 3], blocked).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT t AS table_id, CASE WHEN t = 1 THEN 'append_only_mutation' ELSE 'truncate' END AS reason, min(position) AS position
FROM (SELECT event_id AS position, CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS t, event_type, event_id FROM events)
WHERE (t = 1 AND event_id % 2 = 1) OR (t = 2 AND event_id % 50 = 0) GROUP BY t""")
def table_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What blocks a table: updates of an append-only one, truncates."""
    e = samples.table(spark, sf_dir, "events")
    t = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "click", 2).otherwise(3)
    kind = F.when((t == 2) & (F.col("event_id") % 50 == 0), "truncate").when((t == 1) & (F.col("event_id") % 2 == 1), "update").otherwise("insert")
    return assembly.blocks(e.select(F.col("event_id").alias("position"), t.alias("table_id"), kind.alias("kind")), [1])


@query("SELECT count(*) FILTER (event_id % 17 <> 0) AS good, count(*) FILTER (event_id % 17 = 0) AS dead FROM events")
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads that can't be decoded go to the dead letters."""
    e = samples.table(spark, sf_dir, "events").withColumn("payload", F.when(F.col("event_id") % 17 == 0, "x").otherwise(F.col("event_id").cast("string")))
    good, dead = assembly.quarantined(e, F.expr("try_cast(payload as bigint)").isNotNull())
    return good.agg(F.count("*").alias("good")).crossJoin(dead.agg(F.count("*").alias("dead")))


@query(f"WITH {KEPT} SELECT position, xid, subxid, table_id FROM kept WHERE (position // 10) % 17 = 0")
def quarantine_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dead letters of a replication stream: no cell of the row, and nothing that a rollback removed."""
    stream = samples.replication(spark, sf_dir)
    payload = F.when(F.col("position") / 10 % 17 == 0, "x").otherwise(F.col("position").cast("string"))
    return assembly.quarantined(assembly.surviving(stream).withColumn("payload", payload), F.expr("try_cast(payload as bigint)").isNotNull())[1]


@query("SELECT event_id, ts, event_id AS end_lsn, 0 AS ordinal FROM events")
def column_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The configured columns of a change log and the order of changes; excluded cells are never read."""
    e = samples.table(spark, sf_dir, "events").withColumn("end_lsn", F.col("event_id")).withColumn("ordinal", F.lit(0))
    return change_sources.project_columns(e, ["event_id", "ts"])


@query("SELECT event_id FROM events WHERE event_id > 700")
def snapshot_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes up to the position of a table's copy are in it already."""
    e = samples.table(spark, sf_dir, "events").withColumn("end_lsn", F.col("event_id"))
    return publish.after_cut(e, 700).select("event_id")


@query("SELECT event_id FROM events WHERE NOT (user_id % 5 = 0 AND event_id % 4 = 3)")
def excluded_subtransactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replay without the subtransactions that are known to be rolled back."""
    e = samples.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("xid"), F.when((F.col("user_id") % 5 == 0) & (F.col("event_id") % 4 == 3), 1).otherwise(0).alias("subxid"))
    return assembly.without_excluded(e, e.where("subxid = 1").select("xid", "subxid")).select("event_id")


@query("""SELECT event_id AS position, CASE WHEN event_id % 23 = 0 THEN 'unknown kind' ELSE 'change without transaction or table' END AS fault FROM events WHERE event_id % 23 = 0 OR event_id % 29 = 0""")
def stream_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = samples.table(spark, sf_dir, "events")
    s = e.select(F.col("event_id").alias("position"), F.when(F.col("event_id") % 23 == 0, "what").otherwise("insert").alias("kind"), F.col("user_id").alias("xid"), F.when(F.col("event_id") % 29 != 0, 1).alias("table_id"), *[F.lit(None).cast("long").alias(c) for c in ("begin_lsn", "commit_lsn", "end_lsn")])
    return change_sources.faults(s)


@query(f"""WITH {KEPT}, t AS (SELECT DISTINCT e.last + 4 AS end_lsn, k.table_id FROM ends e LEFT JOIN kept k ON k.xid = e.xid WHERE e.xid % 9 <> 0),
s AS (SELECT end_lsn, bool_and(table_id IS NULL OR NOT (table_id = 3 AND end_lsn % 400 = 4)) AS complete FROM t GROUP BY end_lsn)
SELECT max(end_lsn) AS received_lsn, max(end_lsn) AS journal_durable_lsn, coalesce((SELECT max(end_lsn) FROM s WHERE end_lsn < coalesce((SELECT min(end_lsn) FROM s WHERE NOT complete), 9223372036854775807)), 0) AS materialized_lsn FROM s""")
def ledger_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publications of table 3 lag behind; what may be acknowledged is the complete prefix."""
    t = assembly.transaction_counts(samples.replication(spark, sf_dir))
    return ledger.watermarks(t, t.where("table_id is not null and not (table_id = 3 and end_lsn % 400 = 4)"))


TXNS = """txns AS (SELECT event_id % 4 AS table_id, event_id AS end_lsn, CASE WHEN event_id % 97 = 0 THEN 20000 ELSE event_id % 700 END AS mutations, (event_id % 13) * 1000000 AS payload FROM events),
ordered AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY end_lsn) AS n FROM txns)"""


@query(f"""WITH RECURSIVE {TXNS}, walk AS (
  SELECT table_id, n, end_lsn, 0 AS epoch, payload AS held, 1 AS k, (mutations > 10000 OR payload >= 33554432) AS closed FROM ordered WHERE n = 1
  UNION ALL
  SELECT o.table_id, o.n, o.end_lsn, w.epoch + CAST(x.fresh AS INT), CASE WHEN x.fresh THEN o.payload ELSE w.held + o.payload END, CASE WHEN x.fresh THEN 1 ELSE w.k + 1 END,
         o.mutations > 10000 OR (CASE WHEN x.fresh THEN o.payload ELSE w.held + o.payload END) >= 33554432 OR (CASE WHEN x.fresh THEN 1 ELSE w.k + 1 END) >= 40
  FROM walk w JOIN ordered o ON o.table_id = w.table_id AND o.n = w.n + 1, LATERAL (SELECT w.closed OR o.mutations > 10000 OR w.held + o.payload > 33554432 AS fresh) x)
SELECT table_id, end_lsn, CAST(epoch AS BIGINT) AS epoch FROM walk""")
def epoch_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.admit(_txns(spark, sf_dir), count=40)


def _txns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = samples.table(spark, sf_dir, "events")
    n = F.col("event_id")
    return e.select((n % 4).alias("table_id"), n.alias("end_lsn"), F.when(n % 97 == 0, 20_000).otherwise(n % 700).alias("mutations"), ((n % 13) * 1_000_000).alias("payload_bytes"), F.lit(64).cast("long").alias("descriptor_bytes"))


@query("SELECT event_id % 4 AS table_id, event_id // 1000 AS epoch, min(event_id) AS first_lsn, max(event_id) AS last_lsn, count(*) AS transactions, min(ts) AS oldest_commit, bool_and(user_id = 0) AS initial FROM events GROUP BY 1, 2")
def epoch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = samples.table(spark, sf_dir, "events")
    t = e.select((F.col("event_id") % 4).alias("table_id"), F.floor(F.col("event_id") / 1000).alias("epoch"), F.col("event_id").alias("end_lsn"), F.col("ts").alias("commit_ts"), F.col("user_id").alias("xid"))
    return ledger.epoch_summary(t)


@query("SELECT event_id % 4 AS table_id, greatest(1000000 - min(event_id), 0) AS lag_bytes, CAST(epoch(date_trunc('second', TIMESTAMP '2030-01-01')) - floor(epoch(min(ts))) AS BIGINT) AS lag_seconds FROM events WHERE event_id % 4 <> 2 OR event_id > 800 GROUP BY 1")
def table_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = samples.table(spark, sf_dir, "events").where("event_id % 4 <> 2 or event_id > 800")
    return ledger.lag(e.select((F.col("event_id") % 4).alias("table_id"), F.col("event_id").alias("begin_lsn"), F.col("ts").alias("commit_ts")), 1_000_000, F.lit("2030-01-01 00:00:00"))


@query("SELECT end_lsn, CASE WHEN bad THEN 'position order' ELSE 'replay differs' END AS fault FROM (SELECT event_id - event_id % 2 AS end_lsn, bool_or(event_id % 31 = 0) AS bad, count(DISTINCT user_id) > 1 AS d FROM events WHERE event_id % 31 = 0 OR event_id % 37 < 2 GROUP BY 1) WHERE bad OR d")
def ledger_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events are registered: some at the place of their pair whatever they hold, the others as replays that agree."""
    n = F.col("event_id")
    pair, marked = n - n % 2, (n % 31 == 0) | (n % 37 < 2)
    end = F.when(marked, pair).otherwise(2 * pair + 1)  # even ends and odd ones never meet
    rows = samples.table(spark, sf_dir, "events").select(F.when(marked, F.col("user_id")).otherwise(pair).alias("xid"), end.alias("end_lsn"), n.alias("table_id"))
    e = F.col("end_lsn")
    t = rows.select("xid", (e - 5).alias("begin_lsn"), F.when(F.col("table_id") % 31 == 0, F.col("table_id") + 9).otherwise(e - 1).alias("commit_lsn"), "end_lsn", "table_id")
    found = ledger.registration_faults(t)
    return found.groupBy("end_lsn").agg(F.min("fault").alias("fault"))


# -- maintenance ------------------------------------------------------------


@query(f"""WITH {FILES}, d AS (SELECT count(*) FILTER (level = 0) AS l0_files, count(*) FILTER (level > 0 AND size_bytes < 134217728) AS small_files, coalesce(sum(size_bytes) FILTER (level = 0), 0) AS l0_bytes, coalesce(max(age_ms) FILTER (level = 0), 0) AS oldest_l0_ms,
  max(delete_files) AS max_delete_files, count(*) FILTER (deleted_rows * 100 >= row_count * 30) AS dense_files, sum(size_bytes * deleted_rows // row_count) AS reclaimable_bytes FROM files)
SELECT CAST(l0_files AS BIGINT) AS l0_files, small_files, CAST(l0_bytes AS BIGINT) AS l0_bytes, oldest_l0_ms, max_delete_files, dense_files, CAST(reclaimable_bytes AS BIGINT) AS reclaimable_bytes,
  CASE WHEN l0_files >= 32 OR small_files >= 32 OR l0_bytes >= 268435456 OR oldest_l0_ms >= 30000 OR max_delete_files >= 16 THEN 'pause' WHEN l0_files >= 6 OR small_files >= 6 OR l0_bytes >= 134217728 OR oldest_l0_ms >= 10000 OR max_delete_files >= 8 OR dense_files > 0 THEN 'delay' ELSE 'healthy' END AS pressure FROM d""")
def debt_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.debt(samples.files(spark, sf_dir))


@query(f"""WITH {FILES},
t AS (SELECT count(*) FILTER (level = 0) AS l0, coalesce(sum(size_bytes) FILTER (level = 0), 0) AS bytes, coalesce(max(age_ms) FILTER (level = 0), 0) AS age, count(*) FILTER (level > 0 AND size_bytes < 134217728) AS small,
  max(delete_files) AS most, bool_or(row_count > 0 AND deleted_rows * 100 >= row_count * 30) AS any_dense FROM files),
m AS (SELECT f.*, row_count > 0 AND deleted_rows * 100 >= row_count * 30 AS dense, t.small >= 6 AND level > 0 AND size_bytes < 134217728 AS small, l0 >= 32 OR bytes >= 268435456 OR age >= 30000 AS flooded,
  l0 >= 32 OR bytes >= 268435456 OR age >= 30000 OR t.small >= 32 OR most >= 16 AS hard, l0 >= 6 OR bytes >= 134217728 OR age >= 10000 OR t.small >= 6 OR most >= 8 OR any_dense AS soft, most FROM files f, t),
c AS (SELECT * FROM m WHERE (hard OR age_ms >= 1000) AND CASE level WHEN 0 THEN soft OR hard OR dense WHEN 1 THEN TRUE ELSE dense OR small END)
SELECT path, dense, small, level, age_ms, CASE WHEN dense THEN 'deleted_rows' WHEN small THEN 'small_files' WHEN level = 0 AND (soft OR hard) THEN 'l0_debt' ELSE 'promotion' END AS reason,
  row_number() OVER (ORDER BY NOT (flooded AND level = 0), NOT dense, NOT small, CASE WHEN NOT flooded AND most >= 8 AND dense THEN -deleted_rows ELSE 0 END, level, age_ms DESC, path) AS place FROM c""")
def compaction_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planner's candidates in the order in which it takes them as seeds."""
    return compaction.ordered_candidates(samples.files(spark, sf_dir)).select("path", "dense", "small", "level", "age_ms", "reason", "place")


@query(f"WITH {FILES} SELECT path FROM files WHERE row_count > 0 AND deleted_rows * 100 >= row_count * 30")
def dense_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deletes.dense(samples.files(spark, sf_dir)).select("path")


@query()
def compaction_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group that the planner chooses: sequential, so tests hold it against cases."""
    found = compaction.plan(samples.files(spark, sf_dir))
    return spark.createDataFrame([(p, found.level, found.reason) for p in sorted(found.inputs)] if found else [], "path string, level int, reason string")


@query(f"WITH {FILES}, r AS (SELECT path, row_count, size_bytes, row_number() OVER (ORDER BY row_count, path) AS n, sum(row_count) OVER (ORDER BY row_count, path ROWS UNBOUNDED PRECEDING) AS s FROM files) SELECT path, row_count FROM r WHERE n <= 5 AND s <= 40000")
def consolidation_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.consolidation(samples.files(spark, sf_dir), files=5, size=1 << 50, rows=40_000).select("path", "row_count")


@query("""WITH d AS (SELECT l_suppkey % 9 AS target, l_suppkey AS path, count(*) AS row_count FROM lineitem GROUP BY l_suppkey),
r AS (SELECT *, row_number() OVER w AS n, sum(row_count) OVER (PARTITION BY target ORDER BY row_count, path ROWS UNBOUNDED PRECEDING) AS s, count(*) OVER (PARTITION BY target) AS c FROM d WINDOW w AS (PARTITION BY target ORDER BY row_count, path))
SELECT target, path, row_count FROM r WHERE c > 4 AND n <= c - 3 AND s <= 5000""")
def target_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = samples.table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 9).alias("target"), F.col("l_suppkey").alias("path")).agg(F.count("*").alias("row_count"))
    return compaction.target_merges(d, keep=4, rows=5000)


MOVES = "moves AS (SELECT DISTINCT l_suppkey % 5 AS old_path, l_orderkey * 8 + l_linenumber AS old_pos, (l_orderkey % 640) // 320 AS new_path, l_orderkey * 8 + l_linenumber - (l_orderkey % 7) AS new_pos FROM lineitem)"


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return samples.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("old_path"), place.alias("old_pos"), F.floor(F.col("l_orderkey") % 640 / 320).alias("new_path"), (place - F.col("l_orderkey") % 7).alias("new_pos")).distinct()


@query(f"""WITH {MOVES}, i AS (SELECT *, new_pos - old_pos AS shift, old_pos - row_number() OVER (PARTITION BY old_path, new_path ORDER BY old_pos) AS island FROM moves)
SELECT old_path, new_path, min(old_pos) AS old_start, min(new_pos) AS new_start, count(*) AS length FROM i GROUP BY old_path, new_path, shift, island""")
def remap_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.remap_runs(_moves(spark, sf_dir))


@query(f"WITH {MOVES} SELECT old_path, old_pos, new_path AS path, new_pos AS pos FROM moves WHERE old_pos % 3 = 0")
def remap_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old positions found in the runs by a range join."""
    moves = _moves(spark, sf_dir)
    return layout.translate(moves.where("old_pos % 3 = 0").select(F.col("old_path").alias("path"), F.col("old_pos").alias("pos")), layout.remap_runs(moves))


# -- reconciliation, history ------------------------------------------------

FOREIGN = "s AS (SELECT event_id AS id, event_id % 5 <> 0 AS linked, event_id % 11 = 0 AS sc, event_id % 13 = 0 AS pc, event_id % 3 = 0 AS svc, event_id % 2 = 0 AS known, CASE event_id % 4 WHEN 0 THEN 'append' ELSE 'replace' END AS op, event_id % 7 % 2 AS ad, event_id % 6 % 3 AS rd, event_id % 10 % 2 AS ax, event_id % 15 % 2 AS rx FROM events)"


@query(f"""WITH {FOREIGN} SELECT id, CASE WHEN NOT linked THEN 'pause_missing_history' WHEN sc OR pc THEN 'pause_schema_or_spec' WHEN svc AND known THEN 'service_operation' WHEN svc THEN 'pause_unknown_service'
 WHEN ad + rd = 0 AND ax + rx = 0 THEN 'metadata_only' WHEN ad + rd = 0 AND op = 'replace' THEN 'verify_delete_rewrite' WHEN ad + rd = 0 THEN 'pause_logical_mutation' WHEN op = 'replace' AND rd > 0 THEN 'reconcile_data_rewrite' ELSE 'pause_logical_mutation' END AS class FROM s""")
def classify_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    rows = samples.table(spark, sf_dir, "events").select(
        n.alias("id"), F.lit(1).alias("expected_parent"), F.when(n % 5 != 0, 1).alias("parent_id"), (n % 11 == 0).alias("schema_changed"), (n % 13 == 0).alias("spec_changed"), (n % 3 == 0).alias("is_service"), (n % 2 == 0).alias("known_service"),
        F.when(n % 4 == 0, "append").otherwise("replace").alias("operation"), (n % 7 % 2).alias("added_data"), (n % 6 % 3).alias("removed_data"), (n % 10 % 2).alias("added_deletes"), (n % 15 % 2).alias("removed_deletes"),
    )
    return reconcile.classify(rows).select("id", "class")


@query("SELECT count(*) FILTER (o_orderkey % 50 <> 0 AND o_orderkey % 70 <> 0 AND o_orderkey % 60 <> 0) AS matched, count(*) FILTER (o_orderkey % 50 = 0) AS missing, 1 AS extra, count(*) FILTER (o_orderkey % 60 = 0 AND o_orderkey % 50 <> 0 AND o_orderkey % 70 <> 0 OR o_orderkey % 70 = 0 AND o_orderkey % 50 <> 0) AS changed, 0 AS repeated FROM orders")
def reconcile_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rewrite that lost, changed and invented rows is told from a faithful one."""
    o = samples.orders(spark, sf_dir)
    mark = lambda df: df.withColumn("fingerprint", scalars.fingerprint(*[F.col(c) for c in COLUMNS]))
    k = F.col("o_orderkey")
    after = o.where(k % 50 != 0).withColumn("o_custkey", F.when((k % 60 == 0) | (k % 70 == 0), F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    extra = o.orderBy("o_orderkey").limit(1).withColumn("o_orderkey", F.lit(-1).cast("long"))  # one invented row
    found = reconcile.reconcile_keyed(mark(o), mark(after.unionByName(extra)), KEYS)
    return found.select("matched", "missing", F.col("extra").cast("int"), "changed", F.col("repeated").cast("int"))


@query("""WITH a AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), b AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_id % 19 <> 0 GROUP BY ALL)
SELECT CAST(sum(least(a.n, coalesce(b.n, 0))) AS BIGINT) AS matched, CAST(sum(greatest(a.n - coalesce(b.n, 0), 0)) AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra FROM a LEFT JOIN b USING (user_id, event_type)""")
def reconcile_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = samples.table(spark, sf_dir, "events").withColumn("fingerprint", scalars.fingerprint(F.col("user_id"), F.col("event_type")))
    return reconcile.reconcile_multiset(e, e.where("event_id % 19 <> 0"))


@query("""WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), a AS (SELECT * FROM r), b AS (SELECT user_id, event_id + 5 AS new_pos, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
SELECT a.user_id, a.event_id AS old_pos, b.new_pos FROM a JOIN b ON a.user_id = b.user_id AND a.n = b.n""")
def multiset_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal rows are paired in order of place."""
    e = samples.table(spark, sf_dir, "events").select(F.col("user_id").alias("fingerprint"), F.lit("f").alias("path"), F.col("event_id").alias("pos"))
    return reconcile.multiset_pairs(e, e.withColumn("pos", F.col("pos") + 5)).select(F.col("fingerprint").alias("user_id"), "old_pos", "new_pos")


@query(f"WITH {FILES} SELECT path, CASE WHEN sequence % 3 = 0 THEN 'removed' ELSE 'added' END AS change FROM files WHERE (sequence % 3 = 0) <> (sequence % 2 = 0)")
def file_set_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = samples.files(spark, sf_dir)
    return reconcile.file_set_changes(own.where("sequence % 3 = 0"), own.where("sequence % 2 = 0"))


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 3 = 0")
def resolve_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that updates left out are taken from the row before."""
    o = samples.orders(spark, sf_dir).select("o_orderkey", "o_custkey", "o_orderpriority")
    partial = o.where("o_orderkey % 3 = 0").withColumn("o_orderpriority", F.lit(None).cast("string")).withColumn("unresolved", F.array(F.lit("o_orderpriority")))
    return reconcile.resolve_unchanged(partial, o, KEYS, ["o_custkey", "o_orderpriority"])


def fates(events: DataFrame) -> DataFrame:
    n = F.col("event_id")
    s = events.select(n.alias("id"), (n - 1).alias("parent"), n.alias("sequence"), (n * 1000).alias("ts_ms"))
    top = s.agg(F.max("sequence")).first()[0]
    bases = s.sparkSession.createDataFrame([(top - 150,)], "id long")
    return retention.expiration(s, top * 1000, 500_000, 100, 700, bases).select("id", "fate")


@query("""WITH s AS (SELECT event_id AS id, event_id AS sequence, event_id * 1000 AS ts_ms, row_number() OVER (ORDER BY event_id DESC) AS r FROM events), n AS (SELECT count(*) AS c, max(ts_ms) AS now FROM s),
h AS (SELECT s.*, r <= 100 OR sequence >= (SELECT max(sequence) - 150 FROM s) AS held FROM s), f AS (SELECT h.*, row_number() OVER (PARTITION BY held ORDER BY sequence) AS o FROM h)
SELECT id, CASE WHEN held THEN 'protected' WHEN o <= c - 700 THEN 'forced' WHEN ts_ms >= now - 500000 THEN 'window' ELSE 'aged' END AS fate FROM f, n""")
def snapshot_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fate of a history of one snapshot an event."""
    return fates(samples.table(spark, sf_dir, "events"))


@query("SELECT event_id AS path FROM events WHERE event_id % 3 <> 0 AND event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id < 900")
def gc_unreferenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered files that no retained snapshot and no pending operation needs, beyond the grace."""
    e = samples.table(spark, sf_dir, "events").select(F.col("event_id").alias("path"))
    needed = retention.reachable(e.where("path % 3 = 0"), e.where("path % 5 = 0"))
    return retention.unreferenced(e.withColumn("unreferenced_since_ms", F.col("path") * 1000), needed, e.where("path % 7 = 0"), 1_000_000, 100_000).select("path")


# -- layout and sorting -----------------------------------------------------

OVERLAP = "o AS (SELECT a.path, any_value(a.row_count) AS row_count, count(*) AS files, CAST(sum(b.row_count) AS BIGINT) AS rows_met FROM files a JOIN files b ON b.lower <= a.upper AND b.upper >= a.lower GROUP BY a.path)"


@query(f"WITH {FILES}, {OVERLAP} SELECT * FROM o")
def layout_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.overlap(samples.files(spark, sf_dir))


@query(f"WITH {FILES} SELECT max(n) AS max_files FROM (SELECT count(*) AS n FROM files a JOIN files b ON b.lower <= a.lower AND b.upper >= a.lower GROUP BY a.path)")
def range_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.depth(samples.files(spark, sf_dir))


@query(f"""WITH {FILES}, {OVERLAP} SELECT count(*) AS data_files, CAST(sum(row_count) AS BIGINT) AS data_rows, count(*) FILTER (level = 0) AS l0_files, count(*) FILTER (level = 1) AS l1_files, count(*) FILTER (level = 2) AS l2_files, CAST(count(*) FILTER (sorted) AS BIGINT) AS sorted_files,
 (SELECT round(sum(row_count * files) / sum(row_count), 6) FROM o) AS mean_files, (SELECT round(sum(CAST(row_count AS DOUBLE) * rows_met) / pow(sum(row_count), 2), 6) FROM o) AS lookup_rows_ratio FROM files""")
def layout_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = layout.report(samples.files(spark, sf_dir))
    return r.select("data_files", "data_rows", "l0_files", "l1_files", "l2_files", "sorted_files", F.round("mean_files", 6).alias("mean_files"), F.round("lookup_rows_ratio", 6).alias("lookup_rows_ratio"))


@query("""WITH r AS (SELECT o_custkey % 16 AS file, o_orderkey AS pos, o_orderpriority AS a, o_custkey AS b, lag(o_orderpriority) OVER w AS pa, lag(o_custkey) OVER w AS pb, lag(o_orderkey) OVER w AS pk FROM orders WINDOW w AS (PARTITION BY o_custkey % 16 ORDER BY o_orderkey))
SELECT file, count(*) AS rows, CAST(count(*) FILTER (pk IS NOT NULL AND (pa < a OR (pa = a AND pb > b))) AS BIGINT) AS inversions FROM r GROUP BY file""")
def sort_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours in the wrong order of (priority descending, customer)."""
    o = samples.orders(spark, sf_dir).withColumn("file", F.col("o_custkey") % 16)
    return layout.inversions(o, layout.parse_sort("o_orderpriority desc, o_custkey"), "file", "o_orderkey")


@query("""WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS a FROM orders)
SELECT o_orderkey, row_number() OVER (ORDER BY a DESC NULLS LAST, o_orderkey) AS place FROM x""")
def sort_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls come last in a descending order, as the field says.  Places within key ranges, offset by the ranges before."""
    x = samples.orders(spark, sf_dir).select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey")).alias("a"))
    ordered = x.orderBy(*layout.sort_columns(layout.parse_sort("a desc nulls last, o_orderkey")))
    placed = ordered.select("o_orderkey", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"))
    from pyspark.sql import Window

    from sluice.plans.storage import persist

    placed = persist(placed, "sorted")
    parts = placed.groupBy("p").agg(F.count("*").alias("n"), F.min("i").alias("low"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = F.broadcast(parts.select("p", "low", before.alias("before")))  # one row a partition
    return placed.join(parts, "p").select("o_orderkey", (F.col("i") - F.col("low") + F.col("before") + 1).alias("place"))


@query(f"WITH {FILES}, c AS (SELECT *, lag(upper) OVER (ORDER BY lower, upper, path) AS p FROM files) SELECT NOT bool_or(NOT sorted OR coalesce(p >= lower, false)) AS key_order FROM c")
def key_order_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.disjoint_in_order(samples.files(spark, sf_dir))


# -- scheduling -------------------------------------------------------------


@query("""WITH r AS (SELECT user_id AS table_id, event_id AS seen, event_id * 37 % 901 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS age FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY ms, seen) AS i, count(*) OVER (PARTITION BY table_id) AS n FROM r WHERE age <= 32)
SELECT table_id, ms AS estimate_ms FROM k WHERE i = (n * 95 + 99) // 100""")
def service_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = samples.table(spark, sf_dir, "events").select(F.col("user_id").alias("table_id"), F.col("event_id").alias("at"), (F.col("event_id") * 37 % 901).alias("ms"))
    return scheduling.service_estimate(e)


@query("""WITH p AS (SELECT event_id AS table_id, CASE event_id % 3 WHEN 0 THEN 'realtime' WHEN 1 THEN 'balanced' ELSE 'efficient' END AS priority, event_id * 10 AS first_ms, event_id % 700 AS age, CASE WHEN event_id % 8 <> 0 THEN event_id END AS n, CASE WHEN event_id % 2 = 0 THEN event_id % 1000 ELSE 300 END AS est FROM events),
w AS (SELECT *, greatest(greatest((CASE priority WHEN 'realtime' THEN 900 WHEN 'balanced' THEN 3000 ELSE 15000 END) - est, 0) - age, 0) AS d FROM p)
SELECT table_id, first_ms + CASE WHEN n IS NULL OR n >= 5000 THEN 0 WHEN priority = 'realtime' THEN least(d, 400) ELSE d END AS ready_at FROM w""")
def schedule_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    e = samples.table(spark, sf_dir, "events")
    pending = e.select(n.alias("table_id"), F.when(n % 3 == 0, "realtime").when(n % 3 == 1, "balanced").otherwise("efficient").alias("priority"), (n * 10).alias("first_ms"), (n % 700).alias("source_age_ms"), F.when(n % 8 != 0, n).alias("rows"), F.lit(0).alias("bytes"))
    return scheduling.due(pending, e.where("event_id % 2 = 0").select(n.alias("table_id"), (n % 1000).alias("estimate_ms")), max_rows=5000).select("table_id", "ready_at")


@query("SELECT event_id AS table_id FROM events ORDER BY event_id * 7919 % 1009, event_id % 3, event_id LIMIT 1")
def schedule_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    e = samples.table(spark, sf_dir, "events").select(n.alias("table_id"), (n * 7919 % 1009).alias("ready_at"), F.when(n % 3 == 0, "realtime").when(n % 3 == 1, "balanced").otherwise("efficient").alias("priority"))
    return scheduling.next_table(e).select("table_id")


# -- scalar functions -------------------------------------------------------


@query("SELECT event_id, printf('%X/%X', (event_id * 7777777) >> 32, (event_id * 7777777) & 4294967295) AS lsn, event_id * 7777777 AS value FROM events")
def lsn_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = samples.table(spark, sf_dir, "events").select("event_id", scalars.lsn_text(F.col("event_id") * 7777777).alias("lsn"))
    return e.withColumn("value", scalars.lsn_value(F.col("lsn")))


@query("""WITH m AS (SELECT event_id, CAST((event_id % 45) * 65536 + event_id % 40 + 4 - CASE WHEN event_id % 10 = 0 THEN 9 ELSE 0 END AS BIGINT) AS m FROM events), x AS (SELECT event_id, m, ((m - 4) >> 16) & 65535 AS p, xor((m - 4) & 2047, 1024) - 1024 AS s FROM m)
SELECT event_id, CASE WHEN m >= 4 AND p BETWEEN 1 AND 38 AND s >= 0 AND s <= p THEN 'decimal(' || p || ',' || s || ')' ELSE 'string' END AS type FROM x""")
def typmod_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    m = ((n % 45) * 65536 + n % 40 + 4 - F.when(n % 10 == 0, 9).otherwise(0)).cast("int")
    return samples.table(spark, sf_dir, "events").select("event_id", scalars.numeric_type(m).alias("type"))


@query("WITH m AS (SELECT event_id, (event_id * 8640000013) % 86400000001 AS m FROM events) SELECT event_id, printf('%02d:%02d:%02d.%06d', m // 3600000000, m // 60000000 % 60, m // 1000000 % 60, m % 1000000) AS time FROM m")
def time_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.table(spark, sf_dir, "events").select("event_id", scalars.time_text(F.col("event_id") * 8640000013 % 86400000001).alias("time"))


@query("SELECT o_orderkey, strftime(DATE '1970-01-01' + CAST(o_orderkey * 53 % 800000 - 300000 AS INT), '%Y-%m-%d') AS day FROM orders")
def date_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.orders(spark, sf_dir).select("o_orderkey", scalars.date_text(F.col("o_orderkey") * 53 % 800000 - 300000).alias("day"))


@query("WITH t AS (SELECT o_orderkey, printf('%s%d.%02d0', CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE '' END, o_orderkey % 5, o_custkey % 100 - o_custkey % 100 % 10) AS t FROM orders), r AS (SELECT o_orderkey, rtrim(rtrim(t, '0'), '.') AS t FROM t) SELECT o_orderkey, CASE WHEN t = '-0' THEN '0' ELSE t END AS number FROM r")
def numeric_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 100
    text = F.format_string("%s%d.%02d0", F.when(k % 2 == 0, "-").otherwise(""), k % 5, c - c % 10)
    return samples.orders(spark, sf_dir).select("o_orderkey", scalars.numeric_text(text).alias("number"))


@query("SELECT vec_id, '[' || array_to_string([CAST(CAST(floor(CAST(x AS DOUBLE) * 1000) AS BIGINT) AS VARCHAR) || '.0' FOR x IN embedding], ',') || ']' AS vector FROM embeddings")
def vector_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as JSON, of whole thousandths, whose text SQL can print."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("float"))
    return samples.table(spark, sf_dir, "embeddings").select("vec_id", scalars.vector_json(whole).alias("vector"))


@query("SELECT o_custkey, '[' || string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) || ',null]' AS items FROM orders GROUP BY o_custkey")
def array_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = samples.orders(spark, sf_dir).groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("a"))
    return lists.select("o_custkey", scalars.array_json(F.concat("a", F.array(F.lit(None).cast("long"))), "long").alias("items"))


@query("""SELECT event_id, replace(props, ' ', '') AS props, '{"a":[1,null,{"x":' || user_id || '}],"b":' || event_id || '}' AS mixed FROM events""")
def json_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON without white space, keys in order, the last of repeated keys."""
    e, mixed = samples.table(spark, sf_dir, "events"), F.format_string('{ "b" : 7, "a" :[1,\n null , {"x" : %d} ] ,"b":%d}', F.col("user_id"), F.col("event_id"))
    return e.select("event_id", texts.json_normalize("props").alias("props"), texts.json_normalize(mixed).alias("mixed"))


@query("""WITH c AS (SELECT *, CASE WHEN o_orderkey % 17 = 0 THEN 'o_custkey' WHEN o_orderkey % 13 = 0 THEN 'day' WHEN o_orderkey % 11 = 0 THEN 'zoned' END AS fault FROM orders)
SELECT o_orderkey, fault, CASE WHEN fault IS NULL THEN o_custkey END AS o_custkey, CASE WHEN fault IS NULL THEN CAST(o_orderdate AS DATE) END AS day, CASE WHEN fault IS NULL THEN epoch_us(o_orderdate) END AS plain_micros,
  CASE WHEN fault IS NULL THEN epoch_us(o_orderdate) - 5400000000 END AS zoned_micros, CASE WHEN fault IS NULL THEN o_custkey % 2 = 0 END AS flag, CASE WHEN fault IS NULL THEN CAST(o_custkey AS DOUBLE) / 4 END AS amount FROM c""")
def text_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a text log as values; rows with a cell that can't be decoded name it and keep no other."""
    o, n = samples.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    log = o.select(
        "o_orderkey", F.when(n % 17 == 0, "12x").otherwise(F.col("o_custkey").cast("string")).alias("o_custkey"), F.when(n % 13 == 0, "2023-02-29").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"), stamp.alias("plain"),
        F.when(n % 11 == 0, "infinity").otherwise(F.concat(stamp, F.lit("+01:30"))).alias("zoned"), F.when(F.col("o_custkey") % 2 == 0, "t").otherwise("f").alias("flag"), (F.col("o_custkey").cast("decimal(12,3)") / 4).cast("decimal(12,3)").cast("string").alias("amount"),
    )
    done = decode.decode(log, {"o_custkey": "int8", "day": "date", "plain": "timestamp", "zoned": "timestamptz", "flag": "bool", "amount": "numeric(12,3)"})
    plain = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', plain)")
    return done.select("o_orderkey", "fault", "o_custkey", "day", plain.alias("plain_micros"), F.unix_micros("zoned").alias("zoned_micros"), "flag", F.col("amount").cast("double").alias("amount"))


@query("SELECT printf('%08x-%04x-%04x-%04x-%012x', o_orderkey, o_custkey % 65536, o_custkey % 4096, o_orderkey % 65536, o_orderkey * 3) AS uuid FROM orders")
def uuid_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = F.format_string("%08X-%04X-%04X-%04X-%012X", k, c % 65536, c % 4096, k % 65536, k * 3)
    return samples.orders(spark, sf_dir).select(scalars.uuid_text(text).alias("uuid"))


@query("SELECT o_orderkey, '1|' || length(CAST(o_orderkey AS VARCHAR)) || ':' || o_orderkey || length(o_orderstatus) || ':' || o_orderstatus AS key FROM orders")
def key_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.orders(spark, sf_dir).select("o_orderkey", scalars.key_text(F.col("o_orderkey"), F.col("o_orderstatus")).alias("key"))


@query("SELECT count(*) AS n, count(*) AS equal_with_nulls, 0 AS equal_after_change FROM orders")
def fingerprint_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended null columns keep a row's fingerprint; a changed value doesn't."""
    o = samples.orders(spark, sf_dir)
    a, none = [F.col(c) for c in COLUMNS], F.lit(None).cast("string")
    same = scalars.fingerprint(*a) == scalars.fingerprint(*a, none, none)
    other = scalars.fingerprint(*a) == scalars.fingerprint(a[0] + 1, *a[1:])
    return o.agg(F.count("*").alias("n"), F.sum(same.cast("long")).alias("equal_with_nulls"), F.sum(other.cast("int")).cast("int").alias("equal_after_change"))


@query("SELECT event_id, CASE WHEN x > 17179869184 + event_id * 10 THEN x - 4294967296 ELSE x END AS xid FROM (SELECT event_id, 17179869184 + event_id * 20 AS x FROM events)")
def xid_widening(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return samples.table(spark, sf_dir, "events").select("event_id", scalars.widened_xid(n * 20, F.lit(17179869184).cast("long") + n * 10).alias("xid"))


@query("SELECT event_id, CASE WHEN event_id % 4 < 3 THEN CAST(event_id % 4 AS INT) WHEN event_id % 8 = 3 THEN 2 WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS level FROM events")
def file_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    path = F.when(n % 4 < 3, F.format_string("t/data/sluice-l%d-x-data-%06d.parquet", n % 4, n)).otherwise("t/data/other.parquet")
    return samples.table(spark, sf_dir, "events").select("event_id", scalars.file_level(path, F.when(n % 8 == 3, "L2"), F.when(n % 3 == 0, "ingest").otherwise("replace")).alias("level"))


@query("""WITH w AS (SELECT event_id, event_id * 100 AS r, event_id * 37 % 100000 AS j, CASE WHEN event_id % 3 <> 0 THEN event_id * 11 % 50000 END AS s, event_id % 101 = 0 AS lost FROM events)
SELECT event_id, CASE WHEN lost THEN 'slot_lost' WHEN r >= 600000 OR j >= 90000 OR coalesce(s = 0 OR s * 10 <= r + s, false) THEN 'at_risk' WHEN r >= 300000 OR j >= 72000 OR coalesce(s * 4 <= r + s, false) THEN 'warning' ELSE 'healthy' END AS health FROM w""")
def wal_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return samples.table(spark, sf_dir, "events").select("event_id", scalars.log_health(n * 100, n * 37 % 100000, F.when(n % 3 != 0, n * 11 % 50000), n % 101 == 0, 300_000, 600_000, 90_000).alias("health"))


@query("SELECT count(DISTINCT event_id // 100) AS epochs, count(DISTINCT event_id // 100) AS ids FROM events")
def epoch_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch ids are equal for equal ranges and different for different ones."""
    n = F.floor(F.col("event_id") / 100)
    return samples.table(spark, sf_dir, "events").select(n.alias("e"), scalars.epoch_id(F.lit("s"), F.lit(1), n, n + 1).alias("id")).agg(F.countDistinct("e").alias("epochs"), F.countDistinct("id").alias("ids"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'o_custkey' WHEN o_orderkey % 4 = 0 THEN 'o_totalprice' END AS fault FROM orders")
def row_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first column of a row that breaks the specification: a null where none may be, a number beyond its type."""
    from pyspark.sql import types as T

    k = F.col("o_orderkey")
    rows = samples.orders(spark, sf_dir).select("o_orderkey", F.when(k % 6 != 0, F.col("o_custkey")).alias("o_custkey"), F.when(k % 4 == 0, "123456789.5").otherwise("1.5").alias("o_totalprice"))
    spec = schema.TableSpec("t", (schema.ColumnSpec(1, "o_orderkey", T.LongType(), False), schema.ColumnSpec(2, "o_custkey", T.LongType(), False), schema.ColumnSpec(3, "o_totalprice", T.DecimalType(6, 2))), ("o_orderkey",))
    return rows.select("o_orderkey", schema.violations(rows, spec).alias("fault"))


# -- streaming --------------------------------------------------------------


@query(f"WITH {STATE} SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM state")
def stream_cdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order log as files of a stream, published by micro-batches into a table; a restart applies nothing twice."""
    root = f"{workspace(spark)}/stream-{uuid.uuid4().hex}"
    log = samples.order_log(spark, sf_dir)
    for n, part in enumerate(itertools.pairwise((0, 2_000_000_000, 3_000_000_000, 1 << 60))):
        log.where((F.col("end_lsn") >= part[0]) & (F.col("end_lsn") < part[1])).coalesce(1).write.mode("append").parquet(f"{root}/log")
        _ = n
    table = orders_table(spark, sf_dir, epochs=0)
    for _ in range(2):
        stream = change_sources.read_stream(spark, f"{root}/log", log.schema, 1)
        ingest.ingest(stream, {"orders": table}, lambda batch, _: batch, "sample", f"{root}/checkpoint").awaitTermination()
    return table.read()


@query(f"WITH {STATE} SELECT * FROM state")
def blocked_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table is held back while three batches of its changes arrive; afterwards it has them all, in order."""
    root = f"{workspace(spark)}/blocked-{uuid.uuid4().hex}"
    log = samples.order_log(spark, sf_dir)
    for low, high in itertools.pairwise((0, 2_000_000_000, 3_000_000_000, 1 << 60)):
        log.where((F.col("end_lsn") >= low) & (F.col("end_lsn") < high)).coalesce(1).write.mode("append").parquet(f"{root}/log")
    table, control = orders_table(spark, sf_dir, epochs=0), ingest.Control(spark, f"{root}/control")
    stream = change_sources.read_stream(spark, f"{root}/log", log.schema, 1)
    ingest.ingest(stream, {"orders": table}, lambda batch, _: batch, "sample", f"{root}/checkpoint", control, lambda _: "pause").awaitTermination()
    if len(control.waiting("orders")) != 3 or control.blocked() != {"orders": "maintenance_pressure"} or not ingest.catch_up("orders", table, control, "sample"):
        raise RuntimeError("changes of a blocked table must wait and be published afterwards")
    return table.read()


@query(f"WITH {KEPT} SELECT count(*) AS changes, count(DISTINCT k.xid) AS transactions, max(e.last + 4) AS last_lsn FROM kept k JOIN ends e ON k.xid = e.xid WHERE k.xid % 9 <> 0")
def stream_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replication stream in files that cut through transactions, journaled as complete transactions."""
    root = f"{workspace(spark)}/journal-{uuid.uuid4().hex}"
    stream = samples.replication(spark, sf_dir)
    last = stream.agg(F.max("position")).first()[0]
    for low, high in itertools.pairwise((-1, last // 2, last)):
        stream.where((F.col("position") > low) & (F.col("position") <= high)).coalesce(1).write.mode("append").parquet(f"{root}/in")
    journal = change_sources.Journal(spark, f"{root}/journal")
    source = change_sources.read_stream(spark, f"{root}/in", stream.schema, 1)
    ingest.journal_stream(source, f"{root}/raw", journal, f"{root}/checkpoint").awaitTermination()
    return journal.after(0).agg(F.count("*").alias("changes"), F.countDistinct("xid").alias("transactions"), F.max("end_lsn").alias("last_lsn"))


# -- reading ----------------------------------------------------------------


@query(f"WITH {STATE} SELECT c_mktsegment, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM state JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def read_plane_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A published table is an ordinary DataFrame: joined and grouped."""
    c = samples.table(spark, sf_dir, "customer").hint("merge")  # Spark would send millions of customers to all for the size of their file
    rows = orders_table(spark, sf_dir).read().join(c, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum(money("o_totalprice")).cast("decimal(38,2)").alias("total"))


@functools.cache
def names() -> tuple[str, ...]:
    return tuple(QUERIES)
