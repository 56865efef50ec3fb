"""Continuous ingestion: micro-batches of changes become epochs, each published once.

A table that can't take its changes is blocked; the others go on.  Its changes wait
in the control folder, batch by batch, and are published first, in order, once the
block is over, so nothing is lost and nothing overtakes.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sluice.operators.assembly import assemble
from sluice.plans.publish import publish
from sluice.plans.storage import ConflictError
from sluice.plans.table import Table
from sluice.sources.changes import Journal

#: Codes of blocks.  Those of ``RESYNC`` only a new copy of the table lifts.
CODES = (
    "source_schema_incompatible", "publication_changed", "external_mutation", "publication_replan", "maintenance_pressure", "catalog_unavailable", "catalog_auth", "catalog_conflict",
    "target_not_found", "publication_transport", "publication_http", "storage_unavailable", "storage_permission_denied", "storage_not_found", "storage_rate_limited", "storage_conflict",
)
RESYNC = ("source_schema_incompatible", "publication_changed")
#: What tells a code: words of an error, in order.
SIGNS = (
    ("external_mutation", ("presence conflict",)),
    ("source_schema_incompatible", ("truncate", "schema", "unresolved_column", "append_only", "cast_invalid")),
    ("storage_permission_denied", ("permission", "access denied", "accesscontrol")),
    ("storage_rate_limited", ("slowdown", "slow down", "rate limit", "too many requests")),
    ("storage_not_found", ("filenotfound", "no such file", "path_not_found", "does not exist")),
    ("publication_transport", ("connection", "timed out", "timeout", "reset by peer")),
)


class Blocked(RuntimeError):
    """A table can't take a change; others go on."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(detail or code)
        self.code = code


def code_of(error: Exception) -> str:
    """The block code of an error; its text may hold values and isn't kept."""
    if isinstance(error, Blocked):
        return error.code
    if isinstance(error, ConflictError):
        return "catalog_conflict"
    text = f"{type(error).__name__} {error}".lower()
    return next((code for code, words in SIGNS if any(w in text for w in words)), "storage_unavailable")


class Control:
    """What ingestion has to remember besides the tables: the source, blocks with their retries, and changes that wait."""

    def __init__(self, spark: SparkSession, root: str, first_ms: int = 1000, longest_ms: int = 300_000):
        self.spark, self.root = spark, root.rstrip("/")
        self.store = Table(spark, root).store
        self.first_ms, self.longest_ms = first_ms, longest_ms

    def bind(self, source: str) -> None:
        """Remember the source; another one raises, since its positions mean something else."""
        if not self.store.exists("source.json"):
            self.store.create("source.json", {"source": source})
        elif (known := self.store.read("source.json")["source"]) != source:
            raise ValueError(f"this control folder belongs to source {known}, not {source}")

    def blocks(self) -> dict[str, dict]:
        """The blocks of all tables: code, attempts, blocked_at_ms, retry_at_ms."""
        state: dict[str, dict] = {}
        names = [n for n in self.store.list("blocks") if n.endswith(".json")]
        for x in sorted((self.store.read(f"blocks/{n}") for n in names), key=lambda x: x["at"]):
            state[x["table"]] = x
        return {t: x for t, x in state.items() if x["code"]}

    def blocked(self) -> dict[str, str]:
        return {t: x["code"] for t, x in self.blocks().items()}

    def record(self, table: str, code: str, now_ms: int | None = None) -> None:
        """Block a table, or again: a block keeps its first time and, if only a new copy lifts it, its code; retries back off."""
        if code not in CODES:
            raise ValueError(f"unknown block code {code!r}")
        now, before = now_ms or int(time.time() * 1000), self.blocks().get(table)
        attempts = before["attempts"] + 1 if before else 1
        kept = before["code"] if before and before["code"] in RESYNC and code != "publication_changed" else code
        retry = now + min(self.longest_ms, self.first_ms * 2 ** min(attempts - 1, 30))
        self._add({"table": table, "code": kept, "attempts": attempts, "blocked_at_ms": before["blocked_at_ms"] if before else now, "retry_at_ms": retry})

    def lift(self, table: str, copied: bool = False) -> None:
        """End a block; one that needs a new copy only if there is one, and then what waits is older than the copy and goes."""
        before = self.blocks().get(table)
        if before and before["code"] in RESYNC and not copied:
            raise ValueError(f"{table} needs a new copy")
        if copied:
            self.store.delete(f"waiting/{table}")
        if before:
            self._add({"table": table, "code": "", "attempts": 0, "blocked_at_ms": 0, "retry_at_ms": 0})

    def _add(self, block: dict) -> None:
        n = len(self.store.list("blocks"))
        self.store.create(f"blocks/{n:08d}.json", {"at": n, **block})

    def keep(self, table: str, number: int, changes: DataFrame) -> None:
        """Let a batch of changes wait; the same batch again takes its own place."""
        changes.write.mode("overwrite").parquet(f"{self.root}/waiting/{table}/{number:020d}")

    def waiting(self, table: str) -> list[int]:
        return [int(n) for n in self.store.list(f"waiting/{table}") if n.isdigit()]

    def waited(self, table: str, number: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/waiting/{table}/{number:020d}")

    def drop(self, table: str, number: int) -> None:
        self.store.delete(f"waiting/{table}/{number:020d}")


def attempted(work: Callable[[], object], attempts: int, pause_ms: int) -> None:
    """Run ``work``; faults that may pass are tried again, with growing pauses."""
    for k in range(attempts):
        try:
            work()
            return
        except Exception as e:
            if k == attempts - 1 or code_of(e) in RESYNC:
                raise
            time.sleep(pause_ms * 2**k / 1000)


def catch_up(name: str, table: Table, control: Control, source: str, attempts: int = 3, pause_ms: int = 50) -> bool:
    """Publish what waits for a table, oldest first; whether nothing waits any more."""
    for number in control.waiting(name):
        changes = control.waited(name, number)
        try:
            attempted(lambda changes=changes, number=number: publish(table, changes, f"{source}/{name}/{number}"), attempts, pause_ms)
        except Exception as e:
            control.record(name, code_of(e))
            return False
        control.drop(name, number)
    if name in control.blocked():
        control.lift(name)
    return True


def ingest(
    stream: DataFrame, tables: dict[str, Table], route: Callable[[DataFrame, str], DataFrame], source: str, checkpoint: str, control: Control | None = None, pressure: Callable[[str], str] | None = None, attempts: int = 3, pause_ms: int = 50, delay_ms: int = 250, **trigger
) -> StreamingQuery:
    """Publish a stream of changes into tables.

    ``route`` takes a table's own changes from a batch.  An epoch is named after source, table and batch, so a batch that
    runs again after a crash finds what it had published.  Faults that may pass are tried again; a table whose changes
    still fail is blocked with a code, and its changes wait in ``control`` while the rest of the batch goes on.  A block that
    only a new copy lifts stays until :meth:`Control.lift`; others are tried again when their pause is over.  ``pressure``
    names a table's debt of maintenance: ``delay`` slows it down, ``pause`` lets its changes wait.
    """
    if control is not None:
        control.bind(source)

    def one(name: str, table: Table, changes: DataFrame, number: int) -> None:
        if control is None:
            attempted(lambda: publish(table, changes, f"{source}/{name}/{number}"), attempts, pause_ms)
            return
        block = control.blocks().get(name)
        held = block is not None and (block["code"] in RESYNC or block["retry_at_ms"] > time.time() * 1000)
        debt = pressure(name) if pressure else "healthy"
        if debt == "delay":
            time.sleep(delay_ms / 1000)
        if debt == "pause" and block is None:
            control.record(name, "maintenance_pressure")
        if held or debt == "pause" or not catch_up(name, table, control, source, attempts, pause_ms):
            control.keep(name, number, changes)
            return
        try:
            attempted(lambda: publish(table, changes, f"{source}/{name}/{number}"), attempts, pause_ms)
        except Exception as e:
            control.keep(name, number, changes)  # first the changes, then the block
            control.record(name, code_of(e))

    def publish_batch(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for name, table in tables.items():
                one(name, table, route(batch, name), number)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(publish_batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def journal_stream(stream: DataFrame, waiting: str, journal: Journal, checkpoint: str, **trigger) -> StreamingQuery:
    """Journal the transactions of a replication stream once they are complete.

    Rows of transactions that haven't ended wait in ``waiting``, one folder a batch, and join the next one, so a
    transaction may span any number of batches.  A batch that runs again starts from the same folder and journals nothing
    twice; only the folder before the last is kept.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark, store = batch.sparkSession, journal.store
        before = f"{waiting}/{number - 1}"
        seen = batch.unionByName(spark.read.schema(batch.schema).parquet(before)) if number and store.exists(before) else batch
        seen = seen.persist()
        try:
            committed = seen.where("kind = 'commit'").select("xid").distinct()
            journal.append(assemble(seen.join(committed, "xid", "left_semi")))
            ended = committed.union(seen.where("kind = 'abort' and subxid = xid").select("xid")).distinct()
            seen.join(ended, "xid", "left_anti").write.mode("overwrite").parquet(f"{waiting}/{number}")
            store.delete(f"{waiting}/{number - 2}")
        finally:
            seen.unpersist()

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def status(tables: dict[str, Table], control: Control | None = None, now_ms: int | None = None) -> DataFrame:
    """(table_name, snapshot, operation, epoch_id, files, delete_files, rows, deleted_rows, behind_ms, waiting, blocked, attempts) of each table.

    ``behind_ms`` counts from the last commit; ``waiting`` are batches that a block holds back.
    """
    spark = next(iter(tables.values())).spark
    blocks = control.blocks() if control else {}
    now, rows = now_ms or int(time.time() * 1000), []
    for name, t in tables.items():
        s = t.snapshot()
        data, lost = [f for f in t.files(s) if f.kind == "data"], [f for f in t.files(s) if f.kind != "data"]
        block = blocks.get(name, {"code": None, "attempts": 0})
        rows.append((name, s.id, s.operation, s.summary.get("epoch_id"), len(data), len({f.path for f in lost}), sum(f.record_count for f in data), sum(f.record_count for f in lost), now - s.timestamp_ms, len(control.waiting(name)) if control else 0, block["code"], block["attempts"]))
    return spark.createDataFrame(rows, "table_name string, snapshot long, operation string, epoch_id string, files long, delete_files long, rows long, deleted_rows long, behind_ms long, waiting long, blocked string, attempts long")
