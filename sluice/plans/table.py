"""The table format: immutable snapshots over Parquet data, position deletes and deletion vectors.

A table is a folder: ``metadata/v<n>.json`` has snapshot ``n``; ``manifests/`` has
file entries as Parquet; ``data/`` and ``deletes/`` have the files.  A snapshot
names the manifests whose entries make it up; entries say whether a file was added
or removed.  Committing creates ``v<n+1>.json``, which only one writer can.

File entries are read as a DataFrame, never collected: planning, applicability of
deletes and scans are joins over them.
"""

from __future__ import annotations

import bisect
import hashlib
import time
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.operators.deletes import effective_positions
from sluice.plans.schema import TableSpec, check_successor, project
from sluice.plans.storage import ConflictError, Store

ENTRY = (
    "status string, kind string, path string, target string, lower_path string, upper_path string, sequence long, record_count long, "
    "size_bytes long, level int, first_row_id long, key_lower string, key_upper string, sorted boolean, added_ms long, touched array<string>"
)
#: Files whose statistics the driver reads from their footers; more are read by a job.
FOOTERS = 1000
#: Key types whose footer statistics are the values themselves.
PLAIN_KEYS = (T.IntegerType, T.LongType, T.StringType)
#: The most deleted positions, of about 200 bytes with their paths, that a scan sends to all executors.
BROADCAST_POSITIONS = 100_000
META = ("_version", "_lsn", "_row_id", "_changed_at")


@dataclass(frozen=True)
class Snapshot:
    id: int
    parent: int | None
    operation: str
    timestamp_ms: int
    manifests: tuple[str, ...]
    spec: TableSpec
    summary: dict
    next_row_id: int

    def to_json(self) -> dict:
        return self.__dict__ | {"manifests": list(self.manifests), "spec": self.spec.to_json()}

    @classmethod
    def from_json(cls, x: dict) -> Snapshot:
        return cls(**x | {"manifests": tuple(x["manifests"]), "spec": TableSpec.from_json(x["spec"])})


class Table:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.store = Store(spark, self.root)
        # Snapshots never change, so what is known of one stays right.
        self._files: dict[int, list[Row]] = {}

    # -- snapshots ---------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, root: str, spec: TableSpec) -> Table:
        table = cls(spark, root)
        table.store.create("metadata/v0.json", Snapshot(0, None, "create", int(time.time() * 1000), (), spec, {}, 0).to_json())
        return table

    def snapshot_ids(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self.store.list("metadata") if n.startswith("v") and n.endswith(".json"))

    def snapshot(self, id: int | None = None) -> Snapshot:
        return Snapshot.from_json(self.store.read(f"metadata/v{self.snapshot_ids()[-1] if id is None else id}.json"))

    @property
    def spec(self) -> TableSpec:
        return self.snapshot().spec

    def ancestry(self, id: int | None = None, keep: int | None = None) -> list[int]:
        """A snapshot and its ancestors, newest first, at most ``keep``."""
        found, at = [], self.snapshot(id)
        while keep is None or len(found) < keep:
            found.append(at.id)
            if at.parent is None:
                break
            at = self.snapshot(at.parent)
        return found

    def expire(self, ids: list[int]) -> list[str]:
        """Forget snapshots other than the newest; returns manifests that no other snapshot names."""
        newest = self.snapshot_ids()[-1]
        gone = [self.snapshot(i) for i in sorted(set(ids)) if i != newest]
        for s in gone:
            self.store.delete(f"metadata/v{s.id}.json")
        kept = {m for i in self.snapshot_ids() for m in self.snapshot(i).manifests}
        return sorted({m for s in gone for m in s.manifests} - kept)

    def unreachable(self, grace_ms: int = 0, now_ms: int | None = None) -> DataFrame:
        """(path) of data and delete files below the table's folder that no retained snapshot needs and that are older than the grace."""
        there = [f"{self.root}/{folder}" for folder in ("data", "deletes") if self.store.exists(folder)]
        if not there:
            return self.spark.createDataFrame([], "path string")
        before = F.timestamp_millis(F.lit((now_ms or int(time.time() * 1000)) - grace_ms))
        every = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(there).where(F.col("modificationTime") <= before).select("path")
        plain = lambda c: F.regexp_replace(c, "^file:/+", "/").alias("_p")
        # What a prepared commit added is needed as if it were a snapshot already.
        states = [(f"v{i}", m) for i in self.snapshot_ids() for m in self.snapshot(i).manifests]
        states += [(n, m) for n in self.store.list("prepared") for m in self.store.read(f"prepared/{n}")["manifests"]]
        if not states:
            return every
        read = self.spark.read.schema(ENTRY).parquet(*[f"{self.root}/{m}" for m in sorted({m for _, m in states})])
        named = read.select("status", "kind", plain("path"), F.regexp_extract("_metadata.file_path", "(manifests/[0-9a-f]+)/[^/]*$", 1).alias("manifest"))
        held = named.join(self.spark.createDataFrame(states, "state string, manifest string"), "manifest")
        needed = held.groupBy("state", "kind", "_p").agg(F.max(F.col("status") == "removed").alias("gone")).where("not gone").select("_p").distinct()
        return every.select("path", plain("path")).join(needed, "_p", "left_anti").select("path")

    def collect_garbage(self, grace_ms: int = 24 * 3_600_000, now_ms: int | None = None) -> list[str]:
        """Delete what :meth:`unreachable` names; the grace keeps files of commits in flight."""
        gone = []
        for r in self.unreachable(grace_ms, now_ms).toLocalIterator():
            self.store.delete(r.path)
            gone.append(r.path)
        return gone

    def history(self) -> DataFrame:
        """(id, parent, sequence, ts_ms, operation, epoch_id) of all snapshots."""
        rows = [(s.id, s.parent, s.id, s.timestamp_ms, s.operation, s.summary.get("epoch_id")) for s in map(self.snapshot, self.snapshot_ids())]
        return self.spark.createDataFrame(rows, "id long, parent long, sequence long, ts_ms long, operation string, epoch_id string")

    def _epoch(self, epoch_id: str) -> str:
        return f"epochs/{hashlib.sha256(epoch_id.encode()).hexdigest()}.json"

    def committed_epoch(self, epoch_id: str) -> Snapshot | None:
        """The snapshot that published an epoch, if any: the answer to a lost commit response, without a look at the history.

        Each attempt notes the snapshot it is going to be; whether it became that one, the snapshot itself tells.
        """
        if not self.store.exists(name := self._epoch(epoch_id)):
            return None
        id = self.store.read(name)["snapshot"]
        if not self.store.exists(f"metadata/v{id}.json"):
            return None
        found = self.snapshot(id)
        return found if found.summary.get("epoch_id") == epoch_id else None

    def commit(self, base: Snapshot, operation: str, entries: DataFrame | None, summary: dict | None = None, spec: TableSpec | None = None, next_row_id: int | None = None, manifests: tuple[str, ...] | None = None) -> Snapshot:
        """Add a snapshot on ``base``; raises ConflictError if another came first."""
        return self.activate(self.prepare(base, operation, entries, summary, spec, next_row_id, manifests))

    def prepare(self, base: Snapshot, operation: str, entries: DataFrame | None, summary: dict | None = None, spec: TableSpec | None = None, next_row_id: int | None = None, manifests: tuple[str, ...] | None = None) -> str:
        """Write down a commit whose files are there; what a crash leaves of it :meth:`recover` finds."""
        if spec is not None and spec.version != base.spec.version:
            check_successor(base.spec, spec)
        names = base.manifests if manifests is None else manifests
        if entries is not None:
            names = (*names, self.write_manifest(entries)[0])
        new = Snapshot(base.id + 1, base.id, operation, int(time.time() * 1000), names, spec or base.spec, summary or {}, base.next_row_id if next_row_id is None else next_row_id)
        if epoch_id := new.summary.get("epoch_id"):
            self.store.put(self._epoch(epoch_id), {"snapshot": new.id})
        name = f"prepared/{new.id}-{uuid.uuid4().hex}.json"
        self.store.put(name, new.to_json())
        return name

    def activate(self, prepared: str) -> Snapshot:
        """Make a prepared commit the newest snapshot; it is dropped if another came first."""
        new = Snapshot.from_json(self.store.read(prepared))
        try:
            self.store.create(f"metadata/v{new.id}.json", new.to_json())
        finally:
            self.store.delete(prepared)
        return new

    def recover(self, epoch_id: str | None = None) -> Snapshot | None:
        """Finish what was prepared, of one epoch or of any, on the newest snapshot; drop what others overtook.

        Only for the one writer that may have left it, before it starts again.
        """
        done = None
        for name in self.store.list("prepared"):
            new = Snapshot.from_json(self.store.read(f"prepared/{name}"))
            if epoch_id is not None and new.summary.get("epoch_id") != epoch_id:
                continue
            if new.parent == self.snapshot_ids()[-1]:
                done = self.activate(f"prepared/{name}")
            else:
                self.store.delete(f"prepared/{name}")
        return done

    def write_manifest(self, entries: DataFrame) -> tuple[str, DataFrame]:
        """A manifest of these entries, not part of any snapshot yet, and what was written."""
        name = f"manifests/{uuid.uuid4().hex}"
        entries.select([f.split()[0] for f in ENTRY.split(", ")]).coalesce(1).write.parquet(f"{self.root}/{name}")
        return name, self.spark.read.schema(ENTRY).parquet(f"{self.root}/{name}")

    def evolve(self, spec: TableSpec) -> Snapshot:
        return self.commit(self.snapshot(), "schema", None, spec=spec)

    # -- entries -----------------------------------------------------------

    def entries(self, snapshot: Snapshot | None = None) -> DataFrame:
        """Live file entries of a snapshot."""
        snapshot = snapshot or self.snapshot()
        if not snapshot.manifests:
            return self.spark.createDataFrame([], ENTRY)
        every = self.spark.read.schema(ENTRY).parquet(*[f"{self.root}/{m}" for m in snapshot.manifests])
        removed = every.where("status = 'removed'").select("path", "kind")
        return every.where("status = 'added'").join(removed, ["path", "kind"], "left_anti").select(every.columns)

    def files(self, snapshot: Snapshot | None = None) -> list[Row]:
        """What a scan has to know of each live file, as Spark's own file listing does: one small row a file, read once a snapshot."""
        snapshot = snapshot or self.snapshot()
        if snapshot.id not in self._files:
            self._files[snapshot.id] = self.entries(snapshot).select("kind", "path", "target", "lower_path", "upper_path", "sequence", "record_count", "touched").collect()
        return self._files[snapshot.id]

    def paths(self, kind: str, snapshot: Snapshot | None = None) -> list[str]:
        """Paths to hand to a reader."""
        return sorted({f.path for f in self.files(snapshot) if f.kind == kind})

    def rewrite_manifests(self) -> Snapshot:
        """One manifest of the live entries instead of all that led to them."""
        base = self.snapshot()
        return self.commit(base, "replace", self.entries(base).withColumn("status", F.lit("added")).coalesce(1), {"rewrote_manifests": len(base.manifests)}, manifests=())

    # -- reading -----------------------------------------------------------

    def positioned(self, snapshot: Snapshot | None = None, paths: list[str] | None = None) -> DataFrame:
        """All physical rows with ``_path`` and ``_pos``."""
        snapshot = snapshot or self.snapshot()
        paths = self.paths("data", snapshot) if paths is None else paths
        columns = snapshot.spec.names
        kinds = ", ".join([f"`{c.name}` {c.type.simpleString()}" for c in snapshot.spec.columns] + ["_version long", "_lsn long", "_row_id long", "_changed_at long"])
        if not paths:
            return self.spark.createDataFrame([], f"{kinds}, _path string, _pos long")
        read = self.spark.read.schema(kinds).parquet(*paths)
        return read.select(*columns, *META, F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_pos"))

    def _delete_rows(self, kind: str, paths: list[str]) -> DataFrame:
        if kind == "pos":
            return self.spark.read.schema("path string, pos long").parquet(*paths).select(F.col("_metadata.file_path").alias("delete_path"), "path", "pos", F.lit("pos").alias("kind"))
        read = self.spark.read.schema("path string, positions array<long>").parquet(*paths)
        return read.select(F.col("_metadata.file_path").alias("delete_path"), "path", F.explode("positions").alias("pos"), F.lit("dv").alias("kind"))

    def deletes(self, snapshot: Snapshot | None = None) -> DataFrame:
        """(path, pos) of all positions that deletes take from live data files."""
        snapshot = snapshot or self.snapshot()
        made = [self._delete_rows(kind, paths) for kind in ("pos", "dv") if (paths := self.paths(kind, snapshot))]
        if not made:
            return self.spark.createDataFrame([], "path string, pos long")
        rows = made[0] if len(made) == 1 else made[0].unionByName(made[1])
        return effective_positions(rows, self.entries(snapshot))

    def bounded_deletes(self, most_bytes: int, most_rows: int, snapshot: Snapshot | None = None) -> DataFrame:
        """:meth:`deletes`, refused before any file is opened if the delete files hold more than these budgets."""
        known = self.entries(snapshot).where("kind <> 'data'").groupBy("path").agg(F.max("size_bytes").alias("size"), F.sum("record_count").alias("n")).agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if known[0] > most_bytes or known[1] > most_rows:
            raise ValueError(f"deletes of {known[0]} bytes and {known[1]} rows exceed the budgets")
        return self.deletes(snapshot)

    def _gone(self, snapshot: Snapshot, paths: list[str]) -> tuple[set[str], DataFrame | None, int]:
        """Which of these data files deletes touch, the deleted positions (may repeat), and how many there are at most.

        Entries name what a delete file touches, so nothing but metadata is read to plan a scan.
        """
        wanted = set(paths)
        data = {f.path: f.sequence for f in self.files(snapshot) if f.kind == "data"}
        vectors = {f.target for f in self.files(snapshot) if f.kind == "dv"}
        touched, plain, used, many = set(), True, {"pos": set(), "dv": set()}, 0
        for f in self.files(snapshot):
            if f.kind == "data":
                continue
            told = [f.target] if f.target else f.touched
            targets = [t for t in told if t in data] if told is not None else [t for t in data if (f.lower_path or "") <= t and (f.upper_path is None or t <= f.upper_path)]
            if not wanted.isdisjoint(targets):
                touched |= wanted.intersection(targets)
                used[f.kind].add(f.path)
                many += f.record_count
                plain &= told is not None and all(f.sequence >= data[t] and (f.kind == "dv" or t not in vectors) for t in targets)
        if not touched:
            return touched, None, 0
        if not plain:
            return touched, self.deletes(snapshot), many
        made = [self._delete_rows(kind, sorted(files)).select("path", "pos") for kind, files in used.items() if files]
        return touched, made[0] if len(made) == 1 else made[0].unionByName(made[1]), many

    def live(self, snapshot: Snapshot | None = None, files: DataFrame | list[str] | None = None) -> DataFrame:
        """Live rows with metadata columns; ``files`` (path) restricts the data files that are read.

        Files that no delete touches are only scanned.  Rows of the others meet the deleted positions: where the rows are
        if the positions are few, by a shuffle of these files' rows if not.
        """
        snapshot = snapshot or self.snapshot()
        paths = self.paths("data", snapshot) if files is None else files if isinstance(files, list) else [r.path for r in files.select("path").collect()]
        touched, gone, many = self._gone(snapshot, paths)
        if gone is None:
            return self.positioned(snapshot, paths)
        clean = self.positioned(snapshot, [p for p in paths if p not in touched])
        gone = gone.select(F.col("path").alias("_path"), F.col("pos").alias("_pos"))
        # Files of deletes are far smaller than their rows, so Spark must not judge by their size which side it sends to all.
        gone = F.broadcast(gone) if many <= BROADCAST_POSITIONS else gone.hint("merge")
        kept = self.positioned(snapshot, [p for p in paths if p in touched]).join(gone, ["_path", "_pos"], "left_anti").select(clean.columns)
        return clean.unionByName(kept) if len(touched) < len(paths) else kept

    def backwards(self, path: str, snapshot: Snapshot | None = None) -> DataFrame:
        """Rows of a data file, the last one first."""
        return self.positioned(snapshot, [path]).orderBy(F.desc("_pos"))

    def at(self, positions: DataFrame, snapshot: Snapshot | None = None) -> DataFrame:
        """Physical rows at (path, pos), in order; only the files that are named are read, and none is read past the last position."""
        wanted = positions.select(F.col("path").alias("_path"), F.col("pos").alias("_pos")).distinct()
        spans = {r["_path"]: r for r in wanted.groupBy("_path").agg(F.min("_pos").alias("low"), F.max("_pos").alias("high")).collect()}  # one row a file
        every = self.positioned(snapshot, sorted(spans))
        low, high = min((r.low for r in spans.values()), default=0), max((r.high for r in spans.values()), default=0)
        return every.where(F.col("_pos").between(low, high)).join(wanted, ["_path", "_pos"], "left_semi").select(every.columns).orderBy("_path", "_pos")

    def vector_faults(self, snapshot: Snapshot | None = None) -> DataFrame:
        """(path, target, fault) of deletion vectors that don't fit: unknown target, wrong count, repeated or unordered positions, positions outside."""
        snapshot = snapshot or self.snapshot()
        paths = self.paths("dv", snapshot)
        if not paths:
            return self.spark.createDataFrame([], "path string, target string, fault string")
        entries = self.entries(snapshot)
        read = self.spark.read.schema("path string, positions array<long>").parquet(*paths).select(F.col("_metadata.file_path").alias("file"), F.col("path").alias("target"), "positions")
        own = entries.where("kind = 'dv'").select(F.col("path").alias("file"), "target", F.col("record_count").alias("told"))
        data = entries.where("kind = 'data'").select(F.col("path").alias("target"), F.col("record_count").alias("rows"))
        p = F.col("positions")
        fault = (
            F.when(F.col("rows").isNull(), "unknown target").when(F.size(p) != F.col("told"), "count").when(p != F.sort_array(F.array_distinct(p)), "order").when((F.array_min(p) < 0) | (F.array_max(p) >= F.col("rows")), "range")
        )
        return read.join(own, ["file", "target"]).join(data, "target", "left").select(F.col("file").alias("path"), "target", fault.alias("fault")).where("fault is not null")

    def reports(self) -> DataFrame:
        """(id, operation, epoch_id, added_files, added_rows, added_bytes, added_deletes, removed_files, behind_parent_ms) of each snapshot."""
        found = [self.snapshot(i) for i in self.snapshot_ids()]
        by_id = {s.id: s for s in found}
        rows = [(s.id, s.operation, s.summary.get("epoch_id"), m, s.timestamp_ms - by_id[s.parent].timestamp_ms if s.parent in by_id else None) for s in found for m in [x for x in s.manifests if s.parent not in by_id or x not in by_id[s.parent].manifests] or [None]]
        kept = self.spark.createDataFrame(rows, "id long, operation string, epoch_id string, manifest string, behind_parent_ms long")
        names = sorted({r[3] for r in rows if r[3]})
        if not names:
            return kept.select("id", "operation", "epoch_id", *[F.lit(0).cast("long").alias(c) for c in ("added_files", "added_rows", "added_bytes", "added_deletes", "removed_files")], "behind_parent_ms")
        read = self.spark.read.schema(ENTRY).parquet(*[f"{self.root}/{m}" for m in names]).withColumn("manifest", F.regexp_extract("_metadata.file_path", "(manifests/[0-9a-f]+)/[^/]*$", 1))
        data, lost, gone = (F.col("status") == "added") & (F.col("kind") == "data"), (F.col("status") == "added") & (F.col("kind") != "data"), F.col("status") == "removed"
        total = lambda cond, value, name: F.coalesce(F.sum(F.when(cond, value)), F.lit(0)).cast("long").alias(name)
        return kept.join(read, "manifest", "left").groupBy("id", "operation", "epoch_id", "behind_parent_ms").agg(
            total(data, 1, "added_files"), total(data, F.col("record_count"), "added_rows"), total(data, F.col("size_bytes"), "added_bytes"), total(lost, F.col("record_count"), "added_deletes"), total(gone, 1, "removed_files")
        ).select("id", "operation", "epoch_id", "added_files", "added_rows", "added_bytes", "added_deletes", "removed_files", "behind_parent_ms")

    def read(self, snapshot_id: int | None = None, lineage: bool = False) -> DataFrame:
        """The table's rows as of a snapshot, optionally with ``_row_id`` and ``_last_updated_sequence_number``."""
        snapshot = self.snapshot(snapshot_id)
        rows = self.live(snapshot)
        if not lineage:
            return rows.select(snapshot.spec.names)
        files = self.entries(snapshot).where("kind = 'data'").select(F.col("path").alias("_path"), "first_row_id", "sequence")
        # Files of narrow rows may be smaller than the manifests of many epochs, so Spark must not judge by size which side it sends to all.
        rows = rows.join(F.broadcast(files), "_path")
        return rows.select(*snapshot.spec.names, F.coalesce("_row_id", F.col("first_row_id") + F.col("_pos")).alias("_row_id"), F.coalesce("_changed_at", "sequence").alias("_last_updated_sequence_number"))

    # -- writing files -----------------------------------------------------

    def write_data(self, rows: DataFrame, spec: TableSpec, sequence: int, level: int, first_row_id: int, label: str, files: int | None = None, most: int | None = None) -> DataFrame:
        """Write rows (the specification's columns and metadata columns) sorted within files of at most ``most`` rows; entries of what was written."""
        order = [F.col(s.column).asc_nulls_first() if s.ascending and s.nulls_first else F.col(s.column).asc_nulls_last() if s.ascending else F.col(s.column).desc_nulls_first() if s.nulls_first else F.col(s.column).desc_nulls_last() for s in spec.sort]
        order = order or [F.col(k) for k in spec.key]
        own = project(rows, spec).columns
        kept = rows.select(*own, *[(F.col(c) if c in rows.columns else F.lit(None)).cast("long").alias(c) for c in META])
        if files:
            kept = kept.repartition(files, *spec.key) if spec.key else kept.repartition(files)
        if order:
            kept = kept.sortWithinPartitions(*order)
        folder = f"{self.root}/data/sluice-l{level}-{label}-{uuid.uuid4().hex[:12]}"
        kept.write.option("maxRecordsPerFile", most or 0).parquet(folder)
        return self._data_entries(folder, spec, sequence, level, first_row_id, bool(order))

    def _data_entries(self, folder: str, spec: TableSpec, sequence: int, level: int, first_row_id: int, sorted_: bool) -> DataFrame:
        key = spec.key[0] if spec.key else None
        kind = next((c.type for c in spec.columns if c.name == key), None)
        files = self.store.sizes(folder)
        if len(files) <= FOOTERS and (key is None or isinstance(kind, PLAIN_KEYS)):
            found = [(path, size, *self.store.footer(path, key)) for path, size in files]
        else:
            value = F.col(key) if key else F.lit(None)
            read = self.spark.read.parquet(folder).groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
            found = [tuple(r) for r in read.agg(F.count("*"), F.min(value).cast("string"), F.max(value).cast("string")).orderBy("path").collect()]  # one row a file
        now, rows = int(time.time() * 1000), []
        for path, size, n, lower, upper in found:
            if n:
                rows.append(("added", "data", path, None, None, None, sequence, n, size, level, first_row_id, lower, upper, sorted_, now, None))
                first_row_id += n
        return self.spark.createDataFrame(rows, ENTRY)

    def write_deletes(self, positions: DataFrame, sequence: int, format_version: int, prior: DataFrame | None = None, files: int | None = None) -> DataFrame:
        """Write (path, pos) as sorted position deletes, of that many files if told, or for version 3 as one vector a target that holds ``prior`` positions too."""
        folder, now = f"{self.root}/deletes/{uuid.uuid4().hex}", int(time.time() * 1000)
        own = positions.select("path", "pos")
        targets = sorted(r.path for r in own.select("path").distinct().collect())  # data files, not rows
        rows: list[tuple] = []
        if not targets:
            return self.spark.createDataFrame(rows, ENTRY)
        if format_version == 2:
            own.distinct().repartitionByRange(*([files] if files else []), "path", "pos").sortWithinPartitions("path", "pos").write.parquet(folder)
            for path, size in self.store.sizes(folder):
                n, lower, upper = self.store.footer(path, "path")
                if n:
                    # Files are ranges of (path, pos), so all targets between a file's first and last are in it.
                    touched = targets[bisect.bisect_left(targets, lower) : bisect.bisect_right(targets, upper)]
                    rows.append(("added", "pos", path, lower if lower == upper else None, lower, upper, sequence, n, size, None, None, None, None, True, now, touched))
        else:
            from sluice.operators.deletes import vectors

            if prior is not None:
                own = own.unionByName(prior.where(F.col("path").isin(targets)).select("path", "pos"))
            vectors(own).write.parquet(folder)
            read = self.spark.read.parquet(folder).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.size("positions").alias("n"), "path")
            rows = [("added", "dv", r.file, r.path, r.path, r.path, sequence, r.n, r.size, None, None, None, None, True, now, [r.path]) for r in read.collect()]  # one row a target
        return self.spark.createDataFrame(rows, ENTRY)


def removed(entries: DataFrame) -> DataFrame:
    return entries.withColumn("status", F.lit("removed"))


def with_retry(work, attempts: int = 5):
    """Run ``work`` again from planning when another writer was first."""
    for k in range(attempts):
        try:
            return work()
        except ConflictError:
            if k == attempts - 1:
                raise
            time.sleep(0.05 * 2**k)


__all__ = ["ENTRY", "Snapshot", "Table", "removed", "replace", "with_retry"]
