"""Maintenance of tables: inventory, rewrites, consolidation of deletes, verification."""

from __future__ import annotations

import sys
import time
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from sluice.functions import scalars
from sluice.operators import reconcile
from sluice.operators.deletes import applicable
from sluice.plans import compaction
from sluice.plans.storage import persist
from sluice.plans.table import ENTRY, META, Snapshot, Table, removed, with_retry

ENTRIES = [f.split()[0] for f in ENTRY.split(", ")]


def inventory(table: Table, snapshot: Snapshot | None = None, now_ms: int | None = None) -> DataFrame:
    """(path, level, size_bytes, row_count, deleted_rows, delete_files, own_deletes, age_ms, manifests) of live data files.

    ``own_deletes`` are delete files of this file alone; the age counts from when the file was added; ``manifests`` is how
    many the snapshot has.
    """
    snapshot = snapshot or table.snapshot()
    entries = table.entries(snapshot).withColumn("partition", F.lit(0))
    files = entries.where("kind = 'data'")
    deleted = table.deletes(snapshot).groupBy("path").agg(F.count("*").alias("deleted_rows"))
    pairs = applicable(entries.where("kind <> 'data'").select("path", "kind", "target", "lower_path", "upper_path", "sequence", "partition"), files.select("path", "sequence", "partition"))
    alone = entries.where("kind <> 'data' and target is not null").select(F.col("path").alias("delete_path"), "target", F.lit(1).alias("own")).distinct()
    counts = pairs.join(alone, ["delete_path", "target"], "left").groupBy(F.col("target").alias("path")).agg(F.count("*").alias("delete_files"), F.count("own").alias("own_deletes"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    age = F.lit(int(time.time() * 1000) if now_ms is None else now_ms) - F.col("added_ms")
    return files.join(deleted, "path", "left").join(counts, "path", "left").select(
        "path", "level", "size_bytes", F.col("record_count").alias("row_count"), zero("deleted_rows"), zero("delete_files"), zero("own_deletes"), age.alias("age_ms"), F.lit(len(snapshot.manifests)).alias("manifests")
    )


def delete_inventory(table: Table, snapshot: Snapshot | None = None) -> DataFrame:
    """(path, size_bytes, row_count, targets) of live delete files that a live data file needs."""
    entries = table.entries(snapshot or table.snapshot()).withColumn("partition", F.lit(0))
    made = entries.where("kind <> 'data'").select("path", "kind", "target", "lower_path", "upper_path", "sequence", "partition", "size_bytes", "record_count", "touched")
    pairs = applicable(made, entries.where("kind = 'data'").select("path", "sequence", "partition"))
    own = made.groupBy("path").agg(F.first("size_bytes").alias("size_bytes"), F.sum("record_count").alias("row_count"), F.flatten(F.collect_set("touched")).alias("told"))
    joined = pairs.join(own, F.col("delete_path") == F.col("path")).where(F.size("told").isin(-1, 0) | F.array_contains("told", F.col("target")))
    return joined.groupBy("path", "size_bytes", "row_count").agg(F.sort_array(F.collect_set("target")).alias("targets"))


@dataclass(frozen=True)
class Build:
    """A rewrite whose files are written but not committed: its inputs as of a snapshot, and the entries it adds."""

    base: int
    paths: tuple[str, ...]
    level: int
    made: DataFrame
    rows: int


def build(table: Table, paths: list[str], level: int, files: int = 1, file_bytes: int | None = None) -> Build:
    """Write live rows of data files as new ones, next to whatever the table goes on to do; :func:`finish` commits them.

    Rows keep version, id and last change.  ``file_bytes`` is how large files may get, by the size of rows so far.
    """
    base, chosen = table.snapshot(), sorted(set(paths))
    inputs = table.entries(base).where("kind = 'data'").where(F.col("path").isin(chosen)).collect()  # the files of one rewrite
    if len(inputs) != len(chosen):
        raise ValueError("a file to rewrite isn't live")
    ids = table.spark.createDataFrame([(f.path, f.first_row_id, f.sequence) for f in inputs], "_path string, first_row_id long, sequence long")
    rows = table.live(base, chosen).join(F.broadcast(ids), "_path")
    rows = rows.withColumn("_row_id", F.coalesce("_row_id", F.col("first_row_id") + F.col("_pos"))).withColumn("_changed_at", F.coalesce("_changed_at", "sequence"))
    size, count = sum(f.size_bytes for f in inputs), sum(f.record_count for f in inputs)
    most = max(1, file_bytes * count // max(1, size)) if file_bytes else None
    made = table.write_data(rows.select(*base.spec.names, *META), base.spec, base.id + 1, level, base.next_row_id, "rewrite", files, most)
    return Build(base.id, tuple(chosen), level, made, sum(r.record_count for r in made.select("record_count").collect()))


def late_deletes(table: Table, done: Build, head: Snapshot) -> DataFrame:
    """(path, pos) in a build's new files of rows that were deleted from its inputs since its base, by their row ids."""
    own = lambda s: table.deletes(s).where(F.col("path").isin(list(done.paths)))
    late = own(head).join(own(table.snapshot(done.base)), ["path", "pos"], "left_anti")
    files = table.entries(head).where("kind = 'data'").select(F.col("path").alias("_path"), "first_row_id")
    old = table.positioned(head, list(done.paths)).join(F.broadcast(files), "_path")
    gone = old.join(late.select(F.col("path").alias("_path"), F.col("pos").alias("_pos")), ["_path", "_pos"], "left_semi").select(F.coalesce("_row_id", F.col("first_row_id") + F.col("_pos")).alias("_row_id"))
    new = table.positioned(head, [r.path for r in done.made.select("path").collect()]).select("_row_id", "_path", "_pos")
    moves = new.join(gone, "_row_id", "left_semi")
    return moves.select(F.col("_path").alias("path"), F.col("_pos").alias("pos"))


def needed(delete: Row, survivors: set[str]) -> bool:
    """Whether a delete file touches any of these data files, by what its entry names or else by its range of paths."""
    told = [delete.target] if delete.target else delete.touched
    if told is not None:
        return not survivors.isdisjoint(told)
    return any((delete.lower_path or "") <= p and (delete.upper_path is None or p <= delete.upper_path) for p in survivors)


def finish(table: Table, done: Build) -> Snapshot:
    """Commit a build on the newest snapshot; deletes that reached its inputs meanwhile move along to its files.

    Inputs that another rewrite took make it useless: that raises ``LookupError``.
    """

    def attempt() -> Snapshot:
        head, chosen = table.snapshot(), list(done.paths)
        inputs = table.entries(head).where("kind = 'data'").where(F.col("path").isin(chosen)).collect()
        if len(inputs) != len(chosen):
            raise LookupError("another rewrite took files of this build")
        # Positions in the new files count from this commit on, their row ids from the table's.
        ahead = head.next_row_id - table.snapshot(done.base).next_row_id
        rows = [f.asDict() | {"status": "removed"} for f in inputs]
        rows += [f.asDict() | {"sequence": head.id + 1, "first_row_id": f.first_row_id + ahead} for f in done.made.collect()]
        if head.id != done.base:
            rows += [f.asDict() for f in table.write_deletes(late_deletes(table, done, head), head.id + 1, head.spec.format_version).collect()]
        # Deletes that no surviving file needs go; positions on rewritten files that shared ones keep are harmless.
        survivors = {f.path for f in table.files(head) if f.kind == "data"} - set(chosen)
        deletes = [f for f in table.files(head) if f.kind != "data"]
        useless = sorted({f.path for f in deletes} - {f.path for f in deletes if needed(f, survivors)})  # a file of vectors has several entries
        if useless:
            rows += [f.asDict() | {"status": "removed"} for f in table.entries(head).where("kind <> 'data'").where(F.col("path").isin(useless)).collect()]
        changes = table.spark.createDataFrame([tuple(r[c] for c in ENTRIES) for r in rows], ENTRY)
        return table.commit(head, "replace", changes, {"rewrote": len(chosen), "level": f"L{done.level}"}, next_row_id=head.next_row_id + done.rows)

    return with_retry(attempt)


def rewrite(table: Table, paths: list[str], level: int, files: int = 1, file_bytes: int | None = None) -> Snapshot:
    """Live rows of data files as new ones, in a ``replace`` snapshot that changes no row."""
    return finish(table, build(table, paths, level, files, file_bytes))


def judge(table: Table, id: int) -> str:
    """Whether a ``replace`` snapshot, of whichever writer, kept all rows of its parent: ``equivalent`` or ``external_mutation``.

    Only rows of files that the snapshot removed or added are compared, by key or, without one, as a multiset.
    """
    after = table.snapshot(id)
    before = table.snapshot(after.parent)
    old, new = ({f.path for f in table.files(s) if f.kind == "data"} for s in (before, after))
    same = [p for p in old & new]
    if reconcile.delete_set_difference(*(table.deletes(s).where(F.col("path").isin(same)) for s in (before, after))).first() != (0, 0):
        return "external_mutation"
    marked = lambda s, paths: table.live(s, sorted(paths)).withColumn("fingerprint", scalars.fingerprint(*[F.col(c) for c in before.spec.names]))
    rows = marked(before, old - new), marked(after, new - old)
    found = reconcile.reconcile_keyed(*rows, list(before.spec.key)) if before.spec.key else reconcile.reconcile_multiset(*rows)
    counts = found.first().asDict()
    counts.pop("matched")
    return "external_mutation" if any(counts.values()) else "equivalent"


def planned(table: Table, policy: compaction.Policy = compaction.Policy(), now_ms: int | None = None) -> compaction.Plan | None:
    """The group of files that the planner would rewrite next, deletes and their budgets included."""
    snapshot = table.snapshot()
    files = persist(inventory(table, snapshot, now_ms), "inventory")
    return compaction.plan(files, persist(delete_inventory(table, snapshot), "inventory"), policy.for_version(snapshot.spec.format_version))


def compact(table: Table, policy: compaction.Policy = compaction.Policy(), now_ms: int | None = None) -> Snapshot | None:
    """Rewrite the group that the planner chooses, if any."""
    chosen = planned(table, policy, now_ms)
    return chosen and rewrite(table, sorted(chosen.inputs), chosen.level, file_bytes=chosen.target_bytes)


def consolidate(table: Table, policy: compaction.Policy | None = None) -> Snapshot | None:
    """Position deletes as one sorted run; the deleted positions stay the same.

    With a policy the smallest shared delete files within its budgets, and nothing if fewer than two fit; else all.
    """

    def attempt() -> Snapshot | None:
        base = table.snapshot()
        old = table.entries(base).where("kind <> 'data'")
        if policy is not None:
            files, size, rows = policy.delete_inputs
            shared = old.where("kind = 'pos'").select("path", "size_bytes", F.col("record_count").alias("row_count"))
            chosen = [r.path for r in compaction.consolidation(shared, files, size, rows).collect()]  # at most ``files``
            if len(chosen) < 2:
                return None
            old = old.where(F.col("path").isin(chosen))
            live = table.entries(base).where("kind = 'data'").select("path")
            positions = table._delete_rows("pos", chosen).select("path", "pos").join(live, "path", "left_semi")
        else:
            positions = table.deletes(base)
        # What the budgets admit is one file, or else consolidation might make as many files as it takes, again and again.
        made = table.write_deletes(positions, base.id + 1, base.spec.format_version, files=None if policy is None else 1)
        return table.commit(base, "replace", removed(old).unionByName(made), {"consolidated": old.count()})

    return with_retry(attempt)


def choose(known: dict, policy: compaction.Policy, plan: compaction.Plan | None) -> str:
    """What a visit does: consolidate deletes first where their number presses, else rewrite, else nothing."""
    if policy.consolidate_first and max(known["most_deletes"], known["shared"]) >= policy.delete_files[0]:
        return "consolidate"
    return "rewrite" if plan else "none"


def visit(table: Table, policy: compaction.Policy = compaction.Policy(), now_ms: int | None = None) -> str:
    """One visit of maintenance: what was done, ``consolidate``, ``rewrite``, ``manifests`` or ``none``."""
    snapshot = table.snapshot()
    policy = policy.for_version(snapshot.spec.format_version)
    files, deletes = persist(inventory(table, snapshot, now_ms), "inventory"), persist(delete_inventory(table, snapshot), "inventory")
    known = compaction.facts(files, deletes, policy).asDict()
    action = choose(known, policy, None)
    if action == "consolidate" and consolidate(table, policy) is not None:
        return action
    try:
        chosen = compaction.plan(files, deletes, policy)
    except compaction.BudgetError:
        # Nothing else would ever lower these deletes.  One file alone meets them by a shuffle, whatever their number.
        chosen = compaction.plan(files, deletes, replace(policy, group=(1, 1), delete_inputs=(sys.maxsize,) * 3))
    if choose(known | {"most_deletes": 0, "shared": 0}, policy, chosen) == "rewrite":
        rewrite(table, sorted(chosen.inputs), chosen.level, max(1, -(-chosen.input_bytes // chosen.target_bytes)))
        return "rewrite"
    if len(snapshot.manifests) >= policy.manifests:
        table.rewrite_manifests()
        return "manifests"
    return "none"


def catch_up(late: DataFrame, runs: DataFrame) -> DataFrame:
    """(path, pos) in the new files of deletes (path, pos) that reached the old ones while a rewrite was built; ``runs`` as of remaps."""
    from sluice.operators.layout import translate

    return translate(late, runs).select("path", "pos")
