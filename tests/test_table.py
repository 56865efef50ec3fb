import pytest
from pyspark.sql import functions as F

from sluice.operators import layout
from sluice.operators.collapse import collapse
from sluice.plans import compaction, maintenance, publish, schema
from sluice.plans.storage import ConflictError
from sluice.plans.table import Table

LOG = "id long, v string, end_lsn long, ordinal long, half int, op string, unchanged array<string>"


def log(spark, rows):
    return spark.createDataFrame([(k, v, n, 0, 0, op, []) for n, (op, k, v) in enumerate(rows, 1)], LOG)


def rows_of(df):
    return sorted((r.id, r.v) for r in df.collect())


@pytest.fixture(params=[2, 3])
def table(spark, tmp_path, request):
    base = spark.createDataFrame([(i, f"v{i}") for i in range(20)], "id long, v string")
    made = Table.create(spark, f"{tmp_path}/t", schema.infer_spec(base, "t", ("id",), format_version=request.param))
    publish.copy(made, base, 0, 3)
    return made


def test_epochs_time_travel_and_compaction(spark, table):
    first = rows_of(table.read())
    publish.publish(table, log(spark, [("U", 1, "x"), ("D", 2, None), ("I", 100, "n")]), "e1", 2)
    second = rows_of(table.read())
    publish.publish(table, log(spark, [("U", 1, "y"), ("U", 100, "m"), ("D", 3, None)]), "e2", 2)
    third = rows_of(table.read())
    assert dict(third)[1] == "y" and dict(third)[100] == "m" and 2 not in dict(third) and 3 not in dict(third) and len(third) == 19
    for action in (lambda: maintenance.consolidate(table), lambda: table.rewrite_manifests(), lambda: maintenance.rewrite(table, table.paths("data"), 1, 2)):
        action()
        assert rows_of(table.read()) == third
    assert rows_of(table.read(1)) == first and rows_of(table.read(2)) == second
    kinds = {r.kind for r in table.entries().collect()}
    assert kinds == {"data"}, "a rewrite of all files leaves no deletes"
    versions = {r.id: r._version for r in table.live().collect()}
    assert versions[1] == 3 and versions[100] == 2 and versions[5] == 1


def test_many_deleted_positions_are_not_broadcast_for_the_size_of_their_files(spark, table, monkeypatch):
    publish.publish(table, log(spark, [("U", 1, "x"), ("D", 2, None)]), "e1", 2)
    monkeypatch.setattr("sluice.plans.table.BROADCAST_POSITIONS", 1)
    plan = table.live()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert dict(rows_of(table.read())) == {i: "x" if i == 1 else f"v{i}" for i in range(20) if i != 2}


def test_rows_that_changes_meet_are_not_broadcast_for_the_size_of_their_files(spark, table):
    changes = collapse(log(spark, [("U", 1, "x"), ("D", 2, None)]), ["id"], ["v"])
    bound = publish.bind(changes, table.live(), ["id"])
    plan = bound._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert sorted((r.id, r._old.v, r._o_version) for r in bound.collect()) == [(1, "v1", 1), (2, "v2", 1)]


def test_rows_that_meet_their_files_are_not_broadcast_for_the_size_of_their_files(spark, table):
    """Manifests of many epochs may be larger than narrow rows; the files' entries, one row each, are what is sent to all."""
    publish.publish(table, log(spark, [("U", 1, "x"), ("D", 2, None)]), "e1", 2)
    maintenance.rewrite(table, table.paths("data"), 1)
    rows = table.read(lineage=True)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [_path" in plan and "BuildLeft" not in plan
    assert {r.id: r._last_updated_sequence_number for r in rows.collect()} == {i: 2 if i == 1 else 1 for i in range(20) if i != 2}


def test_visits_end_where_deletes_take_several_files_and_exceed_the_budgets(spark, tmp_path):
    base = spark.createDataFrame([(i, f"v{i}") for i in range(400)], "id long, v string")
    table = Table.create(spark, f"{tmp_path}/t", schema.infer_spec(base, "t", ("id",)))
    publish.copy(table, base, 0, 2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small runs are cut as large ones are
    try:
        publish.publish(table, log(spark, [("D", i, None) for i in range(0, 400, 2)]), "e1", 1)
        publish.publish(table, log(spark, [("D", i, None) for i in range(1, 400, 4)]), "e2", 1)
        assert len(table.paths("pos")) > 2
        limits = compaction.Policy(delete_files=(2, 16), min_age_ms=0, group=(1, 32), delete_inputs=(32, 1 << 20, 120))
        done = []
        while (action := maintenance.visit(table, limits)) != "none":
            done.append(action)
            assert len(done) < 12, done
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {"consolidate", "rewrite"} <= set(done) and not table.paths("pos")
    assert rows_of(table.read()) == [(i, f"v{i}") for i in range(3, 400, 4)]


def test_deletes_have_one_vector_a_target(spark, table):
    for n in (4, 5):
        publish.publish(table, log(spark, [("D", n, None)]), f"d{n}")
    deletes = table.entries().where("kind <> 'data'").collect()
    if table.spec.format_version == 3:
        newest = {}
        for d in deletes:
            newest[d.target] = max(newest.get(d.target, 0), d.sequence)
        assert sum(d.record_count for d in deletes if d.sequence == newest[d.target]) == 2
    assert table.deletes().count() == 2 == table.bounded_deletes(1 << 20, 100).count()
    for budget in ((1, 100), (1 << 20, 1)):
        with pytest.raises(ValueError, match="budgets"):
            table.bounded_deletes(*budget)


def test_an_epoch_is_published_once(spark, table):
    change = log(spark, [("D", 1, None)])
    a = publish.publish(table, change, "e")
    assert publish.publish(table, change, "e").id == a.id
    assert publish.publish(table, change.limit(0), "none").id == a.id


def test_presence_conflicts_raise_and_leave_the_table(spark, table):
    before = table.snapshot().id
    for bad in ([("I", 1, "x")], [("U", 777, "x")], [("D", 777, None)]):
        with pytest.raises(Exception, match="conflict"):
            publish.publish(table, log(spark, bad), "bad")
    assert table.snapshot().id == before


def test_of_two_writers_one_wins(spark, table):
    base = table.snapshot()
    table.commit(base, "append", None, {})
    with pytest.raises(ConflictError):
        table.commit(base, "append", None, {})


def test_row_ids_survive_updates_and_rewrites(spark, table):
    ids = {r.id: r._row_id for r in table.read(lineage=True).collect()}
    maintenance.rewrite(table, table.paths("data"), 1)
    after = {r.id: (r._row_id, r._last_updated_sequence_number) for r in table.read(lineage=True).collect()}
    assert {k: v[0] for k, v in after.items()} == ids and len(set(ids.values())) == 20 and {v[1] for v in after.values()} == {1}


def test_schema_rules(spark):
    from pyspark.sql import types as T

    long, text = T.LongType(), T.StringType()
    col = schema.ColumnSpec
    spec = schema.TableSpec("t", (col(1, "id", long, False), col(2, "v", text, False)), ("id",))
    wider = schema.successor(spec, T.StructType([T.StructField("id", long), T.StructField("v", text), T.StructField("n", long)]))
    assert [c.id for c in wider.columns] == [1, 2, 3] and wider.columns[2].nullable and not wider.columns[0].nullable
    assert schema.TableSpec.from_json(wider.to_json()) == wider
    for bad in (
        lambda: schema.TableSpec("t", (col(1, "id", long),), ("id",)),
        lambda: schema.TableSpec("t", (col(1, "id", T.DoubleType(), False),), ("id",)),
        lambda: schema.TableSpec("t", (col(1, "id", long), col(1, "w", long)), append_only=True),
        lambda: schema.TableSpec("t", (col(1, "id", long),)),
        lambda: schema.successor(spec, T.StructType([T.StructField("id", long)])),
    ):
        with pytest.raises(ValueError):
            bad()
    relaxed = schema.relaxed(spec, spark.createDataFrame([(1, None)], "id long, v string"))
    assert relaxed.version == 2 and relaxed.columns[1].nullable


def test_sort_specs():
    assert layout.parse_sort("a desc nulls last, b")[0] == schema.SortField("a", False, False)
    with pytest.raises(ValueError):
        layout.parse_sort("bucket(4, a)")


def test_rewritten_files_are_sorted(spark, table):
    maintenance.rewrite(table, table.paths("data"), 1, 1)
    rows = table.positioned().withColumn("file", F.col("_path"))
    assert {r.inversions for r in layout.inversions(rows, layout.parse_sort("id"), "file", "_pos").collect()} == {0}


def test_expired_snapshots_leave_unreachable_files(spark, table):
    publish.publish(table, log(spark, [("U", 1, "x")]), "e1", 1)
    maintenance.rewrite(table, table.paths("data"), 1, 1)
    assert table.ancestry() == [3, 2, 1, 0] and table.ancestry(keep=2) == [3, 2]
    assert table.unreachable().count() == 0
    now = rows_of(table.read())
    table.expire([0, 1, 2, 3])
    assert table.snapshot_ids() == [3] and rows_of(table.read()) == now
    assert table.unreachable().count() >= 4


def test_catch_up_moves_late_deletes(spark):
    moves = spark.createDataFrame([("a", i, "n", i + 100) for i in range(10)], "old_path string, old_pos long, new_path string, new_pos long")
    late = spark.createDataFrame([("a", 3), ("b", 3)], "path string, pos long")
    assert [(r.path, r.pos) for r in maintenance.catch_up(late, layout.remap_runs(moves)).collect()] == [("n", 103)]


def test_source_types():
    from pyspark.sql import types as T

    from sluice.sources import types

    registry = {900: types.SourceType("domain", 901), 901: types.SourceType("domain", 1700, (10 << 16 | 2) + 4), 902: types.SourceType("array", 23), 903: types.SourceType("enum"), 904: types.SourceType("domain", 904)}
    assert types.resolve(900, -1, registry) == T.DecimalType(10, 2) and types.resolve(902, -1, registry) == T.StringType() == types.resolve(1700)
    assert types.may_be_key(23) and not types.may_be_key(3802) and not types.may_be_key(701) and not types.may_be_key(902, registry)
    for oid in (1186, 904):
        with pytest.raises(ValueError):
            types.resolve(oid, -1, registry)


def test_many_deletes_meet_rows_by_a_shuffle(spark, table, monkeypatch):
    publish.publish(table, log(spark, [("D", 1, None), ("U", 2, "x")]), "e1", 1)
    few = rows_of(table.read())
    monkeypatch.setattr("sluice.plans.table.BROADCAST_POSITIONS", 0)
    assert rows_of(table.read()) == few and len(few) == 19


def test_a_build_catches_up_with_what_happened_meanwhile(spark, table):
    publish.publish(table, log(spark, [("U", 1, "x")]), "e1", 1)
    done = maintenance.build(table, table.paths("data"), 1, 2)
    publish.publish(table, log(spark, [("D", 2, None), ("U", 1, "y"), ("I", 50, "n")]), "e2", 1)
    want, ids = rows_of(table.read()), {r.id: r._row_id for r in table.read(lineage=True).collect()}
    made = maintenance.finish(table, done)
    assert made.operation == "replace" and rows_of(table.read()) == want
    assert {r.id: r._row_id for r in table.read(lineage=True).collect()} == ids
    assert maintenance.judge(table, made.id) == "equivalent"
    with pytest.raises(LookupError):
        maintenance.finish(table, done)


def test_rewrites_that_change_rows_are_told(spark, table):
    base = table.snapshot()
    entries = table.entries(base).where("kind = 'data'")
    fewer = table.write_data(table.live(base).where("id <> 3"), base.spec, base.id + 1, 1, base.next_row_id, "foreign", 1)
    from sluice.plans.table import removed

    bad = table.commit(base, "replace", removed(entries).unionByName(fewer), {})
    assert maintenance.judge(table, bad.id) == "external_mutation"


def test_files_rotate_by_size(spark, table):
    one = sum(f.size_bytes for f in table.entries().where("kind = 'data'").collect())
    maintenance.rewrite(table, table.paths("data"), 1, 1, file_bytes=one // 4)
    counts = [f.record_count for f in table.entries().where("kind = 'data'").collect()]
    assert sum(counts) == 20 and len(counts) >= 4 and max(counts) <= 5


def test_prepared_commits_are_recovered_or_dropped(spark, table):
    base = table.snapshot()
    made = table.write_data(spark.createDataFrame([(77, "p")], "id long, v string"), base.spec, base.id + 1, 0, base.next_row_id, "epoch", 1)
    table.prepare(base, "append", made, {"epoch_id": "lost"}, next_row_id=base.next_row_id + 1)
    assert table.unreachable().count() == 0, "what is prepared is needed"
    again = publish.publish(table, log(spark, [("I", 77, "other")]), "lost")
    assert again.summary["epoch_id"] == "lost" and (77, "p") in rows_of(table.read()) and table.store.list("prepared") == []
    table.prepare(base, "append", made, {"epoch_id": "late"})
    assert table.recover() is None and table.store.list("prepared") == []


def test_garbage_goes_after_its_grace(spark, table):
    publish.publish(table, log(spark, [("U", 1, "x")]), "e1", 1)
    maintenance.rewrite(table, table.paths("data"), 1, 1)
    table.expire([0, 1, 2])
    want = rows_of(table.read())
    assert table.collect_garbage(grace_ms=3_600_000) == []
    assert len(table.collect_garbage(grace_ms=0, now_ms=10**13)) >= 4 and table.unreachable().count() == 0 and rows_of(table.read()) == want


def test_positions_backwards_and_reports(spark, table):
    path = table.paths("data")[0]
    rows = table.positioned(paths=[path]).orderBy("_pos").collect()
    assert [r._pos for r in table.backwards(path).collect()] == [r._pos for r in reversed(rows)]
    wanted = spark.createDataFrame([(rows[0]["_path"], 3), (rows[0]["_path"], 1)], "path string, pos long")
    assert [(r._pos, r.id) for r in table.at(wanted).collect()] == [(1, rows[1].id), (3, rows[3].id)]
    publish.publish(table, log(spark, [("D", 4, None), ("I", 60, "n")]), "e", 1)
    got = {r.id: (r.operation, r.epoch_id, r.added_rows, r.added_deletes) for r in table.reports().collect()}
    assert got[1][0::2] == ("append", 20) and got[2] == ("overwrite", "e", 1, 1)
    assert table.vector_faults().count() == 0


def test_broken_vectors_are_told(spark, table):
    if table.spec.format_version == 2:
        pytest.skip("position deletes")
    base, path = table.snapshot(), table.positioned().select("_path").first()[0]
    folder = f"{table.root}/deletes/broken"
    spark.createDataFrame([(path, [5, 1]), ("nowhere", [1])], "path string, positions array<long>").coalesce(1).write.parquet(folder)
    file = spark.read.parquet(folder).select("_metadata.file_path").first()[0]
    rows = [("added", "dv", file, t, t, t, 2, 2 if t == path else 1, 1, None, None, None, None, True, 0, [t]) for t in (path, "nowhere")]
    from sluice.plans.table import ENTRY

    table.commit(base, "delete", spark.createDataFrame(rows, ENTRY))
    assert {(r.target, r.fault) for r in table.vector_faults().collect()} == {(path, "order"), ("nowhere", "unknown target")}


def test_sources_are_discovered_and_checked_first(spark):
    a = spark.createDataFrame([(1, "x", [1]), (1, None, [2])], "id long, v string, tags array<int>")
    config = schema.discover({"a": a}, {"a": ("id",)})
    assert config["tables"][0]["excluded"] == {"tags": "unsupported type array<int>"} and schema.configured(config)[0].names == ["id", "v"]
    gone = schema.infer_spec(a.select("id"), "b", ("id",))
    found = {(r.table_name, r.check): r.ok for r in schema.preflight({"a": a}, [*schema.configured(config), gone]).collect()}
    assert found[("a", "key is unique")] is False and found[("a", "required columns hold no nulls")] is True and found[("b", "relation exists")] is False


def test_fresh_files_age_and_are_compacted(spark, table):
    from sluice.plans.compaction import Policy

    for n in range(3):
        publish.publish(table, log(spark, [("U", n, f"x{n}")]), f"e{n}", 1)
    added = {f.path: f.added_ms for f in table.entries().where("kind = 'data'").collect()}
    ages = {r.path: r.age_ms for r in maintenance.inventory(table, now_ms=max(added.values()) + 500).collect()}
    assert ages == {p: max(added.values()) + 500 - t for p, t in added.items()} and min(ages.values()) == 500
    want = rows_of(table.read())
    assert maintenance.compact(table, Policy(l0_files=(9, 32), l0_age_ms=(10**9, 10**9), min_age_ms=10**9)) is None
    made = maintenance.compact(table, Policy(l0_files=(2, 32), min_age_ms=0))
    assert made.operation == "replace" and rows_of(table.read()) == want
    assert table.entries().where("kind = 'data' and level = 0").count() == 0
