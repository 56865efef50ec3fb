import pytest

from sluice.plans import publish, schema
from sluice.plans.storage import Store
from sluice.plans.table import Table
from sluice.sources.changes import Journal, read_stream
from sluice.streaming import ingest

STREAM = "position long, kind string, xid long, subxid long, table_id long, begin_lsn long, commit_lsn long, end_lsn long"
LOG = "id long, v string, end_lsn long, ordinal long, half int, op string, unchanged array<string>"


def add(spark, folder, rows, kinds):
    spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(folder)


def test_transactions_span_batches_and_replays_add_nothing(spark, tmp_path):
    folder, journal = f"{tmp_path}/in", Journal(spark, f"{tmp_path}/journal")
    run = lambda: ingest.journal_stream(read_stream(spark, folder, spark.createDataFrame([], STREAM).schema, 1), f"{tmp_path}/waiting", journal, f"{tmp_path}/cp").awaitTermination()
    add(spark, folder, [(1, "insert", 7, 0, 1, None, None, None), (2, "insert", 8, 0, 1, None, None, None), (3, "insert", 9, 0, 1, None, None, None)], STREAM)
    run()
    assert journal.after(0) is None
    add(spark, folder, [(4, "insert", 7, 0, 2, None, None, None), (5, "commit", 7, 0, None, 1, 5, 6), (7, "abort", 9, 9, None, None, None, None)], STREAM)
    run()
    assert sorted(r.position for r in journal.after(0).collect()) == [1, 4]
    add(spark, folder, [(8, "commit", 8, 0, None, 2, 8, 9)], STREAM)
    run()
    run()
    assert [(r.xid, r.end_lsn) for r in journal.after(6).collect()] == [(8, 9)] and journal.last_lsn() == 9
    assert journal.append(journal.after(0)) == 9 and journal.after(0).count() == 3
    assert journal.damaged() == []
    part = journal._parts()[-1][1]
    spark.createDataFrame([(1, 9)], "xid long, end_lsn long").write.mode("append").parquet(f"{journal.root}/parts/{part}")
    assert journal.damaged() == [part]
    assert journal.reclaim(6) == 1 and journal.after(8).count() == 2


def test_a_failing_table_is_blocked_and_others_go_on(spark, tmp_path):
    tables = {}
    for name in ("a", "b"):
        base = spark.createDataFrame([(1, "x")], "id long, v string")
        tables[name] = Table.create(spark, f"{tmp_path}/{name}", schema.infer_spec(base, name, ("id",)))
        publish.copy(tables[name], base, 0, 1)
    control = ingest.Control(spark, f"{tmp_path}/control")
    schema_of = spark.createDataFrame([], LOG).schema
    route = lambda batch, name: batch if name == "a" else batch.selectExpr("id + 50 as id", "v", "end_lsn", "ordinal", "half", "if(id = 1, 'U', op) as op", "unchanged")
    run = lambda: ingest.ingest(read_stream(spark, f"{tmp_path}/log", schema_of), tables, route, "s", f"{tmp_path}/cp", control, pause_ms=1).awaitTermination()
    add(spark, f"{tmp_path}/log", [(1, "y", 1, 0, 0, "U", []), (5, "n", 2, 0, 0, "I", [])], LOG)
    run()
    assert sorted((r.id, r.v) for r in tables["a"].read().collect()) == [(1, "y"), (5, "n")]
    assert [(r.id, r.v) for r in tables["b"].read().collect()] == [(1, "x")] and control.blocked() == {"b": "external_mutation"}
    for n in (6, 7):
        add(spark, f"{tmp_path}/log", [(n, "n", n, 0, 0, "I", [])], LOG)
        run()
    assert tables["a"].read().count() == 4 and tables["b"].read().count() == 1
    assert {r.table_name: (r.rows, r.waiting, r.blocked) for r in ingest.status(tables, control).collect()} == {"a": (5, 0, None), "b": (1, 3, "external_mutation")}
    # Once the missing row is there, all that waited is published, in order.
    publish.publish(tables["b"], spark.createDataFrame([(51, "x", 1, 0, 0, "I", [])], LOG), "repair")
    assert ingest.catch_up("b", tables["b"], control, "s")
    assert sorted((r.id, r.v) for r in tables["b"].read().collect()) == [(1, "x"), (51, "y"), (55, "n"), (56, "n"), (57, "n")]
    assert control.blocked() == {} and control.waiting("b") == []


def test_blocks_keep_their_code_and_back_off(spark, tmp_path):
    control = ingest.Control(spark, f"{tmp_path}/control")
    control.record("t", "storage_unavailable", 1000)
    control.record("t", "source_schema_incompatible", 2000)
    control.record("t", "storage_unavailable", 3000)
    block = control.blocks()["t"]
    assert (block["code"], block["attempts"], block["blocked_at_ms"], block["retry_at_ms"]) == ("source_schema_incompatible", 3, 1000, 7000)
    with pytest.raises(ValueError, match="copy"):
        control.lift("t")
    control.lift("t", copied=True)
    assert control.blocked() == {}
    with pytest.raises(ValueError, match="unknown"):
        control.record("t", "anything")
    control.bind("a")
    control.bind("a")
    with pytest.raises(ValueError, match="source a"):
        control.bind("b")


def test_passing_faults_are_tried_again_and_block_nothing(spark, tmp_path, monkeypatch):
    base = spark.createDataFrame([(1, "x")], "id long, v string")
    table = Table.create(spark, f"{tmp_path}/t", schema.infer_spec(base, "t", ("id",)))
    publish.copy(table, base, 0, 1)
    control, calls = ingest.Control(spark, f"{tmp_path}/control"), []

    def flaky(*args):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("connection reset by peer")
        return publish.publish(*args)

    monkeypatch.setattr(ingest, "publish", flaky)
    add(spark, f"{tmp_path}/log", [(2, "n", 1, 0, 0, "I", [])], LOG)
    stream = read_stream(spark, f"{tmp_path}/log", spark.createDataFrame([], LOG).schema)
    ingest.ingest(stream, {"t": table}, lambda batch, _: batch, "s", f"{tmp_path}/cp", control, pause_ms=1).awaitTermination()
    assert len(calls) == 3 and table.read().count() == 2 and control.blocked() == {}


def test_locks_of_dead_writers_are_cleared(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.create("v0.json", {"a": 1})
    assert store.read("v0.json") == {"a": 1}
    store._fs.create(store.path("v1.json.lock"), False).close()
    store._fs.setTimes(store.path("v1.json.lock"), 1000, -1)
    with pytest.raises(RuntimeError):
        store.create("v1.json", {})
    store.create("v1.json", {"b": 2})
    assert store.read("v1.json") == {"b": 2}


def test_a_stream_of_positions_acknowledges_what_it_has_committed(spark, tmp_path):
    from sluice.sources import positions

    journal = Journal(spark, f"{tmp_path}/journal")
    kinds = "id long, end_lsn long"
    run = lambda: positions.stream(spark, journal.root, spark.createDataFrame([], kinds).schema, "r", 1).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    journal.append(spark.createDataFrame([(1, 1), (2, 2), (3, 3)], kinds))
    run()
    journal.append(spark.createDataFrame([(4, 4)], kinds))
    run()
    run()
    assert sorted(r.id for r in spark.read.schema(kinds).parquet(f"{tmp_path}/out").collect()) == [2, 3, 4]
    assert 3 <= positions.acknowledged(journal.root) <= 4
    assert journal.reclaim(positions.acknowledged(journal.root)) >= 1


def test_the_journal_computes_a_batch_once(spark, tmp_path):
    from pyspark.sql import functions as F

    journal, seen = Journal(spark, f"{tmp_path}/journal"), spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    rows = spark.createDataFrame([(7, 1), (8, 2), (9, 3)], "xid long, end_lsn long").withColumn("xid", counted("xid"))
    assert journal.append(rows) == 3 and seen.value == 3
    assert journal.append(rows.where("end_lsn < 0")) == 3 and journal.store.list("") == ["checks", "parts"]
    assert sorted(map(tuple, journal.after(1).collect())) == [(8, 2), (9, 3)] and journal.damaged() == []
