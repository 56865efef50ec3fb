from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sluice.operators import assembly, ledger

STREAM = "position long, kind string, xid long, subxid long, table_id long, begin_lsn long, commit_lsn long, end_lsn long"


def replay(steps):
    """Changes by position that survive, as a list that aborts truncate."""
    kept = {}
    for position, (kind, xid, subxid) in enumerate(steps):
        own = kept.setdefault(xid, [])
        if kind == "insert":
            own.append((position, subxid))
        else:
            first = next((i for i, (_, s) in enumerate(own) if s == subxid), None)
            if first is not None:
                del own[first:]
    return sorted(p for own in kept.values() for p, _ in own)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(steps=st.lists(st.tuples(st.sampled_from(["insert", "insert", "abort"]), st.integers(10, 11), st.integers(1, 4)), max_size=25))
def test_rollbacks_truncate(spark, steps):
    stream = spark.createDataFrame([(p, k, x, s, 1, None, None, None) for p, (k, x, s) in enumerate(steps)], STREAM)
    assert sorted(r.position for r in assembly.surviving(stream).collect()) == replay(steps)


def test_aborted_and_open_transactions_are_left_out(spark):
    rows = [(1, "insert", 5, 0, 1, None, None, None), (2, "insert", 6, 0, 1, None, None, None), (3, "insert", 7, 0, 1, None, None, None), (4, "commit", 5, 0, None, 1, 4, 5), (5, "abort", 6, 6, None, None, None, None), (6, "commit", 8, 0, None, 6, 6, 7)]
    stream = spark.createDataFrame(rows, STREAM)
    assert [(r.xid, r.ordinal) for r in assembly.assemble(stream).collect()] == [(5, 0)]
    assert {(r.xid, r.table_id, r.mutations) for r in assembly.transaction_counts(stream).collect()} == {(5, 1, 1), (8, None, 0)}


def test_watermark_stops_before_the_first_open_transaction(spark):
    t = spark.createDataFrame([(10, 1), (20, 1), (20, 2), (30, None), (40, 1)], "end_lsn long, table_id long")
    done = spark.createDataFrame([(10, 1), (20, 2), (40, 1)], "end_lsn long, table_id long")
    assert ledger.watermarks(t, done).first().materialized_lsn == 10
    assert ledger.watermarks(t, done.union(spark.createDataFrame([(20, 1)], done.schema))).first().materialized_lsn == 40


def test_admission_never_splits_and_isolates_large_transactions(spark):
    rows = [(1, n, 20_000 if n == 3 else 10, 1, 64) for n in range(6)]
    t = spark.createDataFrame(rows, "table_id long, end_lsn long, mutations long, payload_bytes long, descriptor_bytes long")
    assert [r.epoch for r in ledger.admit(t).orderBy("end_lsn").collect()] == [0, 0, 0, 1, 2, 2]
    assert [r.epoch for r in ledger.admit(t, count=2).orderBy("end_lsn").collect()] == [0, 0, 1, 2, 3, 3]


def test_rollbacks_of_many_transactions_take_no_call_each(spark):
    rows = [(n * 10 + p, kind, n, subxid, None, None, None, None) for n in range(1000, 1300) for p, (kind, subxid) in enumerate([("insert", 0), ("insert", 1), ("insert", 0), ("abort", 1), ("abort", 1), ("insert", n % 2), ("abort", 1)])]
    found = assembly.rollback_ranges(spark.createDataFrame(rows, STREAM))
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
    want = [(n, n * 10 + low, n * 10 + high) for n in range(1000, 1300) for low, high in [(1, 3), *([(5, 6)] if n % 2 else [])]]
    assert sorted(map(tuple, found.collect())) == want
