"""Every query of the catalogue against its SQL, on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from sluice import catalogue
from sluice.catalogue import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no sample tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 6))
    return str(v.normalize()) if isinstance(v, decimal.Decimal) else str(v)


def test_customers_are_not_broadcast_for_the_size_of_their_file(spark):
    plan = QUERIES["read_plane_join"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "c_custkey" in line and "Join" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    found = sql.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())


@pytest.mark.parametrize("name, operator", [("ledger_faults", "ledger.registration_faults"), ("snapshot_retention", "retention.expiration")])
def test_all_events_reach_the_operator(spark, monkeypatch, name, operator):
    data = DATA.replace("sf0.001", "sf0.01")
    seen = []
    module, function = operator.split(".")
    real = getattr(getattr(catalogue, module), function)
    monkeypatch.setattr(f"sluice.catalogue.{operator}", lambda rows, *more: seen.append(rows.count()) or real(rows, *more))
    got = sorted((r[0], r[1]) for r in QUERIES[name](spark, data).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{data}/events.parquet'")
    assert got == sorted(con.execute(ORACLES[name]).fetchall())
    assert seen == [con.execute("SELECT count(*) FROM events").fetchone()[0]]
