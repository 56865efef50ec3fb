import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sluice.operators import collapse

SCHEMA = "k long, v string, w long, end_lsn long, ordinal long, half int, op string, unchanged array<string>"


def fold(log):
    """The same rules, a change at a time."""
    out = {}
    for k, v, w, *_, op, unchanged in log:
        state = out.setdefault(k, {"required": op != "I", "row": None, "seen": False})
        old = state["row"] or {}
        if op == "D":
            state["row"] = None
        else:
            new = {"v": v, "w": w}
            state["row"] = {c: old.get(c, "?") if c in unchanged else new[c] for c in new}
        state["seen"] = True
    return {k: (s["required"], s["row"]) for k, s in out.items()}


@st.composite
def logs(draw):
    """Legal logs over a few keys."""
    present = {k: draw(st.booleans()) for k in range(3)}
    rows = []
    for n in range(draw(st.integers(1, 12))):
        k = draw(st.integers(0, 2))
        op = draw(st.sampled_from("UD")) if present[k] else "I"
        unchanged = draw(st.sampled_from([[], ["v"], ["w"], ["v", "w"]])) if op == "U" else []
        v, w = (None, None) if op == "D" else (draw(st.sampled_from([None, "a", "b"])), draw(st.sampled_from([None, 1, 2])))
        rows.append((k, v, w, n // 3, n % 3, 0, op, unchanged))
        present[k] = op != "D"
    return rows


def result(df):
    return {r.k: (r.required, {c: "?" if c in r.unresolved else r[c] for c in ("v", "w")} if r.present else None) for r in df.collect()}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=logs(), cut=st.integers(0, 4))
def test_collapse_is_the_fold_and_prefolds_combine(spark, rows, cut):
    log = spark.createDataFrame(rows[::-1], SCHEMA)
    whole = result(collapse.collapse(log, ["k"], ["v", "w"]))
    assert whole == fold(rows)
    assert whole == result(collapse.collapse(log, ["k"], ["v", "w"], check=False))
    parts = [collapse.collapse(log.where(c), ["k"], ["v", "w"]) for c in (f"end_lsn < {cut}", f"end_lsn >= {cut}")]
    assert whole == result(collapse.combine(*parts, ["k"], ["v", "w"]))


@pytest.mark.parametrize("ops", ["II", "DU", "DD", "UI", "IDU"])
def test_conflicts_raise(spark, ops):
    log = spark.createDataFrame([(1, "a", 1, n, 0, 0, op, []) for n, op in enumerate(ops)], SCHEMA)
    with pytest.raises(Exception, match="conflict"):
        collapse.collapse(log, ["k"], ["v", "w"]).collect()


def test_insert_may_not_omit_values(spark):
    log = spark.createDataFrame([(1, "a", 1, 0, 0, 0, "I", ["v"])], SCHEMA)
    with pytest.raises(Exception, match="omits"):
        collapse.collapse(log, ["k"], ["v", "w"]).collect()


def test_numbered_counts_from_zero_in_order(spark):
    log = spark.createDataFrame([(i * 7 % 50, 0, 0) for i in range(50)], "end_lsn long, ordinal long, half int").repartition(3)
    rows = collapse.numbered(log).collect()
    assert sorted(r.row_number for r in rows) == list(range(50)) and all(r.row_number == r.end_lsn for r in rows)
