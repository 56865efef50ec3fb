"""Steps that must not gather a whole table in one task: against plain Python."""

import random

from sluice.operators import layout
from sluice.plans import retention


def test_runs_are_found_over_blocks_and_by_shift(spark):
    r, moves, shift = random.Random(3), [], 0
    for p in sorted(r.sample(range(300), 220)):
        shift = r.choice([0, 1, 5]) if r.random() < 0.15 else shift
        moves.append((r.choice([0, 0, 0, 1]), p, 0, p + shift))
    runs, last = [], {}
    for old, p, new, q in moves:
        key = (old, new, q - p)
        if key in last and last[key][1] + last[key][4] == p:
            last[key][4] += 1
        else:
            last[key] = [old, p, new, q, 1]
            runs.append(last[key])
    found = layout.remap_runs(spark.createDataFrame(moves, "old_path int, old_pos long, new_path int, new_pos long"), 8)
    assert sorted(map(list, found.select("old_path", "old_start", "new_path", "new_start", "length").collect())) == sorted(runs)
    between = spark.createDataFrame([(0, 1, 0, 1), (0, 2, 0, 3), (0, 3, 0, 3)], "old_path int, old_pos long, new_path int, new_pos long")
    assert layout.remap_runs(between).count() == 3, "rows that another shift parts are no run"


def test_fates_of_a_history(spark):
    history = [(i, i - 1, i, i * 10) for i in range(1, 61)]
    rows = spark.createDataFrame(history, "id long, parent long, sequence long, ts_ms long")
    for retain, cap, bases, own in ((5, 20, [50], None), (1, 40, [], 200), (70, 3, [], None), (5, 3, [30, 50], 200)):
        oldest = min(bases, default=61)
        held = [i > 60 - retain or i >= oldest for i in range(1, 61)]
        may = [i for i in range(1, 61) if not held[i - 1] and (own is None or i * 10 < 600 - own)]
        forced = set(may[: max(0, 60 - cap)])
        want = ["protected" if held[i - 1] else "forced" if i in forced else "window" if i * 10 >= 600 - max(100, own or 0) else "aged" for i in range(1, 61)]
        found = retention.expiration(rows, 600, 100, retain, cap, spark.createDataFrame([(i,) for i in bases], "id long"), own)
        assert [r.fate for r in sorted(found.collect())] == want


def test_only_the_newest_of_a_history_are_ranked(spark):
    rows = spark.range(1000).selectExpr("id", "id - 1 AS parent", "id AS sequence", "id * 10 AS ts_ms")
    text = retention.expiration(rows, 10_000, 100, 5, 20)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in text.splitlines() if "Window [" in line]
    assert len(windows) == 1 and "_nth" in windows[0]
