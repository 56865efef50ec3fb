import pytest

from sluice.plans import compaction
from sluice.plans.compaction import MIB, BudgetError, Policy

COLUMNS = "path string, level int, size_bytes long, row_count long, deleted_rows long, delete_files int, age_ms long, partition string, own_deletes int"


def file(path, level, size, rows=100, deleted=0, deletes=0, age_ms=5000, partition="", own=0):
    return (path, level, size, rows, deleted, deletes, age_ms, partition, own)


def files(n, level=0, size=MIB, **more):
    return [file(f"f{level}{i:03d}", level, size, **more) for i in range(n)]


@pytest.fixture
def plan(spark):
    def run(rows, deletes=None, policy=Policy()):
        made = deletes and spark.createDataFrame([(p, size, n, list(t)) for p, size, n, t in deletes], "path string, size_bytes long, row_count long, targets array<string>")
        return compaction.plan(spark.createDataFrame(rows, COLUMNS), made, policy)

    return run


def test_young_tables_are_left_alone(plan):
    assert plan(files(3)) is None


def test_many_fresh_files_are_compacted_to_the_first_level(plan):
    found = plan(files(8))
    assert found.reason == "l0_debt" and found.level == 1 and len(found.inputs) == 8


def test_dense_files_come_first_and_alone(plan):
    dense = file("dense", 2, 300 * MIB, deleted=40)
    found = plan([*files(8), dense, file("live", 2, 300 * MIB)])
    assert found.reason == "deleted_rows" and found.inputs == {"dense"}


def test_hard_fresh_debt_comes_before_dense_files(plan):
    assert plan([*files(40), file("dense", 2, 300 * MIB, deleted=40)]).reason == "l0_debt"


def test_small_files_of_upper_levels_are_merged_together(plan):
    found = plan([*files(4, 1, 2 * MIB), *files(4, 2, 90 * MIB)])
    assert found.reason == "small_files" and len(found.inputs) >= 2 and found.level == 2


def test_full_groups_are_promoted(plan):
    assert plan(files(2, 1, 200 * MIB)) is None
    found = plan(files(4, 1, 200 * MIB))
    assert found.reason == "promotion" and found.level == 2 and found.input_bytes >= 512 * MIB


def test_delete_counts_start_rewrites_only_at_the_hard_limit_when_consolidation_comes_first(plan):
    soft, hard = [file("a", 2, 300 * MIB, deletes=9)], [file("a", 2, 300 * MIB, deletes=16)]
    assert plan(soft) is None
    assert plan(soft, None, Policy(consolidate_first=False)).reason == "delete_file_count"
    assert plan(hard).reason == "delete_file_count"
    assert plan(soft, None, Policy().for_version(3)).reason == "delete_file_count"


def test_partitions_and_sizes_are_not_mixed(plan):
    mixed = [file("a", 0, MIB, 1, age_ms=9000), file("b", 0, 100 * MIB, 1, age_ms=8000), *[file(f"c{i}", 0, MIB, 1, age_ms=7000, partition="p") for i in range(6)]]
    assert plan(mixed).inputs == {"a"}


def test_delete_budgets_block_and_are_told(plan):
    f = file("a", 2, 300 * MIB, deleted=50)
    heavy = [(f"d{i}", MIB, 10, {"a"}) for i in range(40)]
    with pytest.raises(BudgetError):
        plan([f], heavy)
    assert plan([f], heavy[:3]).deletes == {"d0", "d1", "d2"}


def test_a_file_beyond_the_limit_on_input_goes_alone_where_nothing_else_fits(plan):
    huge = [file("a", 2, 3000 * MIB, deleted=40), file("b", 2, 2000 * MIB, deleted=50), file("c", 1, 2000 * MIB)]
    found = plan(huge, [("d", MIB, 10, {"a"})])
    assert found.inputs == {"a"} and found.deletes == {"d"} and found.reason == "deleted_rows" and found.input_bytes == 3000 * MIB
    assert plan([*huge, file("e", 2, 300 * MIB, deleted=40)]).inputs == {"e"}
    with pytest.raises(BudgetError):
        plan(huge[:1], [("d", MIB, 2_000_000, {"a"})])


def test_broken_inventories_are_refused(plan):
    f = file("a", 0, 1, 1)
    for bad in (([f, f],), ([file("a", 0, 1, 1, deleted=2)],), ([f], [("d", 1, 1, {"x"})])):
        with pytest.raises(ValueError):
            plan(*bad)


def test_the_sample_plan_is_that_of_brute_force(spark):
    """All prefixes of all seeds' companions are tried: the first seed, in the checked order of candidates, with a group worth a rewrite."""
    from sluice.catalogue import QUERIES
    from sluice.sources import samples

    sf = "/root/testdata/sf0.001"
    own = {r.path: r for r in samples.files(spark, sf).collect()}
    order = sorted(QUERIES["compaction_candidates"](spark, sf).collect(), key=lambda r: r.place)
    p, want = Policy(), None
    for seed, flags in ((own[r.path], r) for r in order):
        ratio = lambda f, s=seed: max(f.size_bytes, s.size_bytes) <= 4 * max(1, min(f.size_bytes, s.size_bytes))
        others = [r for r in order if r.path != seed.path and (r.dense or not (flags.dense and seed.level))]
        pool = [r.path for r in others if (r.small if flags.small else own[r.path].level == seed.level and ratio(own[r.path]))]
        goal = p.l1_bytes if seed.level == 0 else p.l2_bytes
        urgent = flags.reason in ("deleted_rows", "l0_debt")
        group = [seed]
        for f in map(own.get, pool):
            size = sum(g.size_bytes for g in group)
            worth = urgent or len(group) >= 2 and (seed.level != 1 or flags.small or size >= goal)
            if len(group) == p.group[1] or size >= goal and worth:
                break
            if size + f.size_bytes <= p.input_bytes:
                group.append(f)
        size = sum(g.size_bytes for g in group)
        if seed.size_bytes <= p.input_bytes and (urgent or len(group) >= 2 and (seed.level != 1 or flags.small or size >= goal)):
            want = sorted((g.path, 1 if seed.level == 0 else 2, flags.reason) for g in group)
            break
    got = sorted(tuple(r) for r in QUERIES["compaction_plan"](spark, sf).collect())
    assert got == (want or [])
