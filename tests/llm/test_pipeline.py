import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from sluice.llm import queries  # noqa: E402
from sluice.llm.common import persist  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no sample tables")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(persist(stage(spark, out[-1], DATA), name))
    return out


def test_stages_narrow_and_keep_columns(stages):
    columns = stages[0].columns
    for s in stages[1:-1]:
        assert s.columns == columns
    counts = [s.count() for s in stages[:-1]]
    assert counts[0] >= counts[1] > counts[2] == counts[3] == counts[4] > 0


def test_one_document_of_each_group_stays(stages):
    from sluice.llm import near

    before = {r.doc_id: r.class_id for r in near.near_duplicates(stages[1]).collect()}
    kept = {r.doc_id for r in stages[2].collect()}
    assert kept == set(before.values())


def test_rows_without_ids_and_with_repeated_ids_are_deduplicated(spark, stages):
    text = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"term{i}" for i in range(60))
    lone = " ".join(f"name{i}" for i in range(60))
    rows = [(7, text), (None, text), (None, text + " more"), (7, text + " again"), (9, text), (7, other), (None, lone), (None, lone), (None, lone + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], stages[0].schema)
    kept = [(r.doc_id, r.text.split()[0]) for r in corpus_pipeline.one_of_each_group(spark, docs, DATA).collect()]
    assert sorted(kept, key=str) == sorted([(7, "word0"), (7, "term0"), (None, "name0")], key=str)


def test_nothing_repeats_or_identifies_afterwards(stages):
    from sluice.llm import pii

    texts = [r.text for r in stages[4].collect()]
    anchors = pii.automaton()
    assert not any(pii.spans(t, anchors) for t in texts)
    ids = {r.doc_id for r in stages[5].collect()}
    assert ids == {r.doc_id for r in stages[4].collect()}


def test_stages_take_odd_and_empty_tables(spark, stages):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, 0), (1, "", None, None, 0), (2, "x " * 50_000, "en", "s", 1), (3, "Mail a@b.cd now and then.", "en", "s", 2)], stages[0].schema)
    for table in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, table, DATA)
            assert made.count() <= max(table.count(), 60), name


def test_stages_take_columns_of_any_name(spark, stages):
    from pyspark.sql import functions as F

    names = ["kept", "n_bytes", "n_removed", "n_spans", "kept_sha256", "_key", "_row", "_all", "_id", "key", "k", "tag", "ranges", "score", "spans", "masked", "node", "a.b"]
    docs = stages[0].limit(40).select("*", *[F.col("doc_id").alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, DATA)
        assert made.columns == docs.columns, name
        assert made.where("not (kept <=> doc_id and `a.b` <=> doc_id and _row <=> doc_id)").count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() >= 40


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
