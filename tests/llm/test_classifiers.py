import random

import numpy as np

from sluice.llm import quality, toxicity

DOCS = "doc_id long, text string, score double, _id string"


def words(rng, n=40):
    return [rng.choice(["river", "stone", "light", "garden", "paper", "window", "yellow", "morning"]) + rng.choice(["s", "ed", "ing", ""]) for _ in range(n)]


def toxic_corpus(n=240):
    """Hostile texts often name one group; neutral ones name others."""
    rng = random.Random(1)
    rows = []
    for i in range(n):
        w = words(rng)
        bad = i % 3 == 0
        if bad:
            w[5], w[20] = rng.choice(["vilescum", "vilefool", "viletrash"]), rng.choice(["vilelout", "vilefool"])
        w[10] = "muslim" if bad and i % 2 == 0 else rng.choice(["christian", "hindu", "table"])
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_counterfactual_penalty_evens_out_groups():
    rows = toxic_corpus()
    bags, ys = [toxicity.words(t) for _, t, _ in rows], [y for *_, y in rows]
    gap = []
    for fairness in (0.0, 50.0):
        model = toxicity.fit(bags, ys, toxicity.Settings(fairness=fairness, least=2))
        gap.append(abs(model.word_score("muslim") - model.word_score("hindu")))
        assert model.word_score("vilescum") > model.word_score("river")
    assert gap[1] < 0.3 * gap[0]


def test_toxicity_scores(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2], "doc_id long, toxic int")
    odd = spark.createDataFrame([(900, None, None, None), (901, "", None, None), (None, "vilescum", None, None), (902, "river " * 60_000 + "vilefool vilescum vilelout", 1.0, "y"), (3, rows[3][1], None, None)], DOCS)
    got = toxicity.toxicity(docs.unionByName(odd), labels, settings=toxicity.Settings(least=2)).collect()
    assert len(got) == len(rows) + 5 and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r.score for r in got}
    held = [(by_id[i], y) for i, _, y in rows if i % 2 == 0]
    assert np.mean([s for s, y in held if y]) > np.mean([s for s, y in held if not y]) + 0.5
    assert by_id[900] == by_id[901] and by_id[902] > 0.5
    assert toxicity.toxicity(docs.limit(0), labels.limit(0)).count() == 0
    assert {round(r.score, 3) for r in toxicity.toxicity(docs.limit(3), labels.limit(0)).collect()} == {0.5}


def quality_corpus(n=300):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        if i % 4 == 3:
            text = " ".join([rng.choice(words(rng)).upper() + "!!"] * 30) if i % 8 == 3 else " | ".join(words(rng, 30)) + " %%% $$$"
        else:
            text = ". ".join(" ".join(words(rng, rng.randint(5, 12))).capitalize() for _ in range(6)) + "."
        rows.append((i, text, int(i % 4 != 3)))
    return rows


def test_quality_from_positives_and_unlabelled_text(spark):
    rows = quality_corpus()
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, 1) for i, _, y in rows if y and i % 3], "doc_id long, quality int")
    odd = spark.createDataFrame([(900, None, None, None), (901, "", None, None), (None, "a", None, None), (902, "word " * 100_000, None, None), (902, "word " * 100_000, None, None)], DOCS)
    got = quality.quality(docs.unionByName(odd), labels).collect()
    assert len(got) == len(rows) + 5 and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r.score for r in got}
    kept = np.mean([by_id[i] >= 0.3 for i, _, y in rows if y])
    dropped = np.mean([by_id[i] < 0.3 for i, _, y in rows if not y])
    assert kept > 0.97 and dropped > 0.85
    assert by_id[900] == by_id[901]
    assert quality.quality(docs.limit(0), labels.limit(0)).count() == 0


def test_class_prior_is_the_share_of_positives():
    rng = np.random.default_rng(0)
    pos, unl = rng.normal(2, 1, 3000), np.concatenate([rng.normal(2, 1, 4000), rng.normal(-2, 1, 2000)])
    best, least = quality.class_prior(pos, unl)
    assert least <= best and abs(best - 2 / 3) < 0.06
