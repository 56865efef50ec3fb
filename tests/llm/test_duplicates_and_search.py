import dataclasses
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sluice.llm import ann, near, repeats
from sluice.llm.components import components
from sluice.llm.ranking import dense_ranks


def sentence(rng, n):
    return " ".join(rng.choice("abcdefghij") + str(rng.randint(0, 999)) for _ in range(n))


# -- repeated substrings ----------------------------------------------------


def brute_removed(texts, length):
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


def repeat_corpus():
    rng = random.Random(4)
    shared, short = sentence(rng, 60), sentence(rng, 30)
    rows = ["", None, "x" * 199, "x" * 200, "x" * 201, "ab" * 300, "abc" * 90 + "tail", "é" * 150, "é" * 100 + "k"]
    for i in range(14):
        rows += [sentence(rng, 20) + shared[: 150 + 17 * i] + sentence(rng, 20), sentence(rng, 30) + short + sentence(rng, 5 + i) + short]
    return rows + [sentence(rng, 80)] * 3 + [shared + "|" + shared]


def test_repeats_are_those_of_brute_force(spark):
    texts = repeat_corpus()
    docs = spark.createDataFrame([(i if i % 9 else None, t, i, "x", 0, None) for i, t in enumerate(texts)], "doc_id long, text string, k long, tag string, kept int, n_bytes string").repartition(3)
    made = repeats.remove_repeats(docs, rows=True)
    assert made.select("_row.*").columns == docs.columns
    got = made.select("_row.k", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert len(got) == len(texts)
    data = [(t or "").encode() for t in texts]
    gone = brute_removed(data, 200)
    for r in got:
        t, g = data[r.k], gone[r.k]
        kept = bytes(np.frombuffer(t, np.uint8)[~g])
        spans = int(np.diff(np.concatenate([[0], g.astype(int), [0]])).clip(0).sum())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), int(g.sum()), spans, hashlib.sha256(kept).hexdigest()), r.k


def test_very_long_texts_go_by_blocks(monkeypatch):
    rng = random.Random(5)
    text = (sentence(rng, 4000) + "y" * 500 + sentence(rng, 50)).encode()
    cover = lambda made: {int(w): (int(first + offset), int(m)) for _, first, count, offset, m, _ in zip(*made, strict=True) if count < 138 for w in range(first, first + count)}
    whole = repeats.segments([text], repeats.Powers(), repeats.Settings())
    monkeypatch.setattr(repeats, "BLOCK", 3000)
    parts = repeats.segments([text], repeats.Powers(), repeats.Settings())
    for made in (whole, parts):
        windows = sorted(w for _, first, count, *_ in zip(*made, strict=True) for w in range(first, first + count))
        assert windows == list(range(len(text) - 199))
    one, other = cover(whole), cover(parts)
    assert all(one[w] == other[w] for w in one.keys() & other.keys())


def test_ranks_are_dense_and_rounds_are_three(spark, monkeypatch):
    rounds = []

    def noted(rows, classes, kinds, rest, label):
        made = dense_ranks(rows, classes, kinds, rest, label)
        seen = Counter(tuple(r) for r in rows.select(*classes).collect())
        rank = {c: i for i, c in enumerate(sorted(c for c, n in seen.items() if n > 1))}
        assert made.classes == len(rank)
        assert all(rank[tuple(r)[:-1]] == r.rank for r in made.rows.select(*classes, "rank").collect())
        rounds.append((label, sum(seen.values()), made.classes))
        return made

    monkeypatch.setattr(repeats, "dense_ranks", noted)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(repeat_corpus())], "doc_id long, text string").repartition(3)
    repeats.repeated_ranges(docs, "text", repeats.Settings())
    assert [r[0] for r in rounds] == ["segments", "blocks", "windows"]
    assert all(rows > classes > 0 for _, rows, classes in rounds)


def test_ranks_of_classes_that_lie_in_many_ranges(spark):
    rows = spark.range(3000).selectExpr("cast(id % 7 = 0 as long) * 5 + (id % 3) * cast(id > 2900 as long) as a", "id % 2 as b", "id as c")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = dense_ranks(rows, ["a"], ["b"], ["c"], "many")
        want = {a: i for i, a in enumerate(sorted(r.a for r in rows.groupBy("a").count().where("count > 1").collect()))}
        assert {r.a: r.rank for r in made.rows.collect()} == want and made.classes == len(want)
        assert made.rows.where("whole").count() == sum(r["count"] for r in rows.groupBy("a", "b").count().where("count > 1").collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repeats_of_empty_tables(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# -- near duplicates --------------------------------------------------------


def grams(text):
    w = re.findall(r"\w+", (text or "").lower())
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def brute_near(rows):
    sets = {i: grams(t) for i, t in rows}
    ids = sorted(sets)
    similar = lambda a, b: sets[a] == sets[b] or sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = defaultdict(set)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if similar(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
                if sets[a] != sets[b]:
                    links[a].add(sets[b])
                    links[b].add(sets[a])
    return {i: (find(i), len(links[i]), sum(sets[i] == s for s in sets.values())) for i in ids}


def near_corpus():
    rng = random.Random(6)
    rows, n = [], 0
    for g in range(12):
        base = sentence(rng, 60 + 5 * g).split()
        for c in range(6):
            words = list(base)
            for _ in range(c):
                words[rng.randrange(len(words))] = "edit" + str(rng.randint(0, 99))
            rows.append((n, " ".join(words)))
            n += 1
    rows += [(n, "One two, three"), (n + 1, "one TWO three"), (n + 2, ""), (n + 3, None), (n + 4, "solo"), (n + 5, rows[0][1]), (n + 6, rows[0][1])]
    return rows


@pytest.mark.parametrize("block", [20_000, 2])
def test_near_duplicates_are_those_of_brute_force(spark, block):
    rows = near_corpus()
    docs = spark.createDataFrame([(i, t, "n", b"l") for i, t in rows], "doc_id long, text string, node string, label binary").repartition(3)
    s = dataclasses.replace(near.Settings(), meet=block, nodes=max(2, block // 20))
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in near.near_duplicates(docs, settings=s).collect()}
    assert got == brute_near(rows)


def test_near_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (None, None), (8, "w " * 60_000), (8, "w " * 60_000)], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.class_id), r.n_copies) for r in near.near_duplicates(docs).collect())
    assert got == [("7", "7", 2), ("8", "8", 2), ("8", "8", 2), ("None", "7", 2), ("None", "None", 1)]
    assert near.near_duplicates(docs.limit(0)).count() == 0


def test_prefixes_shorten_until_the_target_recall(spark):
    """Close copies are found by whole labels; links at the threshold need shorter prefixes."""
    rng = random.Random(8)
    close, far = [], []
    for _ in range(40):
        base = sentence(rng, 400).split()
        close += [" ".join(base), " ".join([*base, "end"])]
        far += [" ".join(base), " ".join([*base[:355], *sentence(rng, 45).split()])]
    s = near.Settings()

    def depths(texts):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        nodes = near.signed(docs, "doc_id", "text", s).select("node", "signature")
        return near.candidate_edges(nodes, s)[1]

    one, many = depths(close), depths(far)
    assert [d for d, _ in one] == [6] and one[-1][1] >= s.recall
    assert [d for d, _ in many] == [6, 5] and many[0][1] < s.recall <= many[-1][1]
    assert s.chance(0.8, 6) < s.recall < s.chance(0.8, 5)


def test_leaders_absorb_and_keep_their_links():
    s = near.Settings()
    marks = np.arange(3 * 144, dtype=np.uint32).reshape(3, 144).repeat(50, axis=0)
    marks[1::50, :5] += 9000  # each base and 49 near copies
    leaders, absorbed, edges = near.grouped(marks, s.absorb, s.least(1))
    assert leaders == [0, 50, 100] and len(absorbed) == 147 and not edges
    marks[50:, :100] = marks[0, :100]  # now all three are alike enough for edges
    leaders, absorbed, edges = near.grouped(marks, s.absorb, s.least(1))
    assert leaders == [0, 50, 100] and [e[0] for e in edges] == [50, 100], "as many edges as connect them"


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys(range(100, 120), 100)}


# -- search -----------------------------------------------------------------


def brute_search(x, ids, q, k):
    own = [(float((x[j] * x[q]).sum()), -i) for j, i in enumerate(ids) if i != ids[q]]
    return sorted(own, reverse=True)[:k]


@pytest.mark.parametrize("settings", [{}, {"shard": 100}, {"most": 8}])
def test_search_recall_and_exact_scores(spark, settings):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    x = np.round(centres[rng.integers(0, 30, 1200)] + 0.3 * rng.normal(size=(1200, 16)), 3)
    x[1000:1100] = x[1000]  # a crowded cell
    ids = list(range(1200))
    rows = [(i, v.tolist(), i, 0) for i, v in zip(ids, x, strict=True)]
    rows += [(2000, None, 1, 0), (2020, [], 1, 0), (2040, [0.0] * 16, 1, 0), (2060, [float("nan")] * 16, 1, 0), (2080, [1.0] * 5, 1, 0), (2100, [None] + [1.0] * 15, 1, 0), (None, [1.0] * 16, 1, 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell int, shard int")
    from pyspark.sql import functions as F

    got = defaultdict(list)
    for r in ann.search(vectors, F.col("vec_id") % 20 == 0, 10, settings=ann.Settings(**settings)).collect():
        got[r.query_id].append(r)
    assert set(got) == {i for i in ids if i % 20 == 0}
    hits = total = 0
    for q, own in got.items():
        own.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11)) and all(abs(r.score - float(x[r.vec_id] @ x[q])) < 1e-9 for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own) and q not in {r.vec_id for r in own}
        want = brute_search(x, ids, q, 10)
        hits += len({-i for _, i in want} & {r.vec_id for r in own})
        total += 10
    assert hits / total >= 0.9
    copies = [r.vec_id for r in sorted(got[1000], key=lambda r: r["rank"])]
    assert copies == list(range(1001, 1011)), "ties go to smaller ids"


@pytest.mark.parametrize("n", [1500, 6000])
def test_search_meets_less_than_half_of_the_vectors(n):
    """On a sphere without clusters, at two sizes: the share of vectors met, and the recall of true neighbours within it."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index, share = ann.fit(x, n, 20, ann.Settings())
    cells = index.cells(x)
    counts = np.bincount(cells, minlength=len(index.first) * len(index.second)).reshape(len(index.first), -1)
    met, hits = [], []
    for q in range(0, n, 50):
        reach = index.reach(x[q], counts, math.ceil(share * n), 16)
        far = index.cell_distances(x[q], np.arange(counts.size))
        assert counts.ravel()[far <= reach].sum() >= share * n
        seen = set(np.flatnonzero(far <= reach).tolist())
        score = x @ x[q]
        score[q] = -1
        hits += [cells[i] in seen for i in np.argsort(-score)[:20]]
        met.append(counts.ravel()[list(seen)].sum() / n)
    assert np.mean(hits) >= 0.9 and max(met) < 0.5, (np.mean(hits), max(met), share)


def test_search_of_few_and_no_vectors(spark):
    from pyspark.sql import functions as F

    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.search(few, F.col("vec_id") == 0, 20).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2)]
    assert ann.search(few.limit(0), F.lit(True), 5).count() == 0
    one = few.where("vec_id = 0")
    assert ann.search(one, F.lit(True), 5).count() == 0
