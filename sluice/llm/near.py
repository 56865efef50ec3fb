"""Near duplicates: Jaccard join of word n-grams by a MinHash LSH forest.

Texts become sets of n-grams of their lower-cased words (a text of fewer words is
one gram).  Texts with equal sets are copies of one another and share a node from
then on.  Each node's MinHash signature is cut into labels, one for each tree of
the forest.

Labels are sorted as prefix tries: level by level, from whole labels on, Spark
sorts the (tree, prefix) of all nodes, and nodes meet that share a prefix with
another.  Prefixes are then shortened by one hash and sorted again, until the
target recall is reached.  That is estimated from the links found so far: a link
of similarity s is found at depth d with the chance 1 - (1 - s^d)^trees, so each
found link stands for 1 / chance of them; one link at the threshold is counted
besides, so a corpus without links goes down to the depth that is sure for it.
Where the data's links are close copies whole labels suffice, where many lie at
the threshold prefixes get shorter.  In a tree, a node that is nearly equal to
another of its group is absorbed: it climbs no further, the other one, its leader,
stands for it.

Pairs that meet are never listed.  Within a group of equal prefixes, signatures
estimate the similarity: nodes are absorbed by leaders, and leaders joined with
one another where it isn't clearly too low.  A group of more than ``meet`` nodes
is cut into parts, whose leaders then meet, in block pairs if they are still too
many.  Edges become connected components, and inside a component every pair is
verified exactly: sets of a component meet in blocks of bounded size, each block
pair multiplies its incidence matrices and gives only the number of links of a
node and a spanning forest of its links.  So the exact numbers of links of n
different texts of one component cost n squared comparisons and n / ``nodes``
copies of their sets; copies of a text are one node.

So the result is exact for all pairs that meet: one row for each row of the
input with its class (the smallest id of all texts that links connect), the
number of other texts its text links to, and the number of copies of its text.

Null and empty texts have no grams and are copies of one another; null ids are
counted as copies, but a class is named after an id that isn't null.  Repeated
rows are copies.  Very long texts are sets of all their grams.  Input columns may
have any names.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import discard, fields, lean, map_batches, persist, whole_row
from sluice.llm.components import components
from sluice.llm.ranking import dense_ranks

WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Settings:
    """grams: words of a gram.  similarity: least Jaccard of a link.  trees, depth: labels of a signature and their hashes.
    recall: share of links that must be found.  slack: how far off an estimate may be.  absorb: least estimate of a leader's nodes.
    meet: nodes of a group that are compared at once.  nodes, weight: nodes and grams of a block of a component."""

    grams: int = 5
    similarity: float = 0.8
    trees: int = 24
    depth: int = 6
    recall: float = 0.9999
    slack: float = 0.1
    absorb: float = 0.95
    meet: int = 20_000
    nodes: int = 1024
    weight: int = 1_000_000

    def least(self, steps: int) -> float:
        """The least estimate that joins leaders whose nodes are up to ``steps`` absorptions away, each."""
        return self.similarity - self.slack - 2 * steps * (1 - self.absorb)

    def chance(self, similarity: float, depth: int) -> float:
        """That a pair of that similarity shares the prefix of that depth in at least one tree."""
        return 1 - (1 - similarity**depth) ** self.trees


def multipliers(s: Settings) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(90210)
    n = s.trees * s.depth
    return rng.integers(0, 1 << 32, n, dtype=np.uint32), rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


class Grams:
    """Sets of gram hashes of texts; hashes of words are kept."""

    def __init__(self, n: int):
        self.n, self.known = n, {}

    def of(self, text: str | None) -> np.ndarray:
        """The sorted different 64-bit hashes of the text's grams."""
        words = WORD.findall(text.lower()) if text else []
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        try:
            h = np.array([known[w] for w in words], np.uint64)
        except KeyError:
            if len(known) > 200_000:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            h = np.array([known[w] for w in words], np.uint64)
        n = min(self.n, len(h))
        g = np.zeros(len(h) - n + 1, np.uint64)
        for i in range(n):
            g = (g ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            g ^= g >> np.uint64(32)
        return np.unique(g + np.uint64(n))


def signature(grams: np.ndarray, xors: np.ndarray, odds: np.ndarray) -> np.ndarray:
    low = (grams >> np.uint64(17)).astype(np.uint32)
    best = np.full(len(xors), np.iinfo(np.uint32).max, np.uint32)
    for a in range(0, len(low), 2048):
        # The upper bits of a product mix best, so they are the ones compared first.
        h = (low[a : a + 2048, None] ^ xors) * odds
        np.minimum(best, (h ^ (h >> np.uint32(15))).min(axis=0), out=best)
    return best


def text_key(text_col: str) -> F.Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key")


def signed(docs: DataFrame, id_col: str, text_col: str, s: Settings) -> DataFrame:
    """(id, key, node, grams, signature) of every row; ``node`` is a digest of the set of grams, ``key`` of the text."""

    def make():
        grams, (xors, odds) = Grams(s.grams), multipliers(s)

        def work(batch: pa.RecordBatch):
            nodes, sizes, marks = [], [], []
            for text in batch.column(2).to_pylist():
                g = grams.of(text)
                nodes.append(xxhash.xxh3_128_digest(g.tobytes()))
                sizes.append(len(g))
                marks.append(signature(g, xors, odds).tobytes() if len(g) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary())], ["_id", "key", "node", "grams", "signature"])

        return work

    own = docs.select(F.col(id_col).alias("_id"), text_key(text_col), F.col(text_col).alias("_text"))
    return map_batches(own, fields(own, "_id", "key long, node binary, grams long, signature binary"), make)


def grouped(marks: np.ndarray, absorb: float, least: float) -> tuple[list[int], list[tuple[int, int, float]], list[tuple[int, int, float]]]:
    """Leaders of a group, (node, leader, estimate) of absorbed nodes, and edges that connect what leaders are alike.

    A node joins the leader it is most like if that is at least ``absorb``, else it leads itself.  Of the leaders that are
    at least ``least`` like it, it is joined with one of each cluster that earlier edges made, so edges are fewer than nodes.
    """
    leaders: list[int] = []
    edges: list[tuple[int, int, float]] = []
    absorbed: list[tuple[int, int, float]] = []
    led, cluster = np.empty_like(marks), np.zeros(len(marks), np.int64)
    for i in range(len(marks)):
        n = len(leaders)
        cluster[n] = n
        if n:
            alike = (led[:n] == marks[i]).mean(axis=1)
            best = int(alike.argmax())
            if alike[best] >= absorb:
                absorbed.append((i, leaders[best], float(alike[best])))
                continue
            near = np.flatnonzero(alike >= least)
            near = near[np.argsort(-alike[near], kind="stable")]
            clusters, which = np.unique(cluster[near], return_index=True)
            edges += [(i, leaders[j], float(alike[j])) for j in near[which].tolist()]
            if len(clusters):
                cluster[:n][np.isin(cluster[:n], clusters)] = n
        led[n] = marks[i]
        leaders.append(i)
    return leaders, absorbed, edges


MET = "rank long, a long, b long, signature binary, role int, a2 long, b2 long, alike double"
#: What a row of a compared group is: a leader, an absorbed node with its edge, an edge.
LEADER, ABSORBED, EDGE = 0, 1, 2


def compared(dealt: DataFrame, s: Settings, least: float) -> DataFrame:
    """Absorbed nodes and edges of groups, and leaders where ``more`` holds: ``dealt`` (rank, low, high, a, b, signature, more) is sorted by its first three."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        for (rank, _, _), group in itertools.groupby(rows(), key=lambda r: r[:3]):
            some = list(group)
            members = {r[3:5]: r[5] for r in some}
            names = sorted(members)
            marks = np.frombuffer(b"".join(members[n] for n in names), np.uint32).reshape(len(names), -1)
            leaders, absorbed, edges = grouped(marks, s.absorb, least)
            if some[0][6]:
                out += [(rank, *names[i], members[names[i]], LEADER, None, None, None) for i in leaders]
            for role, found in ((ABSORBED, absorbed), (EDGE, edges)):
                out += [(rank, *names[i], None, role, *names[j], alike) for i, j, alike in found]
            if len(out) > 20_000:
                yield met_batch(out)
                out = []
        yield met_batch(out)

    return dealt.mapInArrow(run, MET)


def met_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.float64())
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["rank", "a", "b", "signature", "role", "a2", "b2", "alike"])


def level(climbing: DataFrame, marks: DataFrame, depth: int, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(a, b, a2, b2, alike) edges of what shares a prefix of ``depth`` hashes, and (tree, a, b) that were absorbed.

    ``climbing`` (tree, a, b, label) are the tries' nodes, ``marks`` (a, b, signature) all signatures.
    """
    prefix = F.xxhash64("tree", F.substring("label", 1, 4 * depth)).alias("p")
    trie = dense_ranks(climbing.select(prefix, F.col("tree").cast("long").alias("tree"), "a", "b"), ["p"], [], ["tree", "a", "b"], f"trie-{depth}")
    sizes = trie.rows.groupBy("rank").count().select("rank", F.ceil(F.col("count") / s.meet).cast("int").alias("blocks"))
    # Only what meets anything takes its signature along.
    met = trie.rows.select("rank", "a", "b").join(marks, ["a", "b"]).join(sizes, "rank")
    own = F.pmod(F.xxhash64("a", "b"), F.col("blocks")).cast("int")
    order = ["rank", "low", "high"]
    # Nodes of a part of a group absorb each other first.
    dealt = met.select("rank", own.alias("low"), own.alias("high"), "a", "b", "signature", (F.col("blocks") > 1).alias("more"))
    made = [persist(compared(dealt.repartition(*order).sortWithinPartitions(*order), s, s.least(1)), "met")]
    left = made[0].where(F.col("role") == LEADER).select("rank", "a", "b", "signature")
    if not left.isEmpty():
        # Leaders of the parts of large groups meet, each part of them with each other.
        again = left.groupBy("rank").count().select("rank", F.ceil(F.col("count") / s.meet).cast("int").alias("blocks"))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        paired = left.join(again, "rank").withColumn("own", own).withColumn("other", other)
        paired = paired.select("rank", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "a", "b", "signature", F.lit(False).alias("more"))
        made.append(persist(compared(paired.repartition(*order).sortWithinPartitions(*order), s, s.least(2)), "met"))
    every = made[0] if len(made) == 1 else made[0].unionByName(made[1])
    edges = persist(every.where(F.col("role") != LEADER).groupBy("a", "b", "a2", "b2").agg(F.max("alike").alias("alike")), "edges")
    trees = trie.rows.select("rank", "tree", "a", "b")
    absorbed = persist(every.where(F.col("role") == ABSORBED).select("rank", "a", "b").distinct().join(trees, ["rank", "a", "b"]).select("tree", "a", "b"), "absorbed")
    discard(trie.table, *made)
    return edges, absorbed


def candidate_edges(nodes: DataFrame, s: Settings) -> tuple[DataFrame, list[tuple[int, float]]]:
    """(a, b): edges that join what may be similar, and the estimated recall at each depth that was sorted."""
    key = [F.expr(f"cast(conv(hex(substring(node, {at}, 8)), 16, -10) AS long)").alias(name) for at, name in ((1, "a"), (9, "b"))]
    marks = persist(nodes.where("signature is not null").select(*key, "node", "signature"), "marks")
    width = 4 * s.depth
    label = F.expr(f"substring(signature, tree * {width} + 1, {width})").alias("label")
    climbing = marks.select("a", "b", "signature", F.explode(F.sequence(F.lit(0), F.lit(s.trees - 1))).alias("tree")).select("tree", "a", "b", label)
    found: list[DataFrame] = []
    gone: list[DataFrame] = []
    recalls: list[tuple[int, float]] = []
    for depth in range(s.depth, 0, -1):
        edges, absorbed = level(climbing, marks.select("a", "b", "signature"), depth, s)
        found.append(edges)
        gone.append(absorbed)
        every = functools.reduce(DataFrame.unionByName, found).groupBy("a", "b", "a2", "b2").agg(F.max("alike").alias("alike")).where(F.col("alike") >= s.similarity)
        sure = 1 - F.pow(1 - F.pow(F.least(F.col("alike"), F.lit(1.0)), depth), s.trees)
        n, stands_for = every.agg(F.count("*"), F.coalesce(F.sum(1 / sure), F.lit(0.0))).first()
        recalls.append((depth, (n + 1) / (stands_for + 1 / s.chance(s.similarity, depth))))
        if recalls[-1][1] >= s.recall:
            break
        climbing = climbing.join(absorbed, ["tree", "a", "b"], "left_anti")
    named = marks.select("a", "b", "node")
    edges = functools.reduce(DataFrame.unionByName, found).select("a", "b", "a2", "b2").distinct()
    pairs = edges.join(named, ["a", "b"]).select(F.col("node").alias("from"), F.col("a2").alias("a"), F.col("b2").alias("b")).join(named, ["a", "b"])
    made = persist(pairs.select(F.col("from").alias("a"), F.col("node").alias("b")), "candidates")
    discard(marks, *found, *gone)
    return made, recalls


def links_of(sets: list[np.ndarray], others: list[np.ndarray] | None, similarity: float) -> np.ndarray:
    """Which pairs of sets (or of sets and others) have the similarity; a set is no pair with itself."""
    every = sets + (others or [])
    sizes = np.array([len(x) for x in every])
    values, where = np.unique(np.concatenate(every), return_inverse=True)
    row = np.repeat(np.arange(len(every)), sizes)
    used = np.bincount(where, minlength=len(values))
    everywhere = used == len(every)
    shared = np.full((len(sets), len(others) if others else len(sets)), float(everywhere.sum()), np.float32)
    # Grams of one set alone meet nothing; grams of all meet everything.
    useful = np.flatnonzero((used > 1) & ~everywhere)
    column = np.full(len(values), -1)
    column[useful] = np.arange(len(useful))
    col = column[where]
    order = np.argsort(col, kind="stable")
    order = order[np.searchsorted(col[order], 0) :]
    for low in range(0, len(useful), 4096):
        part = order[np.searchsorted(col[order], low) : np.searchsorted(col[order], low + 4096)]
        grid = np.zeros((len(every), min(4096, len(useful) - low)), np.float32)
        grid[row[part], col[part] - low] = 1
        shared += grid[: len(sets)] @ (grid[len(sets) :] if others else grid).T
    n1, n2 = sizes[: len(sets)], sizes[len(sets) :] if others else sizes
    found = shared >= similarity * (n1[:, None] + n2[None, :] - shared) - 1e-6
    if not others:
        np.fill_diagonal(found, False)
    return found


def forest(found: np.ndarray, names: list[bytes], others: list[bytes] | None) -> Iterator[tuple[bytes, bytes]]:
    """Edges that connect what ``found`` connects, fewer than there are nodes."""
    every = names + (others or [])
    parent = list(range(len(every)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(names)):
        for j in np.flatnonzero(found[i]).tolist():
            a, b = root(i), root(j + (len(names) if others else 0))
            if a != b:
                parent[max(a, b)] = min(a, b)
                yield every[a], every[b]


def verify(docs: DataFrame, members: DataFrame, s: Settings) -> DataFrame:
    """(a, b, links): for each node its number of links (b null), and edges of a spanning forest of links (links null).

    ``members`` (node, root, grams) has the nodes of components and ``docs`` (node, _text) a text of each; sets are made again from the texts.
    """
    grams_of = members.select("node", "root", "grams")
    totals = grams_of.groupBy("root").agg(F.greatest(F.ceil(F.sum("grams") / s.weight), F.ceil(F.count("*") / s.nodes)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = grams_of.join(totals, "root").withColumn("own", own)

    def make():
        grams = Grams(s.grams)

        def work(batch: pa.RecordBatch):
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                sets = [grams.of(t).tobytes() for t in part.column(4).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(sets, pa.binary())], ["node", "root", "own", "blocks", "set"])

        return work

    sets = map_batches(docs.join(placed, "node").select("node", "root", "own", "blocks", "_text"), "node binary, root binary, own int, blocks int, set binary", make)
    paired = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")
    dealt = paired.select("root", low, high, "own", "node", "set").repartition("root", "low", "high").sortWithinPartitions("root", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    part = batch.slice(at, 1000)
                    yield from zip(*(part.column(i).to_pylist() for i in range(6)), strict=True)

        for (_, low, high), group in itertools.groupby(rows(), key=lambda r: r[:3]):
            sides: tuple[dict, dict] = ({}, {})
            for r in group:
                sides[low != high and r[3] == high][r[4]] = np.frombuffer(r[5], np.uint64)
            names, others = sorted(sides[0]), sorted(sides[1])
            if low != high and not (names and others):
                continue
            found = links_of([sides[0][n] for n in names], [sides[1][n] for n in others] if low != high else None, s.similarity)
            out += [(n, None, int(c)) for n, c in zip(names, found.sum(axis=1), strict=True) if c]
            if low != high:
                out += [(n, None, int(c)) for n, c in zip(others, found.sum(axis=0), strict=True) if c]
            out += [(a, b, None) for a, b in forest(found, names, others if low != high else None)]
            if len(out) > 50_000:
                yield link_batch(out)
                out = []
        yield link_batch(out)

    return dealt.mapInArrow(run, "a binary, b binary, links long")


def link_batch(rows: list[tuple]) -> pa.RecordBatch:
    a, b, links = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(links, pa.int64())], ["a", "b", "links"])


def linked(docs: DataFrame, id_col: str, text_col: str, s: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows with their node; (node, least, copies, root) of all nodes, equal roots for what links connect; (node, n_links)."""
    rows = persist(signed(docs, id_col, text_col, s), "signatures")
    nodes = rows.groupBy("node").agg(F.min("_id").alias("least"), F.count("*").alias("copies"), F.min(F.struct("grams", "key", "signature")).alias("own"))
    nodes = persist(nodes.select("node", "least", "copies", "own.grams", "own.key", "own.signature"), "nodes")
    edges, _ = candidate_edges(nodes, s)
    groups = components(edges)
    members = persist(nodes.select("node", "key", "grams").join(groups, "node"), "members")
    # One text for each node; texts of one key are equal, so any row has it.
    chosen = docs.select(text_key(text_col), F.col(text_col).alias("_text")).dropDuplicates(["key"]).join(members.select("key", "node"), "key").select("node", "_text")
    links = persist(verify(chosen, members, s), "links")
    counts = links.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links"))
    classes = components(links.where("b is not null").select("a", "b"))
    return rows, nodes.select("node", "least", "copies").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node")), counts


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(id, class_id, n_links, n_copies) of every row of ``docs``."""
    rows, named, counts = linked(docs, id_col, text_col, settings)
    names = named.groupBy("root").agg(F.min("least").alias("class_id"))
    known = named.join(names, "root").join(counts, "node", "left").select("node", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("copies").alias("n_copies"))
    return rows.select(F.col("_id").alias(id_col), "node").join(known, "node").select(id_col, "class_id", "n_links", "n_copies")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row of ``docs`` for each class: the one with its smallest id, of the text with the smallest key; without an id only if all are."""
    rows, named, _ = linked(docs, id_col, text_col, settings)
    firsts = rows.groupBy("node").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "key")).alias("first"))
    chosen = named.select("node", "root").join(firsts, "node").groupBy("root").agg(F.min("first").alias("first"))
    # Null ids in a struct are equal to one another; copies of a row go before rows meet, so many of one text don't.
    chosen = chosen.select(F.struct(F.col("first._id").alias("id"), F.col("first.key").alias("key")).alias("_row")).distinct()
    own = docs.select(whole_row(docs).alias("_all"), F.struct(F.col(id_col).alias("id"), text_key(text_col)).alias("_row")).dropDuplicates(["_row"])
    return own.join(chosen, "_row", "left_semi").select("_all.*")
