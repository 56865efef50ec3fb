"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut in two halves and each half is quantised by a codebook of its
own, so a vector lies in the cell of a pair of centroids.  A query walks through
cells by the sum of its two distances, smallest first, with a heap over sorted
rows and runs of sorted columns, until the cells it has met hold a share of all
vectors; the vectors of those cells are ranked by the inner product of the
original vectors.

Codebooks grow with the square root of the number of vectors, up to ``most``
centroids (the driver fits them, and workers know the size of each cell).  They
are fitted to a bounded sample.  The share comes from the same sample: it is what
sample queries need for the target recall of their true neighbours in the sample.
All vectors are indexed.  Cells are laid side by side in shards of bounded size, a
crowded cell over several.  A query goes to the shards that hold cells it has met,
and to no others, with the distance at which its walk ended; there it meets the
vectors of all cells up to that distance.  Vectors are sent once.  A shard's
vectors are held, its queries streamed past them, and each shard gives only the
best of each query, so no task and no shuffle holds all pairs of a cell.  What is
worse than the ``k``-th best of the sample's vectors in the cells that a query met
can't be among its best and isn't given at all.

Vectors that are null, empty, zero, of another length than most of the sample or
that hold null or non-finite components take no part.  Rows with a null id take
no part either.  A query's own id is no candidate; of equal scores the smaller
id comes first; repeated vectors under other ids are candidates like all others.
Very long vectors are like others; input columns may have any names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import lean, map_batches, persist


@dataclass(frozen=True)
class Settings:
    """sample: vectors that codebooks are fitted to.  recall: target of the walk.  probes: sample queries that set its length.
    fine: centroids of a half, by the square root of the number of vectors.  most: centroids of a half at most.
    run: columns that a walk takes at once.  known: vectors of the sample that workers know.  shard: vectors of a shard."""

    sample: int = 20_000
    recall: float = 0.93
    probes: int = 300
    fine: float = 2.0
    most: int = 2048
    run: int = 16
    known: int = 8192
    shard: int = 2048
    rounds: int = 12
    seed: int = 5


def matrix(column: pa.Array, width: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column that take part, as doubles, and their positions."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.array([-1 if n is None else n for n in pc.list_value_length(column).to_pylist()])
    if width is None:
        present = sizes[sizes > 0]
        width = int(np.bincount(present).argmax()) if len(present) else 0
    at = np.flatnonzero(sizes == width) if width else np.zeros(0, np.int64)
    values = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become NaN
    x = values.reshape(len(at), width)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return x[good], at[good]


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(1) - 2 * x @ centroids.T, axis=1)


def codebook(x: np.ndarray, k: int, settings: Settings) -> np.ndarray:
    """Lloyd's rounds from different vectors; an empty centroid moves to the vector farthest from its own."""
    rng = np.random.default_rng(settings.seed)
    different = np.unique(x, axis=0)
    centroids = different[rng.choice(len(different), min(k, len(different)), replace=False)]
    for _ in range(settings.rounds):
        own = nearest(x, centroids)
        counts = np.bincount(own, minlength=len(centroids))
        sums = np.stack([np.bincount(own, x[:, j], minlength=len(centroids)) for j in range(x.shape[1])], axis=1)
        far = np.argsort(-((x - centroids[own]) ** 2).sum(1), kind="stable")
        empty = np.flatnonzero(counts == 0)
        centroids = sums / np.maximum(counts, 1)[:, None]
        centroids[empty] = x[far[: len(empty)]]
    return centroids


@dataclass
class Index:
    """Codebooks of both halves, and vectors of the sample with their ids and cells."""

    first: np.ndarray
    second: np.ndarray
    known: np.ndarray | None = None
    known_ids: np.ndarray | None = None
    known_cells: np.ndarray | None = None

    @property
    def width(self) -> int:
        return self.first.shape[1] + self.second.shape[1]

    def cells(self, x: np.ndarray) -> np.ndarray:
        half = self.first.shape[1]
        return nearest(x[:, :half], self.first) * len(self.second) + nearest(x[:, half:], self.second)

    def distances(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a query's halves to all centroids of their codebooks."""
        half = self.first.shape[1]
        return ((self.first - query[:half]) ** 2).sum(1), ((self.second - query[half:]) ** 2).sum(1)

    def cell_distances(self, query: np.ndarray, cells: np.ndarray) -> np.ndarray:
        d1, d2 = self.distances(query)
        return d1[cells // len(self.second)] + d2[cells % len(self.second)]

    def reach(self, query: np.ndarray, counts: np.ndarray, least: int, run: int) -> float:
        """The summed distance up to which cells hold ``least`` vectors, by a walk from the nearest cell on.

        ``counts`` has a row for each first centroid and a column for each second one.  A step of the walk takes a run of
        columns of one row.  The ends of runs lie farther than the walk has come, so once it seems to be done what lies
        within its distance is counted, and it goes on by as much as is missing.
        """
        d1, d2 = self.distances(query)
        rows, columns = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
        s1, starts = d1[rows].tolist(), np.arange(0, len(d2), run)
        s2 = d2[columns][starts].tolist()
        held, wanted, runs = 0, least, {}
        heap = [(s1[0] + s2[0], 0, 0)]
        while heap:
            d, i, j = heap[0]
            if held >= wanted:
                inside = int(counts[d1[:, None] + d2[None, :] <= d].sum())
                if inside >= least:
                    return d
                wanted = held + least - inside
            if j == 0:
                runs[i] = np.add.reduceat(counts[rows[i]][columns], starts).tolist()
                if i + 1 < len(s1):
                    heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
            held += runs[i][j]
            if j + 1 < len(s2):
                heapq.heapreplace(heap, (s1[i] + s2[j + 1], i, j + 1))
            else:
                heapq.heappop(heap)
        return math.inf

    def bound(self, query: np.ndarray, own: int, reach: float, k: int) -> float:
        """The ``k``-th best score among the known vectors in the cells up to a distance; minus infinity if there are fewer."""
        met = (self.cell_distances(query, self.known_cells) <= reach) & (self.known_ids != own)
        score = self.known[met] @ query
        return float(np.partition(score, len(score) - k)[len(score) - k]) if len(score) >= k else -math.inf


def fit(x: np.ndarray, rows: int, k: int, settings: Settings) -> tuple[Index, float]:
    """Codebooks for a table of ``rows`` vectors, and the share of them that a query's walk must meet."""
    size = max(1, min(settings.most, math.ceil(settings.fine * math.sqrt(rows))))
    half = max(1, x.shape[1] // 2)
    index = Index(codebook(x[:, :half], size, settings), codebook(x[:, half:], size, settings) if x.shape[1] > half else np.zeros((1, 0)))
    cells = index.cells(x)
    need = []
    for q in range(min(settings.probes, len(x))):
        score = x @ x[q]
        score[q] = -np.inf
        top = np.argsort(-score, kind="stable")[: min(k, len(x) - 1)]
        far = index.cell_distances(x[q], cells)
        need += (np.searchsorted(np.sort(far), far[top], side="right") / len(x)).tolist()
    return index, float(np.quantile(need, settings.recall)) if need else 1.0


def search(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best found for each row for which ``is_query`` holds."""
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    own = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"), F.coalesce(is_query, F.lit(False)).alias("_q"))
    drawn = own.select("_id", "_v").where(F.size("_v") > 0).orderBy(F.xxhash64("_id"), "_id").limit(settings.sample)
    taken = drawn.toArrow()  # at most ``sample`` vectors
    x, at = matrix(taken["_v"], None)
    if not len(x):
        return spark.createDataFrame([], out)
    index, share = fit(x, own.count(), k, settings)
    index.known, index.known_ids = x[: settings.known], taken["_id"].to_numpy()[at][: settings.known]
    index.known_cells = index.cells(index.known)
    shared = spark.sparkContext.broadcast(index)  # 2 * most centroids and ``known`` vectors

    def assign():
        index = shared.value

        def work(batch: pa.RecordBatch):
            x, at = matrix(batch.column(1), index.width)
            at = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(list(x), pa.list_(pa.float64())), batch.column(2).take(at), pa.array(index.cells(x), pa.int32())], ["_id", "_v", "_q", "cell"])

        return work

    indexed = persist(map_batches(own, "_id long, _v array<double>, _q boolean, cell int", assign), "multi-index")
    counts = [0] * (len(index.first) * len(index.second))
    for row in indexed.groupBy("cell").count().collect():  # at most most * most cells
        counts[row["cell"]] = row["count"]
    least = max(math.ceil(share * sum(counts)), k + 1)
    # Cells side by side fill shards; a cell beyond a shard's size has several of its own.
    start, parts, shard, held = [0] * len(counts), [1] * len(counts), 0, 0
    for cell, n in enumerate(counts):
        if held and held + n > settings.shard:
            shard, held = shard + 1, 0
        start[cell], parts[cell] = shard, max(1, math.ceil(n / settings.shard))
        held += n
        if parts[cell] > 1:
            shard, held = shard + parts[cell], 0
    laid = spark.sparkContext.broadcast((np.array(start), np.array(parts), np.array(counts)))  # three numbers a cell

    def deal():
        start, parts, _ = laid.value

        def work(batch: pa.RecordBatch):
            ids, cells = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            yield rows_of(start[cells] + mixed % parts[cells], np.zeros(len(ids), bool), ids, batch.column(1), cells, np.zeros(len(ids)), np.zeros(len(ids)))

        return work

    def probe():
        index, (start, parts, counts) = shared.value, laid.value
        grid = counts.reshape(len(index.first), -1)
        there = np.flatnonzero(counts)

        def work(batch: pa.RecordBatch):
            x, _ = matrix(batch.column(1), index.width)
            ids = batch.column(0).to_numpy()
            for low in range(0, len(x), 500):
                asked = []
                for i in range(low, min(low + 500, len(x))):
                    reach = index.reach(x[i], grid, least, settings.run)
                    bound = index.bound(x[i], int(ids[i]), reach, k)
                    some = there[index.cell_distances(x[i], there) <= reach]
                    many = parts[some] > 1
                    spread = [np.arange(start[c], start[c] + parts[c]) for c in some[many].tolist()]
                    asked += [(shard, i, reach, bound) for shard in np.unique(np.concatenate([start[some[~many]], *spread])).tolist()]
                if asked:
                    shards, at, reach, bound = (np.array(c) for c in zip(*asked, strict=True))
                    yield rows_of(shards, np.ones(len(at), bool), ids[at], batch.column(1).take(pa.array(at)), np.full(len(at), -1), reach, bound)

        return work

    def rows_of(shard, asks, ids, vectors, cells, reach, bound) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(asks), pa.array(ids), vectors, pa.array(cells, pa.int32()), pa.array(reach, pa.float64()), pa.array(bound, pa.float64())], ["shard", "asks", "_id", "_v", "cell", "reach", "bound"])

    row = "shard int, asks boolean, _id long, _v array<double>, cell int, reach double, bound double"
    dealt = map_batches(indexed.select("_id", "_v", "cell"), row, deal).unionByName(map_batches(indexed.where("_q").select("_id", "_v"), row, probe))

    @lean
    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        at, held, there = None, [], None
        for batch in batches:
            shards = batch.column(0).to_numpy()
            asks = batch.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.r_[True, (shards[1:] != shards[:-1]) | (asks[1:] != asks[:-1]), True]).tolist()
            for a, b in zip(edges, edges[1:], strict=False):
                part = batch.slice(a, b - a)
                if at != (at := int(shards[a])):
                    held, there = [], None
                if not asks[a]:
                    held.append(part)
                    continue
                if there is None and held:
                    there = Shard(pa.Table.from_batches(held), index)
                    held = []
                if there is not None:
                    for low in range(0, part.num_rows, 256):
                        yield there.best(part.slice(low, 256), k)

    met = dealt.repartition("shard").sortWithinPartitions("shard", "asks").mapInArrow(rank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Shard:
    """The vectors of a shard, by cell."""

    def __init__(self, rows: pa.Table, index: Index):
        self.index = index
        v, _ = matrix(rows["_v"], index.width)
        ids, cells = rows["_id"].to_numpy(), rows["cell"].to_numpy()
        order = np.lexsort((ids, cells))
        self.v, self.ids = v[order], ids[order]
        self.cells, self.cell_of = np.unique(cells[order], return_inverse=True)

    def best(self, asked: pa.RecordBatch, k: int) -> pa.RecordBatch:
        """The best ``k`` for each query, among the cells within its reach."""
        q, _ = matrix(asked.column(3), self.index.width)
        who, reach, bound = asked.column(2).to_numpy(), asked.column(5).to_numpy(), asked.column(6).to_numpy()
        score = q @ self.v.T
        for i in range(len(q)):
            far = self.index.cell_distances(q[i], self.cells) > reach[i]
            score[i, far[self.cell_of]] = -np.inf
        score[score < (bound - 1e-9 * np.maximum(1.0, np.abs(bound)))[:, None]] = -np.inf
        score[who[:, None] == self.ids[None, :]] = -np.inf
        at = max(0, len(self.v) - k)
        kth = np.partition(score, at, axis=1)[:, at]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in range(len(q)):
            # Scores of a matrix product may differ in the last bits; near ties are scored again, one way for all.
            near = np.flatnonzero((score[i] > -np.inf) & (score[i] >= kth[i] - 1e-9 * max(1.0, abs(kth[i]) if np.isfinite(kth[i]) else 1.0)))
            if len(near):
                exact = (self.v[near] * q[i]).sum(axis=1)
                top = np.lexsort((self.ids[near], -exact))[:k]
                out.append((np.full(len(top), who[i]), self.ids[near][top], exact[top]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])
