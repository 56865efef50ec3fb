"""Dense ranks by a distributed sort: one round of prefix doubling.

Rows are sorted by all their columns, range by range, so a class of equal leading
columns that is larger than a range lies in several.  One pass over each sorted
range numbers its classes and drops those of one row; what only the neighbouring
ranges can tell (whether their last or first class goes on here) is settled from
the ends of all ranges, one small row for each.

Equal rows must not repeat without bound, since a range can't be cut among them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import lean, persist

#: What a row's answer waits for: its kind in the range before or after, its class in the range before or after.
KIND_BEFORE, KIND_AFTER, CLASS_BEFORE, CLASS_AFTER = 1, 2, 4, 8
EXTRA = "_rank long, _row long, _whole boolean, _first boolean, _alone boolean, _wait int, _part int, _ends struct<head: array<long>, tail: array<long>, classes: long, head_many: boolean, tail_many: boolean>"


@dataclass(frozen=True)
class Ranked:
    """Rows of classes of several rows.

    ``rows``: the columns of the input with ``rank`` (dense, in sorted order, from 0), ``row`` (different for each row),
    ``whole`` (another row has the same kind), ``first`` (one of each kind of a class of several kinds) and ``alone`` (the
    only row of its kind as far as its range tells).  ``classes``: how many there are.  ``table``: what
    ``rows`` reads.
    """

    rows: DataFrame
    classes: int
    table: DataFrame


ENDS = pa.struct([("head", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64())), ("classes", pa.int64()), ("head_many", pa.bool_()), ("tail_many", pa.bool_())])


class Pass:
    """Numbers the classes of one sorted range, batch by batch.

    Each batch decides all its rows but the last, whose successor isn't known yet.  Of the class at hand at most one more
    row is kept: that of its first kind, until another kind follows.
    """

    def __init__(self, columns: list[str], classes: int, kinds: int, part: int):
        self.names = [*columns, "_rank", "_row", "_whole", "_first", "_alone", "_wait", "_part", "_ends"]
        self.c, self.k, self.part = classes, classes + kinds, part
        self.held = np.zeros((0, len(columns)), np.int64)
        self.goes_on = (False, False)  # whether the held row continues the class, the kind before it
        self.head: list[int] | None = None
        self.head_many = self.tail_many = False
        self.rank, self.row = -1, 0
        self.pending: tuple[np.ndarray, int, int, bool, bool] | None = None  # row, rank, number, alone, of the range's first class

    def step(self, batch: np.ndarray, last: bool = False) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate([self.held, batch])
        if not len(rows):
            return
        if self.head is None:
            self.head = rows[0].tolist()
        same = rows[1:] == rows[:-1]
        classes, kinds = same[:, : self.c].all(axis=1), same[:, : self.k].all(axis=1)
        class_before, kind_before = np.r_[self.goes_on[0], classes], np.r_[self.goes_on[1], kinds]
        class_after, kind_after = np.r_[classes, False], np.r_[kinds, False]
        self.held, self.goes_on = rows[-1:], (bool(class_before[-1]), bool(kind_before[-1]))
        n = len(rows) if last else len(rows) - 1
        if n:
            yield from self._decide(rows[:n], class_before[:n], kind_before[:n], class_after[:n], kind_after[:n], last)

    def _decide(self, rows: np.ndarray, class_before: np.ndarray, kind_before: np.ndarray, class_after: np.ndarray, kind_after: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
        n = len(rows)
        head, tail = np.zeros(n, bool), np.zeros(n, bool)
        if self.row == 0:
            head[0], self.head_many = True, bool(class_after[0])
        if last:
            tail[-1], self.tail_many = True, bool(class_before[-1])
        number = self.row + np.arange(n)
        self.row += n
        # A class of one row has no rank, unless a neighbouring range may have more of it.
        member = class_before | class_after | head | tail
        start = ~class_before
        rank = self.rank + np.cumsum(start & member)
        self.rank = int(rank[-1])
        whole = kind_before | kind_after
        wait = np.where(head & ~whole, KIND_BEFORE, 0) | np.where(tail & ~whole, KIND_AFTER, 0)
        first, late = np.zeros(n, bool), None
        if self.k > self.c:
            # A class of this batch: 0 is the one that goes on from before.
            own = np.cumsum(start)
            first = ~kind_before & ~start & member
            others = np.bincount(own[first], minlength=own[-1] + 1)
            late = self._late(bool(others[0]), bool(own[-1]), last)
            starts = np.flatnonzero(start & member)
            several = others[own[starts]] > 0
            first[starts[several]] = True
            for i in starts[~several]:
                final = own[i] == own[-1]
                if final and not last:
                    self.pending = (rows[i : i + 1], int(rank[i]), int(number[i]), not kind_after[i], bool(head[i]))
                else:
                    wait[i] |= CLASS_BEFORE * bool(head[i]) | CLASS_AFTER * bool(final)
        if late:
            yield late
        emit = member & (whole | first | (wait > 0))
        if emit.any():
            yield self._made(rows[emit], rank[emit], number[emit], whole[emit], first[emit], ~whole[emit], wait[emit])

    def _late(self, followed: bool, over: bool, last: bool) -> pa.RecordBatch | None:
        """The pending row, if its class turned out to have several kinds or ends where a neighbour may go on."""
        if self.pending is None or not (followed or over or last):
            return None
        row, rank, number, alone, at_head = self.pending
        self.pending = None
        wait = 0 if followed else CLASS_BEFORE * at_head | CLASS_AFTER * (last and not over)
        if not followed and not wait:
            return None
        return self._made(row, *(np.array([x]) for x in (rank, number, False, followed, alone, wait)))

    def _made(self, rows, rank, number, whole, first, alone, wait) -> pa.RecordBatch:
        n = len(rows)
        made = [*[pa.array(rows[:, i]) for i in range(rows.shape[1])], pa.array(rank, pa.int64()), pa.array(number | self.part << 33, pa.int64()), *map(pa.array, (whole, first, alone))]
        return pa.RecordBatch.from_arrays([*made, pa.array(wait, pa.int32()), pa.array(np.full(n, self.part), pa.int32()), pa.nulls(n, ENDS)], self.names)

    def ends(self) -> Iterator[pa.RecordBatch]:
        """One row of what the neighbours need to know."""
        if self.head is not None:
            ends = {"head": self.head, "tail": self.held[0].tolist(), "classes": self.rank + 1, "head_many": self.head_many, "tail_many": self.tail_many}
            none = self._made(self.held * 0, *(np.array([x]) for x in (0, 0, False, False, False, 0)))
            yield pa.RecordBatch.from_arrays([*none.columns[:-1], pa.array([ends], ENDS)], self.names)


def settled(ends: list[tuple[int, dict]], classes: int, kinds: int) -> tuple[list[tuple[int, int, int]], int]:
    """(part, offset of its ranks, mask of what its rows wait for and is so) of each range in order, and the number of classes."""
    out, total, both = [], 0, classes + kinds
    for i, (part, e) in enumerate(ends):
        before, after = ends[i - 1][1]["tail"] if i else None, ends[i + 1][1]["head"] if i + 1 < len(ends) else None
        cb, kb = before is not None and before[:classes] == e["head"][:classes], before is not None and before[:both] == e["head"][:both]
        ca, ka = after is not None and after[:classes] == e["tail"][:classes], after is not None and after[:both] == e["tail"][:both]
        mask = KIND_BEFORE * kb | KIND_AFTER * ka | CLASS_BEFORE * cb | CLASS_AFTER * ca
        one = e["classes"] == 1 and e["head"][:classes] == e["tail"][:classes]
        if one:
            kept = e["head_many"] or e["tail_many"] or cb or ca
            out.append((part, int(total - cb), int(mask)))
            total += int(kept and not cb)
            continue
        head, tail = e["head_many"] or cb, e["tail_many"] or ca
        offset = total - (cb or not head)
        out.append((part, int(offset), int(mask)))
        total = offset + e["classes"] - (not tail)
    return out, total


def dense_ranks(rows: DataFrame, classes: list[str], kinds: list[str], rest: list[str], label: str) -> Ranked:
    """Sort the rows (all columns long) and rank the classes of more than one row.

    Without ``kinds`` a class has one kind only, and ``first`` holds for no row.
    """
    columns = [*classes, *kinds, *rest]
    laid = rows.select(columns).repartitionByRange(*columns).sortWithinPartitions(*columns)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pass(columns, len(classes), len(kinds), TaskContext.get().partitionId())
        for batch in batches:
            yield from own.step(np.stack([c.to_numpy() for c in batch.columns], axis=1))
        yield from own.step(own.held[:0], last=True)
        yield from own.ends()

    made = persist(laid.mapInArrow(run, ", ".join(f"`{c}` long" for c in columns) + ", " + EXTRA), label)
    # One row for each range: as many as the sort has partitions.
    ends = sorted((r["_part"], r["_ends"].asDict()) for r in made.where("_ends is not null").select("_part", "_ends").collect())
    found, total = settled(ends, len(classes), len(kinds))
    parts = rows.sparkSession.createDataFrame(found, "_part int, _offset long, _mask int")
    known = made.where("_ends is null").join(F.broadcast(parts), "_part")
    hit = F.col("_wait").bitwiseAND(F.col("_mask"))
    told = known.select(
        *columns, (F.col("_rank") + F.col("_offset")).alias("rank"), F.col("_row").alias("row"), (F.col("_whole") | (hit.bitwiseAND(F.lit(KIND_BEFORE | KIND_AFTER)) > 0)).alias("whole"),
        (F.col("_first") | (hit.bitwiseAND(F.lit(CLASS_BEFORE | CLASS_AFTER)) > 0)).alias("first"), F.col("_alone").alias("alone"),
    )
    return Ranked(told.where("whole or first"), total, made)
