"""Exact removal of long repeated substrings by distributed prefix doubling.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere
else, in the same text or another.  Ranks of positions are refined at growing
lengths: in each round Spark sorts (rank, what lies at the next offset) pairs,
equal neighbours get dense new ranks, and positions that are unique are dropped,
until the length is past the threshold (:mod:`sluice.llm.ranking`).

Ranking all positions of a corpus would sort many times its size, so positions are
sampled, by content alone: equal windows of ``length`` bytes sample the same ones.

1. ``seed`` bytes.  A window's position is the leftmost of its substrings of
   ``seed`` bytes with the smallest hash.  A run of windows with one position is a
   segment, about one for 70 bytes; its pair is (hash of the position's seed,
   fingerprint of all that its windows cover).  Segments whose seed is unique hold
   unique windows only and are dropped.  Segments that repeat as a whole are past
   the threshold; one of each kind goes on.
2. ``length`` - 8 bytes.  Segments are cut at multiples of 8 bytes before their
   position.  The pair of a block, the 8 windows that start up to 7 bytes before
   its cut, is (rank, fingerprint of the bytes that all 8 share); behind it the 7
   bytes before and the 8 bytes after.  Blocks that repeat as a whole are done.
3. ``length`` bytes.  The pair of a window is (rank, the 8 bytes around the shared
   ones that are its own).  A window whose pair repeats is repeated.

So there are three rounds whatever the input; each is a range sort that cuts hot
classes among ranges, and no step lists pairs or holds a class.  Ranks are decided
by 64-bit fingerprints within classes of the rank before, and by the bytes
themselves in the last round.  Texts are joined twice by digest: once, each text
once, with the segments that go on, and at the end with the ranges to remove.

Texts are their UTF-8 bytes; null is empty; texts shorter than ``length`` lose
nothing; copies of a text lose all of it if it is long enough; null and repeated
ids pass through, since texts are matched by digest and not by id; input columns
may have any names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import discard, fields, map_batches, persist, whole_row
from sluice.llm.ranking import dense_ranks


@dataclass(frozen=True)
class Settings:
    """length: bytes that must repeat.  seed: bytes of a first rank."""

    length: int = 200
    seed: int = 64

    @property
    def span(self) -> int:
        """Seeds in a window, which is also the most windows of a segment."""
        return self.length - self.seed + 1

    @property
    def core(self) -> int:
        """Bytes that all windows of a block share."""
        return self.length - GRID


#: Windows of a block: as many bytes as a long has are a window's own.
GRID = 8

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BLOCK = 1 << 20


class Powers:
    """Powers of the base and its inverse, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> Powers:
        if len(self.up) < n:
            def powers(base: int) -> np.ndarray:
                factors = np.full(n, base, np.uint64)
                factors[0] = 1
                return np.multiply.accumulate(factors)

            self.up, self.down = powers(BASE), powers(INVERSE)
        return self


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def prefix_sums(data: np.ndarray, powers: Powers) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(VALUES[data] * powers.up[: len(data)], out=out[1:])
    return out


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """min(h[p : p + width]) for each p with a whole window."""
    n = len(h) - width + 1
    rows = -(-len(h) // width)
    grid = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(h)] = h
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


#: Bits of a place in a batch of blocks.
PLACE = 22


def segments(texts: list[bytes], powers: Powers, s: Settings) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, offset of the position, hash of its seed, fingerprint) of all segments of the texts.

    Of segments of a kind that follow each other, as in periodic text, the second stands for all that follow.
    """
    parts = []
    size, batch = 0, []
    for i, text in enumerate(texts):
        # Very long texts go block by block, with the overlap that whole windows need.
        for low in range(0, max(1, len(text) - s.length + 1), BLOCK):
            piece = text[low : low + BLOCK + s.length - 1]
            if len(piece) >= s.length:
                batch.append((i, low, piece))
                size += len(piece)
            if size >= BLOCK:
                parts.append(_segments(batch, powers, s))
                batch, size = [], 0
    if batch:
        parts.append(_segments(batch, powers, s))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _segments(batch: list[tuple[int, int, bytes]], powers: Powers, s: Settings) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(p for _, _, p in batch), np.uint8)
    powers = powers.upto(len(data) + 1)
    sums = prefix_sums(data, powers)
    seeds = mix((sums[s.seed :] - sums[: -s.seed]) * powers.down[: len(data) - s.seed + 1])
    # The place in the low bits: of equal hashes the leftmost is the smallest.
    low_bits = np.uint64((1 << PLACE) - 1)
    at = (window_minima(seeds & ~low_bits | np.arange(len(seeds), dtype=np.uint64), s.span) & low_bits).astype(np.int64)
    sizes = np.array([len(p) for _, _, p in batch])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    windows = sizes - s.length + 1
    which = np.repeat(np.arange(len(batch)), windows)
    place = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + starts[which]
    at = at[place]
    head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (which[1:] != which[:-1])]))
    count = np.diff(np.concatenate([head, [len(at)]]))
    begin, at, which = place[head], at[head], which[head]
    seed = seeds[at]
    whole = mix((sums[begin + count + s.length - 1] - sums[begin]) * powers.down[begin] + count.astype(np.uint64))
    again = np.concatenate([[False], (seed[1:] == seed[:-1]) & (whole[1:] == whole[:-1]) & (which[1:] == which[:-1])])
    third = again & np.concatenate([[False], again[:-1]])
    group = np.cumsum(~third) - 1
    kept = np.flatnonzero(~third)
    total = np.bincount(group, count, len(kept)).astype(np.int64)
    low, text = np.array([b[1] for b in batch]), np.array([b[0] for b in batch])
    begin, which = begin[kept], which[kept]
    return text[which], begin - starts[which] + low[which], total, at[kept] - begin, seed[kept], whole[kept]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


#: A segment's place in one long: 24 bits of a second digest of the text, 31 of the first window, 8 of the position's offset from it.
TAG, FIRST, OFFSET = "shiftright(place, 39)", "(shiftright(place, 8) & 2147483647L)", "(place & 255L)"


def digests(text: F.Column) -> tuple[F.Column, F.Column]:
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(text).alias("k"), F.shiftrightunsigned(F.xxhash64(F.lit(1), text), 40).alias("tag")


def first_pairs(texts: DataFrame, s: Settings) -> DataFrame:
    """(m, u, n, k, place): segments of all texts; a task tells copies of a text once."""

    def make():
        powers, seen = Powers(), set()

        def work(batch: pa.RecordBatch):
            k, tag = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = [i for i, key in enumerate(zip(k.tolist(), tag.tolist(), strict=True)) if key not in seen and not seen.add(key)]
            k, tag = k[new], tag[new]
            text, first, count, offset, m, u = segments([t.encode() for t in batch.column(2).take(pa.array(new, pa.int64())).to_pylist()], powers, s)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (signed(m), signed(u), count, k[text], tag[text] << 39 | first << 8 | offset)], ["m", "u", "n", "k", "place"])

        return work

    return map_batches(texts, "m long, u long, n long, k long, place long", make)


def blocks(texts: DataFrame, going: DataFrame, s: Settings) -> DataFrame:
    """(h, x, y, at): blocks of the segments that go on.

    ``h`` has the rank and the shared bytes, ``x`` the 7 bytes before them and which windows there are, ``y`` the 8 bytes
    after, ``at`` the segment, the block's number before the position, and whether the segment is the only one of its kind.
    Bytes that belong to no window are 0.
    """
    lists = going.groupBy("k", F.expr(TAG).alias("tag")).agg(F.collect_list(F.struct("row", "rank", "n", "alone", F.expr(FIRST).alias("first"), F.expr(OFFSET).alias("offset"))).alias("own"))
    met = texts.dropDuplicates(["k", "tag"]).join(lists, ["k", "tag"]).select("text", "own")
    width = s.length + s.span - 1

    def make():
        powers = Powers().upto(width + 1)

        def made(found: list[dict], covered: list[bytes]) -> pa.RecordBatch:
            row, rank, n, offset = (np.array([f[c] for f in found]) for c in ("row", "rank", "n", "offset"))
            alone = np.array([f["alone"] for f in found], np.int64)
            data = np.frombuffer(b"".join(bytes(GRID - 1) + c.ljust(width + GRID, b"\0") for c in covered), np.uint8).reshape(len(found), -1)
            sums = np.zeros((len(found), width + 1), np.uint64)
            np.cumsum(VALUES[data[:, GRID - 1 : GRID - 1 + width]] * powers.up[:width], axis=1, out=sums[:, 1:])
            last = (offset - n + 1) // GRID
            many = offset // GRID - last + 1
            seg = np.repeat(np.arange(len(found)), many)
            t = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + last[seg]
            cut = offset[seg] - GRID * t
            low, high = np.maximum(0, cut - n[seg] + 1), np.minimum(GRID - 1, cut)
            h = mix((sums[seg, cut + s.core] - sums[seg, cut]) * powers.down[cut]) ^ mix(rank[seg].astype(np.uint64) * np.uint64(BASE))

            def long_of(start: np.ndarray, size: int) -> np.ndarray:
                out = np.zeros(len(seg), np.uint64)
                for i in range(size):
                    out = out << np.uint64(8) | data[seg, start + i]
                return out

            x = long_of(cut, GRID - 1) & (np.uint64(1) << (8 * high).astype(np.uint64)) - np.uint64(1)
            spare = (8 * low).astype(np.uint64)
            y = long_of(cut + s.core + GRID - 1, GRID) >> spare << spare
            x = x.astype(np.int64) << 6 | low << 3 | high
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (signed(h), x, signed(y), row[seg] << 6 | t << 1 | alone[seg])], ["h", "x", "y", "at"])

        def work(batch: pa.RecordBatch):
            found: list[dict] = []
            covered: list[bytes] = []
            for text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = text.encode()
                for o in own:
                    found.append(o)
                    covered.append(data[o["first"] : o["first"] + o["n"] + s.length - 1])
                    if len(found) == 2000:
                        yield made(found, covered)
                        found, covered = [], []
            if found:
                yield made(found, covered)

        return work

    return map_batches(met, "h long, x long, y long, at long", make)


def windows(ranked: DataFrame) -> DataFrame:
    """(r, w, at): windows of blocks that go on: rank and place in the block, the 8 bytes of their own, the block's place and the window's."""
    each = ranked.select("rank", "x", "y", "at", F.explode(F.expr("sequence(cast(shiftright(x, 3) & 7 AS int), cast(x & 7 AS int))")).alias("e"))
    own = F.expr("shiftleft(shiftright(x, 6) & (shiftleft(1L, 8 * e) - 1), 64 - 8 * e) | shiftrightunsigned(y, 8 * e)")
    return each.select(F.expr("rank * 8 + e").alias("r"), own.alias("w"), F.expr("shiftleft(at, 3) | e").alias("at"))


def repeated_ranges(docs: DataFrame, text_col: str, s: Settings) -> DataFrame:
    """(k, tag, ranges): what repeats in each different text, as byte ranges in order that don't touch."""
    k, tag = digests(F.col(text_col))
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit("")))
    texts = docs.where(size >= s.length).select(k, tag, F.col(text_col).alias("text"))
    copies = texts.select("k", "tag", F.octet_length("text").cast("long").alias("end")).groupBy("k", "tag", "end").count().where("count > 1")
    found = [copies.select("k", "tag", F.lit(0).cast("long").alias("start"), "end")]

    one = dense_ranks(first_pairs(texts, s), ["m"], ["u"], ["n", "k", "place"], "segments")
    end = F.expr(FIRST) + F.col("n") + s.length - 1
    found.append(one.rows.where("whole").select("k", F.expr(TAG).alias("tag"), F.expr(FIRST).alias("start"), end.alias("end")))
    going = one.rows.where("first").where(F.col("n") <= s.span)

    two = dense_ranks(persisted := persist(blocks(texts, going, s), "pairs"), ["h"], ["x", "y"], ["at"], "blocks")
    three = dense_ranks(windows(two.rows.where("first")), ["r", "w"], [], ["at"], "windows")
    shared = two.rows.where("whole").where("at & 1 = 1").select(F.expr("shiftright(at, 6)").alias("row"), F.expr("shiftright(at, 1) & 31").alias("t"), F.expr("x & 7").alias("high"), F.expr("shiftright(x, 3) & 7").alias("low"))
    single = three.rows.where("whole").where("at & 8 = 8").select(F.expr("shiftright(at, 9)").alias("row"), F.expr("shiftright(at, 4) & 31").alias("t"), F.expr("at & 7").alias("high"), F.expr("at & 7").alias("low"))
    # Windows that follow each other make one range of a segment, or a few.
    mine = shared.unionByName(single).groupBy("row").agg(F.collect_set(F.struct((-GRID * F.col("t") - F.col("high")).alias("a"), (-GRID * F.col("t") - F.col("low")).alias("b"))).alias("own"))
    placed = mine.join(going.where("alone").select("row", "k", "place"), "row").select("k", "place", F.explode("own").alias("o"))
    found.append(placed.select("k", F.expr(TAG).alias("tag"), F.expr(f"{FIRST} + {OFFSET} + o.a").alias("start"), F.expr(f"{FIRST} + {OFFSET} + o.b + {s.length}").alias("end")))

    every = found[0].unionByName(found[1]).unionByName(found[2])
    lists = every.groupBy("k", "tag").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def make():
        def work(batch: pa.RecordBatch):
            ranges = [[{"start": a, "end": b} for a, b in merged(r)] for r in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ranges, kind)], ["k", "tag", "ranges"])

        return work

    ranges = persist(map_batches(lists, "k long, tag long, ranges array<struct<start: long, end: long>>", make), "ranges")
    discard(persisted, one.table, two.table, three.table)
    return ranges


def merged(ranges: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["start"], r["end"]) for r in ranges or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings(), keep: bool = True, rows: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256 [, kept]) of every row; with ``rows`` the struct ``_row`` of all its columns in place of the id.

    ``kept`` is the remaining text; where a cut parts a character, what is left of it is dropped
    from ``kept`` (``kept_sha256`` is of the remaining bytes).
    """
    ranges = repeated_ranges(docs, text_col, settings)
    k, tag = digests(F.col(text_col))
    own = docs.select((whole_row(docs) if rows else F.struct(id_col)).alias("_row"), k, tag, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    joined = own.join(ranges, ["k", "tag"], "left").select("_row", "_text", "ranges")
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 if keep else 4]

    def make():
        def work(batch: pa.RecordBatch):
            out: list[tuple] = []
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data, cut = text.encode(), [(r["start"], r["end"]) for r in ranges or ()]
                kept, done = [], 0
                for a, b in cut:
                    kept.append(data[done:a])
                    done = b
                rest = b"".join([*kept, data[done:]])
                left = (rest.decode(errors="ignore") if cut else text,) if keep else ()
                out.append((len(data), sum(b - a for a, b in cut), len(cut), hashlib.sha256(rest).hexdigest(), *left))
            types = (*[pa.int64()] * 3, pa.string(), pa.string())[: len(names)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]], ["_row", *names])

        return work

    made = map_batches(joined, fields(joined, "_row", "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * keep), make)
    return made if rows else made.select("_row.*", *names)
