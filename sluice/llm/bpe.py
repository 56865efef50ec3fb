"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is split by the tokenizer's pattern.  Tier one asks a minimal perfect
hash over the vocabulary whether the whole pre-token is one token; the hash
gives a slot, and the bytes kept in that slot decide.  Tier two merges what is
left: bytes form a linked list, a heap holds the ranks of neighbouring pairs,
and the lowest rank, leftmost first, is joined until no pair has a rank.
Workers keep the result of each different pre-token.

Ids travel packed, as little-endian unsigned 32-bit integers in a binary column,
so that no boxed arrays are built.  Null and empty texts have no tokens; very
long texts and pre-tokens cost n log n; null ids pass through.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from sluice.llm.common import fields, map_batches

MIX = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> list[bytes]:
    """Tokens by id from a rank file: a base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        pairs = sorted((int(b), base64.b64decode(a)) for a, b in map(bytes.split, lines))
    if [i for i, _ in pairs] != list(range(len(pairs))):
        raise ValueError(f"ranks of {path} have gaps")
    return [t for _, t in pairs]


class PerfectHash:
    """A minimal perfect hash: n keys have the slots 0 to n - 1.

    Each level is a bit array; a key that shares its bit with no other stays on
    that level, the rest go to the next.  A key's slot is the number of set bits
    before its own.
    """

    def __init__(self, keys: list[bytes]):
        left = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        base = 0
        while len(left):
            place = self._place(left, len(self.levels), 2 * len(left))
            bits = np.bincount(place, minlength=2 * len(left)) == 1
            self.levels.append((bits, base + np.cumsum(bits) - bits))
            base += int(bits.sum())
            left = left[~bits[place]]
            if len(self.levels) > 60:
                raise ValueError("keys repeat")
        self.keys = [b""] * len(keys)
        for key, slot in zip(keys, self._slots(keys), strict=True):
            self.keys[slot] = key

    @staticmethod
    def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
        x = (h ^ np.uint64((level + 1) * int(MIX) & 0xFFFFFFFFFFFFFFFF)) * MIX
        return ((x ^ (x >> np.uint64(29))) * MIX >> np.uint64(11)) % np.uint64(size)

    def _slots(self, keys: list[bytes]) -> np.ndarray:
        h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        out = np.full(len(keys), -1)
        todo = np.arange(len(keys))
        for level, (bits, before) in enumerate(self.levels):
            if not len(todo):
                break
            place = self._place(h[todo], level, len(bits)).astype(np.int64)
            hit = bits[place]
            out[todo[hit]] = before[place[hit]]
            todo = todo[~hit]
        return out

    def find(self, keys: list[bytes]) -> list[int]:
        """Slots of the keys; -1 for what isn't a key."""
        return [s if s >= 0 and self.keys[s] == k else -1 for k, s in zip(keys, self._slots(keys).tolist(), strict=True)]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token by merges in order of rank."""
    n = len(piece)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:  # a part of the pair has gone or grown since
            continue
        alive[j] = False
        end[i], after[i] = stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.split = regex.compile(pattern).findall
        self.whole = PerfectHash(tokens)
        self.slot_ids = np.array([self.ranks[k] for k in self.whole.keys], "<u4")
        self.known: dict[str, bytes] = {}

    def learn(self, pieces: list[str]) -> None:
        raw = [p.encode() for p in pieces]
        for piece, data, slot in zip(pieces, raw, self.whole.find(raw), strict=True):
            self.known[piece] = self.slot_ids[slot].tobytes() if slot >= 0 else np.array(merge(data, self.ranks), "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text."""
        if len(self.known) > 1_000_000:
            self.known.clear()
        out = []
        for text in texts:
            pieces = self.split(text) if text else []
            if new := [p for p in dict.fromkeys(pieces) if p not in self.known]:
                self.learn(new)
            out.append(b"".join(map(self.known.__getitem__, pieces)))
        return out

    def decode(self, packed: bytes | None) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed or b"", "<u4").tolist()))


def codec(spark, vocabulary: str, pattern: str):
    """A function that gives a worker's codec; the vocabulary is read once, by the driver."""
    shared = spark.sparkContext.broadcast((read_ranks(vocabulary), pattern))  # the vocabulary file, about 1 MB
    return lambda: Codec(*shared.value)


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids) of every row; ``ids`` is packed."""
    build = codec(docs.sparkSession, vocabulary, pattern)

    def make():
        own = build()

        def work(batch: pa.RecordBatch):
            packed = own.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary())], [id_col, "n_tokens", "ids"])

        return work

    return map_batches(docs.select(id_col, text_col), fields(docs, id_col, "n_tokens long, ids binary"), make)


def decode(encoded: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """``encoded`` (id, n_tokens, ids) with the column ``decoded``: the bytes the ids stand for."""
    build = codec(encoded.sparkSession, vocabulary, pattern)

    def make():
        own = build()

        def work(batch: pa.RecordBatch):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([own.decode(p) for p in batch.column(2).to_pylist()], pa.binary())], [id_col, "n_tokens", "ids", "decoded"])

        return work

    return map_batches(encoded.select(id_col, "n_tokens", "ids"), fields(encoded, id_col, "n_tokens long, ids binary, decoded binary"), make)
