"""Bounded-space online packing of tokenised documents into sequences.

Each partition keeps a fixed number of open windows.  A document longer than a
window first fills whole windows of its own; what is left goes into the open
window where it fits best.  When it fits none and no more may be opened, the
fullest window is filled with its head and emitted, or emitted as it is where
the gap is too small to be worth a cut.  Windows still open at the end of a
partition are leftovers: they are laid end to end and cut into full windows, and
the last tail at powers of two, which need no padding.

A partition is packed in one pass, whatever others hold: nothing is shuffled or
kept between passes, and a lost task is packed again by itself.  Null and empty
texts are documents of the closing id alone; very long texts fill windows of
their own; rows with null ids are packed like others; equal texts are packed
separately, and of pieces that fit equally well the window opened first gets them.
"""

from __future__ import annotations

import bisect
import functools
import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import fields, lean, parts

#: Letters below U+0250 whose case folding and composition are one to one, and plain white space and marks.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ‐-‧‰-›€]*")
STOPS = frozenset(".,;:!?")
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


@dataclass(frozen=True)
class Settings:
    """size: ids of a window.  windows: open ones in a partition.  least: ids worth a cut.
    closing: the id that ends a document."""

    size: int = 2048
    windows: int = 32
    least: int = 16
    closing: int = 1


def some_at_a_time(texts: list[str | None], size: int = 32_000) -> Iterator[list[str | None]]:
    """Texts in batches of about as many characters as stay in a core's cache once they are cut."""
    batch, held = [], 0
    for text in texts:
        batch.append(text)
        held += len(text or "")
        if held >= size:
            yield batch
            batch, held = [], 0
    if batch:
        yield batch


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be seen, else the next one from U+0100 on."""
    seen = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    rest = (b for b in range(256) if b not in set(seen))
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


LETTERS = byte_letters()


def shown(word: str) -> str:
    """A word in the letters of a byte-level vocabulary."""
    return word if word.isascii() else word.encode().decode("latin-1").translate(LETTERS)


class Tokens:
    """Packed ids of texts by a tokenizers file.

    Texts of plain characters are cut at white space; ids of each different part
    are kept, and pre-tokens that are new to a batch go to the tokenizer together.
    Other texts go through the tokenizer whole.  The vocabulary's normaliser
    lower-cases and its splitter drops white space, which the cut repeats for plain
    characters only.  What is kept is bounded in bytes and forgotten beyond ``most``.
    """

    def __init__(self, vocabulary: str, most: int = 128 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = True
        told = json.loads(vocabulary)
        # Pre-tokens of plain texts are lower case, composed and cut already, so all that is left for them are the merges.
        bare = {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "decoder": None, "added_tokens": []}
        self.merges = Tokenizer.from_str(json.dumps(told | bare))
        mark = told["model"]["end_of_word_suffix"]
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.closes[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(mark)]] = True
        self.known: dict[str, bytes] = {}
        self.most = self.left = most

    def learn_words(self, words: list[str]) -> None:
        """Encode pre-tokens, many in one text: blanks part them and are dropped; the last id of each has the vocabulary's closing mark."""
        for low in range(0, len(words), 1000):
            some = words[low : low + 1000]
            ids = np.array(self.merges.encode_batch_fast([" ".join(map(shown, some))], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(some) or ends[-1] != len(ids):
                raise ValueError("the tokenizer cuts pre-tokens otherwise than expected")
            packed, bounds = ids.tobytes(), [0, *(ends * 4).tolist()]
            self.known.update(zip(some, [packed[a:b] for a, b in zip(bounds, bounds[1:], strict=False)], strict=True))

    def learn(self, parts: set[str]) -> None:
        known = self.known
        words = set(filter(str.isalpha, parts))
        others = [(p, (p[:-1], p[-1]) if p[-1] in STOPS and p[:-1].isalpha() else SPLIT.findall(p)) for p in parts - words]
        words.update(w for _, cut in others for w in cut if w not in known)
        self.learn_words(list(words))
        for part, cut in others:
            known[part] = b"".join(map(known.__getitem__, cut))
        # With its ids and its place in the table an entry takes some 200 bytes besides its text, which may be long.
        self.left -= sum(map(len, parts)) + 200 * len(parts)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for part in some_at_a_time(texts):
            plain = [t.lower().split() if t and PLAIN.fullmatch(t) else None for t in part]
            seen = set().union(*filter(None, plain))
            known = self.known
            if self.left < 0:
                known.clear()
                self.left = self.most
            if new := seen.difference(known):
                self.learn(new)
            for text, parts in zip(part, plain, strict=True):
                if parts is not None:
                    out.append(b"".join(map(known.__getitem__, parts)))
                else:
                    out.append(pack(self.tokenizer.encode(text, add_special_tokens=False).ids) if text else b"")
        return out


@functools.cache
def worker_tokens(vocabulary: str) -> Tokens:
    """One for each worker process, whatever the number of its tasks."""
    return Tokens(vocabulary)


def pack(ids: list[int]) -> bytes:
    packed = array("I", ids)  # unsigned 32-bit
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


@dataclass
class Piece:
    doc: object
    start: int
    ids: bytes
    total: int

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[: 4 * n], self.total), Piece(self.doc, self.start + n, self.ids[4 * n :], self.total)

    def __len__(self) -> int:
        return len(self.ids) // 4


class Packer:
    """Open windows of one partition, ordered by free space."""

    def __init__(self, settings: Settings):
        self.s = settings
        self.free: list[tuple[int, int]] = []  # (free ids, window)
        self.held: dict[int, list[Piece]] = {}
        self.opened = 0

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Place a piece; windows that are complete come out."""
        while len(piece) >= self.s.size:
            head, piece = piece.cut(self.s.size)
            yield [head]
        while len(piece):
            n = len(piece)
            k = bisect.bisect_left(self.free, (n, -1))
            if k < len(self.free):
                space, w = self.free.pop(k)
                self.held[w].append(piece)
                if space == n:
                    yield self.held.pop(w)
                else:
                    bisect.insort(self.free, (space - n, w))
                return
            if len(self.free) < self.s.windows:
                self.held[self.opened] = [piece]
                bisect.insort(self.free, (self.s.size - n, self.opened))
                self.opened += 1
                return
            space, w = self.free.pop(0)
            if space >= self.s.least:
                head, piece = piece.cut(space)
                self.held[w].append(head)
            yield self.held.pop(w)

    def leftovers(self) -> list[Piece]:
        return [piece for _, w in self.free for piece in self.held[w]]


def end_to_end(pieces: list[Piece], size: int) -> Iterator[list[Piece]]:
    """Full windows of the pieces in order; the tail is cut at powers of two."""
    left = sum(map(len, pieces))
    todo = pieces[::-1]
    while left:
        room = size if left >= size else 1 << (left.bit_length() - 1)
        window, left = [], left - room
        while room:
            piece = todo.pop()
            if len(piece) > room:
                piece, rest = piece.cut(room)
                todo.append(rest)
            window.append(piece)
            room -= len(piece)
        yield window


COLUMNS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")


def rows_of(window: list[Piece], sequence: int, keep: bool) -> Iterator[tuple]:
    offset = 0
    for p in window:
        yield p.doc, p.start, len(p), zlib.crc32(p.ids), p.total, sequence, offset, p.ids if keep else None
        offset += len(p)


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings(), keep_ids: bool = True) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (packed; null without ``keep_ids``)."""
    with open(vocabulary, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary file, 1.7 MB
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = fields(own, "_id", "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer, part = worker_tokens(shared.value), Packer(settings), TaskContext.get().partitionId()
        closing, made = pack([settings.closing]), 0
        rows: list[tuple] = []
        kind = pa.null()

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * (len(COLUMNS) + 1)
            types = [kind, *[pa.int64()] * 6, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["_id", *COLUMNS])

        for batch in batches:
            kind = batch.schema.field(0).type
            for some in parts(batch, 2 << 20):
                for doc, ids in zip(some.column(0).to_pylist(), tokens.encode(some.column(1).to_pylist()), strict=True):
                    ids += closing
                    for window in packer.add(Piece(doc, 0, ids, len(ids) // 4)):
                        rows += rows_of(window, part << 32 | made, keep_ids)
                        made += 1
                if len(rows) > 2000:
                    yield batch_of()
                    rows.clear()
        for window in end_to_end(packer.leftovers(), settings.size):  # at most ``windows`` of ``size`` ids
            rows += rows_of(window, part << 32 | made, keep_ids)
            made += 1
        if rows:
            yield batch_of()

    return own.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
