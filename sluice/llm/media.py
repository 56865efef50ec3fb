"""Media columns in archives, read by a Spark data source of our own.

``write_archives`` stores a payload per row as an 8-bit greyscale PNG of fixed
width and puts the images, uncompressed, into zip archives of bounded size in
one folder.  Names and contents follow from the partition alone and files appear
by renaming, so a task that runs twice leaves the same archives.

The data source ``media_archive`` plans byte ranges over the archives of a
folder.  A task takes the members that start in its range, by the archive's
directory of offsets, and streams them as Arrow batches of bounded size.  Each
member is read and checked on its own by offset and tried again alone; one that
stays unreadable fails the read, or gives a row with its error if ``errors`` is
``keep``.

Payloads: bytes of any length, with blanks appended up to a positive multiple of
the width; the length before that is kept in the image.  A null text is empty.
Null ids pass through; equal payloads give equal images.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import time
import zipfile
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sluice.llm.common import map_batches, shared_path

WIDTH = 192
#: The first bytes of a PNG file.
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder URI and the path in it."""
    if re.match(r"(file:)?/", uri):
        return pafs.LocalFileSystem(), re.sub(r"^(file:)?/+", "/", uri)
    return pafs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def padded(data: bytes, width: int = WIDTH) -> bytes:
    return data + b" " * (-len(data) % width if data else width)


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, n_bytes: int, width: int = WIDTH) -> bytes:
    rows = np.zeros((len(payload) // width, width + 1), np.uint8)  # each row begins with its filter, 0
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, width)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"tEXt", b"n_bytes\x00%d" % n_bytes) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 3)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[np.ndarray, int]:
    """The samples by rows and the length before padding; ValueError for a damaged image."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, parts = 8, {}
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        data = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != int.from_bytes(media[at + 8 + size : at + 12 + size], "big"):
            raise ValueError(f"damaged {kind!r} chunk")
        parts[kind] = parts.get(kind, b"") + data
        at += 12 + size
    width, height = struct.unpack(">II", parts[b"IHDR"][:8])
    rows = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(height, width + 1)
    return rows[:, 1:], int(parts[b"tEXt"].split(b"\x00")[1])


def feature(samples: np.ndarray) -> str:
    """Mean, deviation, 8-bin histogram, and a hash of which areas of an 8 by 8 grid are brighter than the mean."""
    counts = np.bincount(samples.ravel(), minlength=256)
    level, n = np.arange(256), samples.size
    mean = float(counts @ level) / n
    deviation = max(0.0, float(counts @ (level * level)) / n - mean * mean) ** 0.5
    bins = counts.reshape(8, 32).sum(1)
    lines = samples.sum(axis=1, dtype=np.int64) if samples.shape[1] % 8 else samples.reshape(len(samples), 8, -1).sum(axis=2, dtype=np.int64)
    edges = np.arange(8) * len(lines) // 8
    grid = np.add.reduceat(lines.reshape(len(lines), -1), edges, axis=0)
    bits = "".join("01"[b] for b in (grid > grid.mean()).ravel().tolist())
    return f"mean={mean:.4f};std={deviation:.4f};hist={','.join(map(str, bins.tolist()))};grid={int(bits, 2):016x}"


def member_name(nth: int, key: object) -> str:
    return f"{nth:07d}" if key is None else f"{nth:07d}/={quote(str(key), safe='')}"


def member_key(name: str) -> str | None:
    return unquote(name.split("/=", 1)[1]) if "/=" in name else None


def write_archives(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = 32 << 20) -> dict[str, int]:
    """Store each row's text as an image in archives below ``folder``; returns the totals of members and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        done: list[tuple[int, int]] = []
        buffer = archive = None
        count = 0

        def close() -> None:
            nonlocal archive
            if archive is not None:
                archive.close()
                final = f"{base}/part-{part:06d}-{len(done):05d}.zip"
                with fs.open_output_stream(f"{final}.{attempt}.tmp") as out:
                    out.write(buffer.getbuffer())
                fs.move(f"{final}.{attempt}.tmp", final)
                done.append((count, buffer.tell()))
                archive = None

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if archive is None:
                    buffer, count = io.BytesIO(), 0
                    archive = zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED)
                data = (text or "").encode()
                archive.writestr(zipfile.ZipInfo(member_name(count, doc)), to_png(padded(data), len(data)))
                count += 1
                if buffer.tell() >= archive_bytes:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in done], pa.int64()), pa.array([b for _, b in done], pa.int64())], ["members", "bytes"])

    fs, base = filesystem(folder)
    fs.create_dir(base, recursive=True)
    total = docs.select(id_col, text_col).mapInArrow(run, "members long, bytes long").agg(F.sum("members"), F.sum("bytes")).first()
    return {"members": total[0] or 0, "bytes": total[1] or 0}


class ByteRange(InputPartition):
    """Members of ``file`` whose headers start in [start, stop)."""

    def __init__(self, file: str, size: int, start: int, stop: int):
        self.file, self.size, self.start, self.stop = file, size, start, stop


def directory(fs: pafs.FileSystem, file: str) -> list[zipfile.ZipInfo]:
    with fs.open_input_file(file) as f:
        return zipfile.ZipFile(pa.PythonFile(f, "r") if not hasattr(f, "seekable") else f).infolist()


def read_member(fs: pafs.FileSystem, file: str, info: zipfile.ZipInfo) -> bytes:
    """One stored member by its offset, checked against the directory's checksum."""
    with fs.open_input_file(file) as f:
        return member_at(f, info)


def member_at(f, info: zipfile.ZipInfo) -> bytes:
    f.seek(info.header_offset)
    head = f.read(30)
    if head[:4] != b"PK\x03\x04" or info.compress_type != zipfile.ZIP_STORED:
        raise ValueError(f"no stored member at {info.header_offset}")
    name, extra = struct.unpack("<HH", head[26:30])
    f.seek(info.header_offset + 30 + name + extra)
    data = f.read(info.file_size)
    if len(data) != info.file_size or zlib.crc32(data) != info.CRC:
        raise ValueError(f"member at {info.header_offset} is damaged")
    return data


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.split = int(options.get("splitbytes", 16 << 20))
        self.retries = int(options.get("retries", 3))
        self.wait = float(options.get("waitseconds", 0.2))
        self.keep = options.get("errors", "raise") == "keep"
        self.batch = int(options.get("batchbytes", 8 << 20))

    def partitions(self) -> list[ByteRange]:
        fs, base = filesystem(self.folder)
        files = [f for f in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if f.is_file and f.path.endswith(".zip")]
        return [ByteRange(f.path, f.size, at, min(f.size, at + self.split)) for f in sorted(files, key=lambda f: f.path) for at in range(0, f.size, self.split)]

    def attempt(self, read: Callable[[], object]) -> object:
        for k in range(self.retries + 1):
            try:
                return read()
            except (OSError, ValueError, zipfile.BadZipFile):
                if k == self.retries:
                    raise
                time.sleep(self.wait * 2**k)

    def read(self, partition: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None or getattr(partition, "file", None) is None:
            return
        fs, _ = filesystem(self.folder)
        members = [i for i in self.attempt(lambda: directory(fs, partition.file)) if partition.start <= i.header_offset < partition.stop]
        rows, held = [], 0
        with fs.open_input_file(partition.file) as f:
            for info in members:
                data, error = None, None
                try:
                    data = member_at(f, info)
                except (OSError, ValueError):
                    try:  # again by a handle of its own; the other members aren't read anew
                        data = self.attempt(lambda info=info: read_member(fs, partition.file, info))
                    except (OSError, ValueError) as e:
                        if not self.keep:
                            raise
                        error = str(e)
                rows.append((partition.file, info.header_offset, info.filename, data, error))
                held += len(data or b"")
                if held >= self.batch:
                    yield batch_of(rows)
                    rows, held = [], 0
        if rows:
            yield batch_of(rows)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["archive", "offset", "member", "media", "error"])


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "archive string, offset long, member string, media binary, error string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader({k.lower(): v for k, v in self.options.items()})


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Members of the archives below ``folder``: archive, offset, member, media, error."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").options(**options).load(folder)


def features(media: DataFrame, id_col: str = "doc_id", id_type: str = "bigint") -> DataFrame:
    """Digests and features of stored images, from their bytes."""

    def make():
        def work(batch: pa.RecordBatch):
            out = []
            for name, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                samples, n_bytes = from_png(media)
                payload = np.ascontiguousarray(samples).tobytes()
                out.append((member_key(name), n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
            types = (pa.string(), *[pa.int64()] * 2, pa.string(), *[pa.int64()] * 2, pa.string(), pa.string())
            names = ["_key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        return work

    made = map_batches(media.select("member", "media"), "_key string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", make)
    return made.select(F.col("_key").cast(id_type).alias(id_col), *[c for c in made.columns if c != "_key"])


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store the texts of ``docs`` as media and describe them by what is read back."""
    spark = docs.sparkSession
    folder = shared_path(spark, "media")
    write_archives(docs, folder, id_col, text_col)
    return features(read_archives(spark, folder), id_col, docs.schema[id_col].dataType.simpleString())
