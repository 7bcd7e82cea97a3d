"""Token-id files of independent zstandard frames, after the public "zstd seekable format".

A file is a sequence of zstandard frames, each holding the ids of some whole documents as little-endian unsigned 32-bit integers, then one
skippable frame with an entry for every frame: compressed size, decompressed size and the low 32 bits of the XXH64 of what it decompresses
to. The last nine bytes give the number of frames, a descriptor and a magic number. Readers take the table from the end of the file, find
the frame by the running sum of the decompressed sizes, and decompress only that one. Documents are in ascending order of doc_id (nulls
first, equal ids by a hash of their text, then by text), and each frame ends at the end of a document.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import qualified
from .common import cut, filesystem, new_folder
from .tokens import default_path, encoder

#: Fixed values of the zstd seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, CHECKSUM_FLAG = 0x184D2A5E, 0x8F92EAB1, 0x80

END = bytes(4)  # the id 0 that ends each document


class FrameWriter:
    """Writes whole documents to a binary stream; a frame is closed once it holds frame_bytes."""

    def __init__(self, out, level: int = 3, frame_bytes: int = 1 << 20):
        import zstandard

        self.out, self.frame_bytes, self.pack = out, frame_bytes, zstandard.ZstdCompressor(level=level).compress
        self.held: list[bytes] = []
        self.size = self.total = 0
        self.table: list[bytes] = []

    def add(self, ids: bytes) -> int:
        """Append a document; the result is where it starts among all bytes of the file, decompressed."""
        at = self.total
        self.held.append(ids)
        self.size += len(ids)
        self.total += len(ids)
        if self.size >= self.frame_bytes:
            self.cut()
        return at

    def cut(self) -> None:
        import xxhash

        if self.held:
            data = b"".join(self.held)
            frame = self.pack(data)
            self.out.write(frame)
            self.table.append(struct.pack("<III", len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
            self.held, self.size = [], 0

    def close(self) -> None:
        self.cut()
        foot = struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, 12 * len(self.table) + 9) + b"".join(self.table) + foot)


class FrameReader:
    """Random access to a file of FrameWriter through a seekable binary stream. Decompresses only the frames asked for; one stays in memory."""

    def __init__(self, source):
        source.seek(0, 2)
        end = source.tell()
        source.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("not a seekable file with checksums")
        source.seek(end - 9 - 12 * n)
        self.source, self.table = source, list(struct.iter_unpack("<III", source.read(12 * n)))
        self.places = [0, *accumulate(x[0] for x in self.table)]
        self.starts = [0, *accumulate(x[1] for x in self.table)]
        self.held = (-1, b"")

    def frame(self, k: int) -> bytes:
        import xxhash
        import zstandard

        if self.held[0] != k:
            packed, size, check = self.table[k]
            self.source.seek(self.places[k])
            data = zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=size)
            if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {k} is damaged")
            self.held = (k, data)
        return self.held[1]

    def read(self, at: int, size: int) -> bytes:
        """The bytes at a place among all decompressed bytes; documents never leave their frame."""
        if not size:
            return b""
        k = bisect_right(self.starts, at) - 1
        return self.frame(k)[at - self.starts[k] : at - self.starts[k] + size]


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, level: int = 3, frame_bytes: int = 1 << 20) -> DataFrame:
    """Encode docs (doc_id, text; other columns are ignored) and write one file for each range of doc_id into the folder, on the executors.

    Returns the index: file, part (files are in ascending order of it), doc_id, at and size (bytes in the file, decompressed). A file gets
    its final name only when whole, and the index names the attempt that was kept, so retried or lost tasks leave no wrong file behind.
    A null text counts as empty, and an empty one is the end id alone. Repeated rows are written each; no rows give no file.
    """
    path = tokenizer or default_path()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, writer, out = encoder(path), TaskContext.get().partitionId(), None, None
        fs, inner = filesystem(folder)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.ids.zst"
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                fs.create_dir(inner, recursive=True)
                out = fs.open_output_stream(f"{inner}/.{name}", compression=None)
                writer = FrameWriter(out, level, frame_bytes)
            placed = [(writer.add(x + END), len(x) + 4) for x in enc.encode_all(batch.column("text").to_pylist())]
            n = len(placed)
            at, size = zip(*placed, strict=True)
            yield pa.record_batch([pa.array([name] * n), pa.array([part] * n, pa.int32()), batch.column("doc_id"), pa.array(at, pa.int64()), pa.array(size, pa.int64())], names=["file", "part", "doc_id", "at", "size"])
        if writer:
            writer.close()
            out.close()
            fs.move(f"{inner}/.{name}", f"{inner}/{name}")

    folder = qualified(docs.sparkSession, folder)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))  # spreads rows of one doc_id, or of none
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, F.asc("doc_id"), F.asc("hash")).sortWithinPartitions(F.asc("doc_id"), F.asc("hash"), F.asc("text")).drop("hash")
    # the index is written before anything is read, so that all files exist and each is named by the attempt that counts
    return cut(ranged.mapInArrow(task, "file string, part int, doc_id long, at long, size long"), "token-index")


def _documents(batches: Iterator[pa.RecordBatch], folder: str, rows: int = 500) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Stretches of the index with the ids of their documents, few at a time."""
    fs, inner = filesystem(folder)
    name, reader = None, None
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            part, got = batch.slice(k, rows), []
            for f, at, size in zip(*(part.column(x).to_pylist() for x in ("file", "at", "size")), strict=True):
                if f != name:
                    name, reader = f, FrameReader(fs.open_input_file(f"{inner}/{f}"))
                got.append(reader.read(at, size))
            yield part, got


def read(index: DataFrame, folder: str) -> DataFrame:
    """Read documents back by the index: its columns and ids (binary, little-endian unsigned 32-bit integers)."""
    folder = qualified(index.sparkSession, folder)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, got in _documents(batches, folder):
            yield pa.record_batch([*part.columns, pa.array(got, pa.binary())], names=[*part.schema.names, "ids"])

    return index.mapInArrow(task, "file string, part int, doc_id long, at long, size long, ids binary")


def starts(index: DataFrame) -> DataFrame:
    """part, before: how many ids all earlier files hold. One row for each file."""
    from pyspark.sql import Window

    # one row for each file, bounded by the number of tasks that wrote
    per_file = index.groupBy("part").agg(F.sum(F.col("size") / 4).cast("long").alias("n"))
    return per_file.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))


def digest(index: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, all but start from the ids that the files give back."""
    folder = qualified(index.sparkSession, folder)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, got in _documents(batches, folder):
            sizes = pa.array([len(x) // 4 for x in got], pa.int64())
            yield pa.record_batch([part.column("part"), part.column("doc_id"), part.column("at"), sizes, pa.array([zlib.crc32(x) for x in got], pa.int64())], names=["part", "doc_id", "at", "n_tokens", "ids_crc32"])

    own = index.mapInArrow(task, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return own.join(F.broadcast(starts(index)), "part").select("doc_id", (F.col("before") + F.col("at") / 4).cast("long").alias("start"), "n_tokens", "ids_crc32")


def op5(spark, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-files")
    index = write(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return digest(index, folder)
