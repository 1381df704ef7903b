"""Token ids in binary files with Elias-Fano coded document boundaries.

A file holds a run of documents in ascending ``doc_id`` order:

* the ids of all documents one after the other, written as they come;
* two Elias-Fano sequences: the documents' end positions and the ``doc_id``s
  less the smallest. Each is n non-decreasing numbers up to u: the low
  ``floor(log2(u / n))`` bits of each are stored in a row, the high bits as a
  unary bit vector of at most 3 n bits; the place of every 256th set bit, in 32
  bits, is the directory from which ``select`` starts. About ``2 + log2(u / n)``
  bits a number instead of 64; only the bits around what is asked for are
  unpacked, and no table of whole numbers is made;
* a trailer: magic, width of an id in bytes, numbers of documents, of documents
  with a null ``doc_id`` (they come first) and of ids, smallest ``doc_id``, sizes.

Spark orders the documents by a range partitioning on ``doc_id`` (ties by a hash
of the text, so that a ``doc_id`` with many rows doesn't go to one task); each
partition streams into one or more files of bounded size in the shared folder. A
file's name is new for every attempt of a task and only files in the manifest
count, so a lost executor leaves nothing but unread files behind.

Results in special cases: a null or empty text is the end id alone; rows with a
null ``doc_id`` come first; repeated rows are all kept, in the order of their
texts' hashes; an empty table gives no files and no rows; an id that doesn't fit
the width is an error; other columns play no part.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tokens import encoded_slices, piece_tokenizer
from tidemark.session import materialize, new_path, ship_package

MAGIC = b"TIDEEF02"
TRAILER = struct.Struct("<8sBQQQqQQ")
#: Ids and documents after which a partition begins another file.
FILE_IDS, FILE_DOCS = 64_000_000, 4_000_000
#: Documents and ids that a reader gives out at a time (a longer document comes alone).
RUN_DOCS, RUN_IDS = 2_000, 1_000_000
#: Most tasks that read files at a time.
MOST_TASKS = 10_000


class EliasFano:
    """Non-decreasing non-negative integers in near-minimal space."""

    #: Set bits from one place in the directory to the next; numbers whose low bits are packed at a time.
    EVERY, PACK = 256, 1 << 16
    HEAD = struct.Struct("<QBQQ")

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, directory: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.directory = n, low_bits, low, high, directory

    @staticmethod
    def encode(values: np.ndarray) -> EliasFano:
        n, values = len(values), np.asarray(values, dtype=np.uint64)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (max(1, top) // max(1, n)).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        packed = [np.packbits(((values[at : at + EliasFano.PACK, None] >> shifts) & np.uint64(1)).astype(np.uint8).reshape(-1), bitorder="little") for at in range(0, n, EliasFano.PACK)]
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(places[-1]) // 8 + 1) if n else 0, np.uint8)
        np.bitwise_or.at(high, places >> 3, (1 << (places & 7)).astype(np.uint8))
        if n and places[-1] >= 1 << 32:
            raise ValueError("too many numbers for one sequence")
        return EliasFano(n, low_bits, np.concatenate([np.empty(0, np.uint8), *packed]), high, places[:: EliasFano.EVERY].astype("<u4"))

    def _set_bits(self, begin: int, end: int) -> np.ndarray:
        """The places of the set bits ``begin`` to ``end`` (exclusive): from the directory on, as far as needed."""
        skip = begin % self.EVERY
        first = int(self.directory[begin // self.EVERY])
        size = (end - begin + skip) // 2 + 16
        while True:
            part = np.unpackbits(self.high[first // 8 : first // 8 + size], bitorder="little")
            part[: first % 8] = 0
            found = np.flatnonzero(part)
            if len(found) >= end - begin + skip:
                return found[skip : skip + end - begin] + first // 8 * 8
            size *= 2

    def decode(self, begin: int, end: int) -> np.ndarray:
        """The numbers ``begin`` to ``end`` (exclusive)."""
        if begin >= end:
            return np.empty(0, np.uint64)
        values = (self._set_bits(begin, end) - np.arange(begin, end)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            first = begin * self.low_bits
            bits = np.unpackbits(self.low[first // 8 : -(-end * self.low_bits // 8)], bitorder="little")[first % 8 :]
            for i, row in enumerate(bits[: (end - begin) * self.low_bits].reshape(-1, self.low_bits).T):
                values |= row.astype(np.uint64) << np.uint64(i)
        return values

    def select(self, index: int) -> int:
        """The number at ``index``."""
        return int(self.decode(index, index + 1)[0])

    def to_bytes(self) -> bytes:
        return self.HEAD.pack(self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.directory.tobytes()

    @staticmethod
    def from_bytes(data: bytes) -> EliasFano:
        n, low_bits, n_low, n_high = EliasFano.HEAD.unpack_from(data)
        at = EliasFano.HEAD.size
        low, high = np.frombuffer(data, np.uint8, n_low, at), np.frombuffer(data, np.uint8, n_high, at + n_low)
        return EliasFano(n, low_bits, low, high, np.frombuffer(data, "<u4", -1, at + n_low + n_high))


def _open(path: str):
    """The file system of a path and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1) if path.startswith("s3a://") else path)


class TokenFileWriter:
    """One file of documents in order: ids go out at once, of each document two numbers are held."""

    def __init__(self, path: str, width: int):
        self.path, self.width = path, width
        self.sizes: list[np.ndarray] = []
        self.doc_ids: list[np.ndarray] = []
        self.n_docs = self.n_null = self.n_ids = 0
        system, place = _open(path)
        system.create_dir(place.rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(place)

    def add(self, doc_ids: pa.Array, ids: np.ndarray, ends: np.ndarray) -> None:
        """Documents whose ids follow one another in ``ids`` and end at ``ends``; null doc_ids come before all others."""
        if len(ids) and int(ids.max()) >> (8 * self.width):
            raise ValueError(f"an id takes more than {self.width} bytes")
        self.out.write(ids.astype(f"<u{self.width}").tobytes())
        self.sizes.append(np.diff(ends, prepend=0))
        self.doc_ids.append(doc_ids.drop_null().to_numpy())
        self.n_docs, self.n_null, self.n_ids = self.n_docs + len(ends), self.n_null + doc_ids.null_count, self.n_ids + len(ids)

    def close(self) -> None:
        known = np.concatenate([np.empty(0, np.int64), *self.doc_ids]).astype(np.int64)
        least = int(known[0]) if len(known) else 0
        ends = EliasFano.encode(np.cumsum(np.concatenate([np.empty(0, np.int64), *self.sizes]))).to_bytes()
        numbers = EliasFano.encode(known.view(np.uint64) - np.uint64(least & (2**64 - 1))).to_bytes()
        self.out.write(ends + numbers + TRAILER.pack(MAGIC, self.width, self.n_docs, self.n_null, self.n_ids, least, len(ends), len(numbers)))
        self.out.close()


class TokenFile:
    """A file opened for reading: any document's boundaries by ``select``, or runs of documents with their ids."""

    def __init__(self, path: str):
        system, place = _open(path)
        self.file = system.open_input_file(place)
        size = self.file.size()
        self.file.seek(size - TRAILER.size)
        magic, self.width, self.n_docs, self.n_null, self.n_ids, self.least, n_ends, n_numbers = TRAILER.unpack(self.file.read(TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a token file")
        self.file.seek(self.n_ids * self.width)
        self.ends, self.numbers = EliasFano.from_bytes(self.file.read(n_ends)), EliasFano.from_bytes(self.file.read(n_numbers))

    def start(self, index: int) -> int:
        """Ids before the document at ``index``."""
        return self.ends.select(index - 1) if index else 0

    def doc_ids(self, begin: int, end: int) -> pa.Array:
        known = self.numbers.decode(max(begin, self.n_null) - self.n_null, max(end, self.n_null) - self.n_null) + np.uint64(self.least & (2**64 - 1))
        return pa.concat_arrays([pa.nulls(max(0, min(end, self.n_null) - begin), pa.int64()), pa.array(known.view(np.int64))])

    def ids(self, begin: int, end: int) -> np.ndarray:
        """The ids at places ``begin`` to ``end`` (exclusive)."""
        self.file.seek(begin * self.width)
        return np.frombuffer(self.file.read((end - begin) * self.width), f"<u{self.width}")

    def runs(self) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """doc_ids, where each document begins (and the last ends) and the ids, a run of documents at a time."""
        at, start = 0, 0
        while at < self.n_docs:
            ends = self.ends.decode(at, min(self.n_docs, at + RUN_DOCS)).astype(np.int64)
            n = max(1, int(np.searchsorted(ends, start + RUN_IDS, side="right")))
            bounds = np.concatenate([[start], ends[:n]])
            yield self.doc_ids(at, at + n), bounds, self.ids(start, int(bounds[-1]))
            at, start = at + n, int(bounds[-1])


MANIFEST = ("path string", "part int", "number int", "n_docs long", "n_ids long")


def _write_partition(folder: str, tokenizer: str, kind: str, width: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, partition, number, file = piece_tokenizer(tokenizer, kind), TaskContext.get().partitionId(), 0, None

        def closed() -> pa.RecordBatch:
            file.close()
            row = zip([file.path, partition, number, file.n_docs, file.n_ids], (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in row], names=[f.split()[0] for f in MANIFEST])

        for batch in batches:
            for part, ids, ends in encoded_slices(batch, "t", tokens, end_id):
                file = file or TokenFileWriter(f"{folder}/{uuid.uuid4().hex}.ids", width)
                file.add(part.column("doc_id"), ids, ends)
                if file.n_ids >= FILE_IDS or file.n_docs >= FILE_DOCS:
                    yield closed()
                    file, number = None, number + 1
        if file:
            yield closed()

    return run


def write_token_files(docs: DataFrame, tokenizer: str, kind: str, end_id: int, width: int = 2, folder: str | None = None) -> DataFrame:
    """Write all documents; the manifest: path, part, number, n_docs, n_ids, first (ids in the files before)."""
    spark = docs.sparkSession
    ship_package(spark)
    folder = folder or new_path(spark, "token-files")
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("t"))
        .withColumn("tie", F.xxhash64("t"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .drop("tie")
    )
    manifest = ordered.mapInArrow(_write_partition(folder, tokenizer, kind, width, end_id), ", ".join(MANIFEST))
    manifest = materialize(manifest, "manifest")
    # One row a file: far fewer than documents.
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, start and ids (little-endian, ``width`` bytes each) of all documents in the files of ``manifest``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), strict=True):
                for doc_ids, bounds, ids in TokenFile(path).runs():
                    offsets = ((bounds - bounds[0]) * width).astype(np.int32)
                    data = pa.Array.from_buffers(pa.binary(), len(doc_ids), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype(f"<u{width}"))])
                    yield pa.RecordBatch.from_arrays([doc_ids, pa.array(bounds[:-1] + first, pa.int64()), data], names=["doc_id", "start", "ids"])

    # A task a file, or a few: left to itself, adaptive execution would put the small manifest in one task.
    tasks = max(1, min(manifest.count(), MOST_TASKS))
    return manifest.select("path", "first").repartition(tasks).mapInArrow(run, "doc_id long, start long, ids binary")


def token_digests(read: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids, read as unsigned 32-bit integers."""
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
