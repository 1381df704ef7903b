"""Best-fit packing of tokenised documents into sequences of a fixed length.

Bounded-space online best-fit: every partition of documents is one stream. A
fixed number of bins is open at a time; a bitset has a bit for each free space
that some open bin has, so the tightest bin that still takes a piece is the
lowest set bit at or above the piece's length. When all bins are open and a
piece fits none, the fullest closes. A piece goes out as soon as it is placed:
no shuffle, and the memory is that of the open bins' numbers.

Ordering a slice of the stream by length, longest first, before placing it lets
short pieces fill what long ones leave; a slice is bounded in pieces and tokens.

Results in special cases: a null or empty text is a document of the end token
alone; a document of exactly the sequence length is one piece that fills a
sequence; repeated rows are packed as often as they occur; a null ``doc_id``
stays null; an empty table gives no pieces; a kept column with the name of a
result column is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemark.llm.text_batches import map_batches
from tidemark.llm.tokens import encoded_slices, piece_tokenizer

#: Sequence length, open bins a stream, tokens and pieces ordered at a time.
SEQUENCE, OPEN_BINS, SLICE_TOKENS, SLICE_PIECES = 2048, 1024, 4_000_000, 20_000

PLACED = pa.schema([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


class OpenBins:
    """A fixed number of open bins, found by free space."""

    def __init__(self, capacity: int, limit: int, first_bin: int):
        self.capacity, self.limit = capacity, limit
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0
        self.count = 0
        self.next_bin = first_bin

    def _pop(self, free: int) -> int:
        stack = self.by_free[free]
        number = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.count -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it at which a piece of ``length`` goes."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._pop(free)
        else:
            if self.count == self.limit:
                self._pop((self.bits & -self.bits).bit_length() - 1)
            free, number = self.capacity, self.next_bin
            self.next_bin += 1
        left = free - length
        if left:
            self.by_free[left].append(number)
            self.bits |= 1 << left
            self.count += 1
        return number, self.capacity - free


def cut(n_tokens: int, sequence: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first, which has the rest."""
    first = n_tokens % sequence or sequence
    return [(0, first)] + [(at, sequence) for at in range(first, n_tokens, sequence)]


def _pack_stream(tokenizer: str, end_id: int, sequence: int, open_bins: int):
    width = 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = piece_tokenizer(tokenizer, "byte")
        context = TaskContext.get()
        bins = OpenBins(sequence, open_bins, (context.partitionId() if context else 0) << 40)
        held, waiting, n_waiting = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            """Place the slice, longest pieces first, and send it out."""
            rows = sorted(waiting, key=lambda r: -r[3])
            source = pa.Table.from_batches(held)
            step = 2_000
            for at in range(0, len(rows), step):
                row, piece, start, length, ids = zip(*rows[at : at + step], strict=True)
                sequence_id, offset = zip(*map(bins.place, length), strict=True)
                kept = source.take(pa.array(row)).combine_chunks()
                columns = [c.chunk(0) for c in kept.columns]
                made = [pa.array(v, f.type) for v, f in zip((piece, start, length, ids, sequence_id, offset), PLACED, strict=True)]
                yield pa.RecordBatch.from_arrays(columns[:-1] + made, names=[*kept.schema.names[:-1], *PLACED.names])

        rows_held = 0
        for batch in batches:
            for part, ids, ends in encoded_slices(batch, "t", tokens, end_id):
                # The texts themselves are no longer needed.
                held.append(part.set_column(part.num_columns - 1, "t", pa.nulls(part.num_rows, pa.int8())))
                data, begin = ids.tobytes(), 0
                for i, end in enumerate(ends.tolist()):
                    for k, (start, length) in enumerate(cut(end - begin, sequence)):
                        at = (begin + start) * width
                        waiting.append((rows_held + i, k, start, length, data[at : at + length * width]))
                    n_waiting += end - begin
                    begin = end
                rows_held += part.num_rows
                if n_waiting >= SLICE_TOKENS or len(waiting) >= SLICE_PIECES:
                    yield from flush()
                    held, waiting, n_waiting, rows_held = [], [], 0, 0
        if waiting:
            yield from flush()

    return run


def pack_documents(
    docs: DataFrame, tokenizer: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", end_id: int = 0, sequence: int = SEQUENCE, open_bins: int = OPEN_BINS
) -> DataFrame:
    """Columns ``keep`` of each document, repeated for each of its pieces, with

    piece, start, length, ids (little-endian unsigned 32-bit), sequence_id, offset.
    """
    return map_batches(_pack_stream(tokenizer, end_id, sequence, open_bins), docs, keep, text, PLACED)
