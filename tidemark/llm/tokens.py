"""Token ids by public tokenizers, a batch of texts at a time.

Both tokenizers first split a text at white space and never merge across the
split, so a text's ids are its pieces' ids in a row. A batch's bytes are cut into
pieces by array operations, equal pieces are found by Arrow's dictionary encoding,
and each distinct piece goes through the ``tokenizers`` library once; the ids are
then gathered for all places. Pieces are remembered across batches, in Arrow and
numpy arrays of bounded size.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that go through the tokenizer at a time (a single longer text makes a batch of its own).
SLICE_BYTES = 2_000_000
#: Pieces that a worker remembers at most, and the longest in bytes that it does (longer ones seldom come again).
MEMO_PIECES, MEMO_BYTES = 1_000_000, 14
#: New pieces that go through the library at a time: what it makes of one takes far more memory than its ids.
NEW_PIECES = 10_000


def _table(members: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(members)] = True
    return found


# Unicode's White_Space in ASCII, letters, and marks between which and a letter both tokenizers split.
_BLANK, _MARK = _table(b"\t\n\x0b\x0c\r "), _table(b".,!")
_LETTER = _table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
#: First bytes of what makes a text go through the library whole: special tokens (``<|``) and white space beyond ASCII.
_ODD = _table(b"<\xc2\xe1\xe2\xe3")


def _odd_places(data: np.ndarray) -> np.ndarray:
    """Where special tokens may begin, and white space of several bytes."""
    at = np.flatnonzero(_ODD[data])
    if not len(at):
        return at
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    a, b, c = padded[at], padded[at + 1], padded[at + 2]
    found = (a == 0x3C) & (b == 0x7C) | (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    found |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
    return at[found]


def cut_pieces(data: np.ndarray, edges: np.ndarray, blank_joins: bool) -> np.ndarray:
    """Where pieces begin in the UTF-8 bytes of texts that lie between ``edges``.

    ``blank_joins``: a single blank before a word belongs to it, and of a run of white space that ends before a word
    the last character is apart; else runs of white space are pieces of their own.
    """
    begin = np.zeros(len(data), bool)
    filled = edges[:-1] < edges[1:]
    begin[edges[:-1][filled]] = True
    blank, mark = _BLANK[data], _MARK[data]
    begin[1:] |= blank[1:] & ~blank[:-1]
    if blank_joins:
        before_word = blank[:-1] & ~blank[1:]
        before_word[edges[1:-1][(edges[1:-1] > 0) & (edges[1:-1] < len(data))] - 1] = False  # the next text's word
        begin[:-1] |= before_word
        begin[1:] |= ~blank[1:] & blank[:-1] & (data[:-1] != 0x20)
    else:
        begin[1:] |= ~blank[1:] & blank[:-1]
    begin[1:] |= mark[1:] & _LETTER[data[:-1]]
    begin[2:] |= mark[2:] & (data[:-2] == 0xC3) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)
    for text in np.unique(np.searchsorted(edges, _odd_places(data), side="right") - 1).tolist():
        begin[edges[text] + 1 : edges[text + 1]] = False
    return np.flatnonzero(begin)


class PieceTokenizer:
    """Ids of texts as unsigned 32-bit integers. ``kind``: byte (blanks belong to words) or word (white space is dropped)."""

    def __init__(self, path: str, kind: str):
        # A task has one core: threads of the library's own only cost it time and memory.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.blank_joins = {"byte": True, "word": False}[kind]
        self._forget()

    def _forget(self) -> None:
        """The memo: pieces, their ids in a row, and where each piece's ids begin (one more than there are pieces)."""
        self.pieces, self.ids, self.places = pa.array([], pa.binary()), np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _encoded(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece has, and the ids in a row."""
        sizes, made = [np.empty(0, np.int64)], [np.empty(0, np.uint32)]
        for begin in range(0, len(pieces), NEW_PIECES):
            part = [p.decode("utf-8", "replace") for p in pieces.slice(begin, NEW_PIECES).to_pylist()]
            ids = [e.ids for e in self.library.encode_batch_fast(part, add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            made.append(np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes[-1].sum())))
        return np.concatenate(sizes), np.concatenate(made)

    def _table_for(self, wanted: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each wanted piece is in a table, and the table's ids and places; new pieces are encoded and remembered."""
        place = pc.fill_null(pc.index_in(wanted, value_set=self.pieces), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = wanted.filter(pa.array(place < 0))
        sizes, made = self._encoded(new)
        ids, places = np.concatenate([self.ids, made]), np.concatenate([self.places, self.places[-1] + np.cumsum(sizes)])
        place[place < 0] = len(self.pieces) + np.arange(len(new))
        short = pc.binary_length(new).to_numpy() <= MEMO_BYTES
        if len(self.pieces) + int(short.sum()) > MEMO_PIECES:
            self._forget()
        self.pieces = pa.concat_arrays([self.pieces, new.filter(pa.array(short))])
        self.ids = np.concatenate([self.ids, made[np.repeat(short, sizes)]])
        self.places = np.concatenate([self.places, self.places[-1] + np.cumsum(sizes[short])])
        return place, ids, places

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each text followed by ``end_id``, and where each text's ids end."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        edges = offsets - offsets[0]
        begins = cut_pieces(data, edges, self.blank_joins)
        bounds = np.append(begins, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        place, ids, places = self._table_for(pieces.dictionary)
        # The end is one more entry of the table, which follows each text's pieces.
        until = np.searchsorted(begins, edges[1:])
        entry = np.insert(place[pieces.indices.to_numpy()] if len(begins) else np.empty(0, np.int64), until, len(places) - 1)
        ids, places = np.append(ids, np.uint32(end_id)), np.append(places, places[-1] + 1)
        first, sizes = places[entry], places[entry + 1] - places[entry]
        ends = np.cumsum(sizes)
        flat = ids[np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        return flat, ends[until + np.arange(len(texts))]


def encoded_slices(batch: pa.RecordBatch, text: str, tokenizer: PieceTokenizer, end_id: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of ``batch`` of bounded size with their ids and ends (see ``PieceTokenizer.encode``); a null text counts as empty."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, begin = np.concatenate([[0], np.cumsum(sizes)]), 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(total, total[begin] + SLICE_BYTES, side="right")) - 1)
        part = batch.slice(begin, end - begin)
        yield part, *tokenizer.encode(part.column(text), end_id)
        begin = end


@functools.lru_cache(maxsize=4)
def piece_tokenizer(path: str, kind: str) -> PieceTokenizer:
    """One tokenizer a worker."""
    return PieceTokenizer(path, kind)


def default_path(name: str) -> str:
    """Where the public vocabulary files are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)
