"""Terms of texts: runs of ASCII letters and of all characters beyond ASCII, with A-Z lower-cased.

A batch's bytes are worked on as arrays; equal terms are found by Arrow's dictionary
encoding, so that what follows counts numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The same terms as a regular expression that both engines take (fixed value of the contract).
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

_IN_TERM = np.ones(256, bool)
_IN_TERM[[b for b in range(128) if not chr(b).isalpha()]] = False
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct terms in UTF-8, the number of each occurrence's term, and the text in which it occurs; a null text has none."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    edges = offsets - offsets[0]
    inside = _IN_TERM[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = edges[:-1][edges[:-1] < edges[1:]]
    begins[first] = inside[first]  # a text's first term doesn't continue the text before
    packed = _LOWER[data[inside]]
    places = np.flatnonzero(begins)
    bounds = np.append(np.cumsum(inside)[places] - 1, len(packed)).astype(np.int32)
    terms = pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(bounds), pa.py_buffer(packed)]).dictionary_encode()
    return terms.dictionary, terms.indices.to_numpy().astype(np.int64), np.searchsorted(edges, places, side="right") - 1


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys in order, and the sum of each array's values by key."""
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return (keys[begin], *(np.add.reduceat(v[order], begin) for v in values))


def slices(batch: pa.RecordBatch, text: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts have about ``most_bytes`` at most (a single longer text makes one of its own)."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + most_bytes, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end
