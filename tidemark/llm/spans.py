"""Columns that operators on character spans return."""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import pyarrow as pa

#: (start, end, kind), code points, end exclusive.
Span = tuple[int, int, str]

SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def joined(spans: list[Span], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then by kind as listed, joined by commas."""
    order = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], order[s[2]], s[1])))


def digest_columns(found: list[tuple[list[Span], list[Span]]], base: tuple[str, ...], kinds: tuple[str, ...]) -> dict[str, list]:
    """Counts of the base kinds, the base spans' SHA-256 and all spans, a row for each text's (base, added) spans."""
    out: dict[str, list] = {f"n_{k}": [sum(s[2] == k for s in b) for b, _ in found] for k in base}
    out["base_sha256"] = [hashlib.sha256(joined(b, kinds).encode()).hexdigest() for b, _ in found]
    out["spans"] = [joined(b + a, kinds) for b, a in found]
    return out


def digest_schema(base: tuple[str, ...]) -> pa.Schema:
    return pa.schema([*((f"n_{k}", pa.int64()) for k in base), ("base_sha256", pa.string()), ("spans", pa.string())])


class Intervals:
    """Disjoint intervals that cover what ``spans`` do, for look-ups by bisection."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b, _ in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, begin: int, end: int) -> bool:
        """Whether any span has a character in common with ``begin`` to ``end``."""
        at = bisect_right(self.ends, begin)
        return at < len(self.starts) and self.starts[at] < end

    def cover(self, begin: int, end: int) -> bool:
        """Whether one interval holds all of ``begin`` to ``end``."""
        at = bisect_right(self.starts, begin) - 1
        return at >= 0 and end <= self.ends[at]


def span_records(spans: list[Span]) -> list[dict]:
    return [{"kind": k, "start": a, "end": b} for a, b, k in sorted(spans)]


def replaced(text: str, spans: list[Span], label: str = "<{}>") -> str:
    """The text with every span replaced by its kind; overlapping spans count as one, named for the first."""
    out, at, end = [], 0, 0
    for a, b, k in sorted(spans):
        if a >= end:
            out += [text[at:a], label.format(k.upper())]
        end = max(end, b)
        at = end
    return "".join([*out, text[at:]])
