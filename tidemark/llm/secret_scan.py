"""Secrets in texts: patterns of known forms, and strings that a tokenizer finds random.

A byte-pair vocabulary has long pieces for what people write and few for what a
generator of keys does: a random string takes a token for every one or two
characters. Every run of key-like characters that mixes letters and digits, and
is no known digest, UUID, date or compound of plain parts, is encoded under the
vocabulary; a low ratio of characters to tokens makes it a span of kind
``random``. Runs inside a span of a known form are not reported twice.

Results in special cases: a null or empty text has no spans; texts are scanned
whole, in any length; rows that repeat are scanned alike; an empty table gives no
rows; other columns play no part.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.spans import SPAN_TYPE, Intervals, Span, digest_columns, digest_schema, span_records
from tidemark.llm.text_batches import map_texts

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")

# The forms of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

#: What every match of ASSIGN holds, in lower case.
CUES = ("password", "passwd", "secret", "token", "api_key", "apikey")

#: Least length and greatest ratio of characters to tokens of a random string.
LEAST_CHARS, MOST_RATIO = 20, 2.1
RUN = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST_CHARS},}}")
#: Lengths in hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 (fixed values).
DIGESTS = frozenset((32, 40, 56, 64, 96, 128))
HEX_ONLY = re.compile(r"[0-9a-f]+|[0-9A-F]+")
IDENTIFIER = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}|[0-9_/=+-]+|[0-9]{4}-?[0-9]{2}-?[0-9]{2}[T_-].*")
PLAIN_PART = re.compile(r"[A-Za-z]*|[0-9]{1,8}|[A-Za-z]{2,}[0-9]{1,4}")
MIXED = re.compile(r"(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])")


@functools.lru_cache(maxsize=2)
def vocabulary(path: str):
    """The tiktoken encoding of a rank file, one a worker."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def known_forms(text: str) -> list[Span]:
    """The base spans."""
    spans: list[Span] = []
    lower = text.lower()
    if any(cue in lower for cue in CUES):
        spans += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    spans += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return spans


def excluded(run: str) -> bool:
    """Known digests and identifiers."""
    if HEX_ONLY.fullmatch(run) and len(run) in DIGESTS or IDENTIFIER.fullmatch(run):
        return True
    return all(PLAIN_PART.fullmatch(part) for part in re.split(r"[-_/+=]", run))


def random_strings(text: str, base: list[Span], encode, most_ratio: float = MOST_RATIO) -> list[Span]:
    """Runs that take many tokens for their length, outside the base spans."""
    spans: list[Span] = []
    known = Intervals(base)
    for m in RUN.finditer(text):
        run, (a, b) = m[0], m.span()
        if MIXED.match(run) and not known.meets(a, b) and not excluded(run) and len(run) < most_ratio * len(encode(run)):
            spans.append((a, b, "random"))
    return spans


def scan(texts: list[str], path: str) -> list[tuple[list[Span], list[Span]]]:
    encode = vocabulary(path).encode_ordinary
    out = []
    for text in texts:
        base = known_forms(text)
        out.append((base, random_strings(text, base, encode)))
    return out


def find_secrets(docs: DataFrame, vocabulary_path: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns ``keep`` and ``found``: the spans (kind, start, end) of each text."""
    return map_texts(lambda texts: {"found": [span_records(b + a) for b, a in scan(texts, vocabulary_path)]}, docs, keep, text, pa.schema([("found", SPAN_TYPE)]))


def secret_digests(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, the counts of the base kinds, base_sha256 and all spans as one string."""
    return map_texts(lambda texts: digest_columns(scan(texts, vocabulary_path), BASE, KINDS), docs, ("doc_id",), "text", digest_schema(BASE))
