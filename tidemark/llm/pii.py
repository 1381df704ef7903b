"""Personal data in texts, by anchor expansion.

One pass of an Aho-Corasick automaton finds the anchors: at-signs, plus signs,
digits, schemes and cues of identifiers. At each anchor a local parser works out
where the item begins and ends and validates it:

* ``@``: the run of name characters to its left, labels joined by dots to its right;
* a digit: four dotted numbers of at most 255, or 14 to 19 digits in groups that pass Luhn's test;
* ``+``: a number of 10 to 15 digits;
* ``://``: a web address that names a person (credentials, or a user's path or parameter);
* a cue (IBAN, account, SSN): the identifier that follows it, with its check digits.

The last two are what the method adds (kinds ``url`` and ``account``).

Results in special cases: a null or empty text has no spans; texts are scanned
whole, in any length; an anchor inside an item of the same kind begins no other;
rows that repeat are scanned alike; an empty table gives no rows; other columns
play no part.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.spans import SPAN_TYPE, Intervals, Span, digest_columns, digest_schema, replaced, span_records
from tidemark.llm.text_batches import column, map_texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")

# The forms of the base kinds, as they go on from an anchor.
NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = "0123456789"

SCHEME = "://"
WEB_CUES = ("http://", "https://", "ftp://")
WEB = re.compile(r"[^\s<>\"']+")
PERSONAL = re.compile(r"(?i)^[^/?#@:]*:[^/?#@]*@|/(?:~|users?/|profile/)[^/?#]+|[?&](?:user|email|name|account|phone)=[^&#]+")
CUES = ("iban", "IBAN", "account", "Account", "ACCOUNT", "acct", "Acct", "ssn", "SSN")
AFTER_CUE = re.compile(r"(?:\s+(?:no|nr|number)\b)?\.?\s*[:#=]?\s*", re.IGNORECASE)
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
ACCOUNT = re.compile(r"[0-9][0-9-]{6,18}[0-9](?![0-9A-Za-z])")


@functools.lru_cache(maxsize=1)
def anchors():
    """The automaton, one a worker."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for word in ("@", "+", *DIGITS, SCHEME, *CUES):
        found.add_word(word, word)
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban(text: str) -> bool:
    compact = text.replace(" ", "")
    return 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def account(text: str, at: int, cue: str) -> tuple[int, int] | None:
    """The identifier after a cue that ends before ``at``."""
    if at - len(cue) > 0 and text[at - len(cue) - 1].isalnum():
        return None
    begin = AFTER_CUE.match(text, at).end()
    if begin == at:
        return None
    for form, valid in ((IBAN, iban), (SSN, None), (ACCOUNT, None)):
        m = form.match(text, begin)
        if m and (valid is None or valid(m[0])):
            return m.span()
    return None


def web(text: str, at: int) -> tuple[int, int, int | None]:
    """Around the scheme's end at ``at``: where the address begins, where the run of its signs ends, and where the address ends if it names a person."""
    for cue in WEB_CUES:
        if text.endswith(cue, 0, at):
            m = WEB.match(text, at)
            named = m and PERSONAL.search(m[0])
            return at - len(cue), m.end() if m else at, at + len(m[0].rstrip(".,;:!?)")) if named else None
    return at, at, None


def scan_text(text: str) -> tuple[list[Span], list[Span]]:
    base: list[Span] = []
    added: list[Span] = []
    email_end = ip_end = card_end = phone_end = run_end = web_end = 0
    for last, anchor in anchors().iter(text):
        if anchor in DIGITS:
            if last < run_end:
                continue
            # The first digit of a run, or the first after the last item's end.
            if last >= ip_end and (m := IP.match(text, last)):
                ip_end = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    base.append((last, ip_end, "ip"))
            if last >= card_end and (m := CARD.match(text, last)):
                card_end = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    base.append((last, card_end, "card"))
            # Inside a run that neither kind has taken whole, nothing else can begin; where an item ends in the run, the rest begins anew.
            end = last + 1
            while end < len(text) and text[end] in DIGITS:
                end += 1
            ends = [e for e in (ip_end, card_end) if last < e < end]
            run_end = min([end, *ends])
        elif anchor == "@":
            if last < email_end:
                continue
            begin = last
            while begin > email_end and text[begin - 1] in NAME_CHARS:
                begin -= 1
            if begin < last and (m := DOMAIN.match(text, last + 1)):
                email_end = m.end()
                base.append((begin, email_end, "email"))
        elif anchor == "+":
            if last >= phone_end and (m := PHONE.match(text, last)):
                phone_end = m.end()
                if 10 <= sum(c in DIGITS for c in m[0]) <= 15:
                    base.append((last, phone_end, "phone"))
        elif anchor == SCHEME:
            # A scheme inside an address begins no other one.
            if last >= web_end:
                begin, web_end, end = web(text, last + 1)
                if end:
                    added.append((begin, end, "url"))
        elif found := account(text, last + 1, anchor):
            added.append((*found, "account"))
    whole = Intervals(base)
    return base, [s for s in dict.fromkeys(added) if not whole.cover(s[0], s[1])]


def find_pii(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns ``keep`` and ``found``: the spans (kind, start, end) of each text."""
    return map_texts(lambda texts: {"found": [span_records([*b, *a]) for b, a in map(scan_text, texts)]}, docs, keep, text, pa.schema([("found", SPAN_TYPE)]))


def pii_digests(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of the base kinds, base_sha256 and all spans as one string."""
    return map_texts(lambda texts: digest_columns([scan_text(t) for t in texts], BASE, KINDS), docs, ("doc_id",), "text", digest_schema(BASE))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with every span in ``text`` replaced by its kind; a null text stays null."""
    others = tuple(c for c in docs.columns if c != text)

    def clean(texts: list[str]) -> dict[str, list]:
        return {"clean": [replaced(t, [*b, *a]) for t, (b, a) in zip(texts, map(scan_text, texts), strict=True)]}

    # The other columns travel in one struct, by number.
    number = {c: f"c{i}" for i, c in enumerate(others)}
    known = docs.select(F.struct(column(text).isNull().alias("missing"), *(column(c).alias(n) for c, n in number.items())).alias("others"), column(text).alias("body"))
    out = map_texts(clean, known, ("others",), "body", pa.schema([("clean", pa.string())]))
    return out.select(*(F.when(~F.col("others.missing"), F.col("clean")).alias(c) if c == text else F.col(f"others.{number[c]}").alias(c) for c in docs.columns))
