"""Digest columns of secrets and personal data, and kept columns of the rules, on odd rows."""

import hashlib

import pytest

from tidemark.llm.pii import pii_digests
from tidemark.llm.quality_rules import apply_rules
from tidemark.llm.secret_scan import secret_digests
from tidemark.llm.tokens import default_path

SECRET, PERSON = "password = abcdef1", "write to a.b@c.de now"


def digest(*spans: str) -> str:
    return hashlib.sha256(",".join(spans).encode()).hexdigest()


@pytest.mark.parametrize(("kind", "text", "span", "count"), [("secret", SECRET, "assign:0:18", "n_assign"), ("person", PERSON, "email:9:17", "n_email")])
def test_nulls_repeats_and_clashing_columns(spark, kind, text, span, count):
    rows = [(1, None), (2, ""), (3, text), (3, text), (None, text), (4, "é" * 100_000), (5, "x" * 50_000 + " " + text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as t", "2 as c0", "3 as spans", "4 as base_sha256", "5 as n_assign", "6 as `a.b`", "7 as n_email")
    made = secret_digests(docs, default_path("byte_bpe_50k.tiktoken")) if kind == "secret" else pii_digests(docs)
    found = made.collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(i) for i, _ in rows)
    for r in found:
        n = 0 if r.doc_id in (1, 2, 4) else 1
        assert r[count] == n
        if n == 0:
            assert r.base_sha256 == digest()
        elif r.doc_id != 5:
            assert r.base_sha256 == digest(span) and span in r.spans.split(",")
        else:
            name, start, end = span.split(":")
            assert r.base_sha256 == digest(f"{name}:{int(start) + 50_001}:{int(end) + 50_001}")


def test_rules_keep_any_column(spark):
    docs = spark.createDataFrame([(1, "some words here"), (2, None)], "doc_id long, text string").selectExpr("*", "'k' as __text", "'l' as __words", "9 as n_words", "8 as kept", "7 as `a.b`", "6 as words")
    found = apply_rules(docs, keep=("doc_id", "text", "__text", "__words", "n_words", "kept", "a.b", "words"))
    assert found.columns == ["doc_id", "text", "__text", "__words", "a.b", "words", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert [(r.doc_id, r.text, r["__text"], r["a.b"], r.words, r.n_words, r.kept) for r in found.orderBy("doc_id").collect()] == [(1, "some words here", "k", 7, 6, 3, False), (2, None, "k", 7, 6, 0, False)]
