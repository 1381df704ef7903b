"""Scans for secrets and personal data: the plain patterns, texts made to be slow, and how many random keys are found."""

import random
import re
import time

import numpy as np
import pytest

from tidemark.llm import pii, secret_scan, spans, tokens, topk

VOCABULARY = tokens.default_path("byte_bpe_50k.tiktoken")


def test_base_secrets_match_the_plain_patterns():
    rnd = random.Random(2)
    parts = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "Api_Key", "ſecret", "toKen", '"', "'", " ", "  ", ":", "=", "\n", "abcdef", "x/+_.=-", "12345", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeef", "é", "AKIAAKIA"]
    for _ in range(20_000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        plain = [(*m.span(), "assign") for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII) if len(m[2]) >= 6]
        plain += [(*m.span(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        plain += [(*m.span(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
        assert sorted(secret_scan.known_forms(text)) == sorted(plain), text


@pytest.mark.parametrize("text", ["token = abcdef123 " * 60_000, "token=abcdef " * 80_000, "x9Kq2Zt7Lm4Vb8Nc3Wd6Rf1Hs5 " * 36_000, "password" + " " * 1_000_000, "a" * 1_000_000 + "1", "Ab1" * 330_000])
def test_secret_scan_is_linear(text):
    secret_scan.scan(["warm up x9Kq2Zt7Lm4Vb8Nc3Wd6Rf1Hs5"], VOCABULARY)
    begin = time.process_time()
    secret_scan.scan([text], VOCABULARY)
    assert time.process_time() - begin < 8


@pytest.mark.parametrize("text", ["http://" + "http://a/" * 110_000, "http://" + "a:" * 500_000, "a@b.cd " * 140_000, "1.2.3.4 " * 120_000, "@" * 1_000_000, "+1" * 500_000, "iban " * 200_000, "iban" + " " * 1_000_000, "1" * 1_000_000, "1." * 500_000, "http://x/~me " * 70_000])
def test_pii_scan_is_linear(text):
    begin = time.process_time()
    pii.scan_text(text)
    assert time.process_time() - begin < 8


def test_added_kinds():
    text = "see http://joe:pw@host.example/x, https://host.example/plain and http://h.example/~ann/a http://b.example/?email=q@r.st; account no: 12345678-90, IBAN DE89 3704 0044 0532 0130 00, ssn 123-45-6789"
    base, more = pii.scan_text(text)
    assert [(k, text[a:b]) for a, b, k in sorted(more)] == [
        ("url", "http://joe:pw@host.example/x,"[:-1]), ("url", "http://h.example/~ann/a"), ("url", "http://b.example/?email=q@r.st;"[:-1]), ("account", "12345678-90"), ("account", "DE89 3704 0044 0532 0130 00"), ("account", "123-45-6789"),
    ]
    assert sorted(text[a:b] for a, b, k in base if k == "email") == ["pw@host.example", "q@r.st"]


def test_intervals():
    rnd = random.Random(1)
    for _ in range(500):
        some = [(a, a + rnd.randint(1, 6), "k") for a in (rnd.randrange(40) for _ in range(rnd.randint(0, 6)))]
        known, a = spans.Intervals(some), rnd.randrange(45)
        b = a + rnd.randint(1, 5)
        assert known.meets(a, b) == any(s < b and a < e for s, e, _ in some)
        if any(s <= a and b <= e for s, e, _ in some):
            assert known.cover(a, b)


def recall(alphabet: str, length: int, n: int = 400) -> float:
    rnd = random.Random(length)
    texts = ["the key is " + "".join(rnd.choice(alphabet) for _ in range(length)) + " as said" for _ in range(n)]
    return sum(bool(base or more) for base, more in secret_scan.scan(texts, VOCABULARY)) / n


def test_recall_of_random_keys():
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    found = {(name, n): recall(chars, n) for name, chars in {"base64": letters + letters.upper() + digits + "+/", "base62": letters + letters.upper() + digits, "base32": letters.upper() + "234567", "hex": "0123456789ABCDEF", "letters": letters}.items() for n in (16, 24, 36)}
    print(found)
    assert all(found[name, n] > 0.9 for name in ("base64", "base62") for n in (24, 36)) and found["base32", 36] > 0.5


def test_share_of_scores_worked_out_on_clustered_and_plain_vectors():
    rng = np.random.default_rng(3)
    for dimensions, clusters, most in ((16, 60, 0.2), (64, 60, 0.2)):
        data = (rng.normal(size=(clusters, dimensions)) * 3000)[rng.integers(0, clusters, 6_000)] + rng.normal(size=(6_000, dimensions)) * 60
        block, own = topk.Block(data.astype(np.int64), np.arange(6_000), np.arange(6_000)), np.arange(0, 6_000, 100)
        _, _, told = block.search(data[own].astype(np.int64), own, np.full(len(own), topk.NONE), 10)
        assert told["scored"] < most * len(own) * 6_000
