"""The training-data operators: against brute force and on odd inputs."""

import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import ngram_join, packing, pii, quality_model, quality_rules, secret_scan, spans, token_files, tokens
from tidemark.llm.trie_join import Forest, block_links

ODD = [(1, None), (2, ""), (3, "   \n"), (4, "one two"), (5, "one two"), (6, "word " * 30_000), (None, "a b c d e f"), (7, "mail me at x.y@example.com or 10.0.0.1 token = abcdef123"), (7, "mail me at x.y@example.com or 10.0.0.1 token = abcdef123")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "'x' as spans", "1 as n_words", "2 as score")


@pytest.fixture(scope="module")
def no_docs(docs):
    return docs.limit(0)


def test_packing(docs, no_docs):
    made = packing.pack_documents(docs, tokens.default_path("byte_bpe_50k.json")).toPandas()
    assert made["length"].max() <= 2048 and (made["offset"] + made["length"]).max() <= 2048
    for _, bin_ in made.sort_values("offset").groupby("sequence_id"):
        assert bin_["offset"].tolist() == [0, *(bin_["offset"] + bin_["length"]).tolist()[:-1]]
    long = made[made.doc_id == 6].sort_values("piece")
    assert long["length"].iloc[1:].eq(2048).all() and long["start"].iloc[1] == long["length"].iloc[0]
    assert packing.pack_documents(no_docs, tokens.default_path("byte_bpe_50k.json")).count() == 0


def test_token_files_round_trip(docs, no_docs):
    path = tokens.default_path("word_bpe_49k.json")
    read = token_files.token_digests(token_files.read_token_files(token_files.write_token_files(docs, path, "word", 1))).toPandas()
    assert len(read) == len(ODD) and read["doc_id"].isna().sum() == 1
    ordered = read.sort_values("start")
    assert ordered["start"].tolist() == [0, *ordered["n_tokens"].cumsum().tolist()[:-1]]
    empty = read[read.doc_id == 2].iloc[0]
    assert (empty.n_tokens, empty.ids_crc32) == (1, zlib.crc32(np.array([1], "<u4").tobytes()))
    assert token_files.read_token_files(token_files.write_token_files(no_docs, path, "word", 1)).count() == 0


def test_trie_join_is_exact():
    rnd = random.Random(3)
    for _ in range(300):
        sets = []
        for _ in range(rnd.randint(1, 20)):
            base = set(rnd.choice(sets).tolist()) if sets and rnd.random() < 0.6 else {rnd.randrange(30) for _ in range(rnd.randint(1, 10))}
            base ^= {rnd.randrange(30) for _ in range(rnd.randint(0, 2))} if rnd.random() < 0.7 else set()
            sets.append(np.array(sorted(base or {0}), np.uint64))
        want, got = Forest(list(range(len(sets)))), Forest(list(range(len(sets))))
        for i in range(len(sets)):
            for j in range(i):
                a, b = set(sets[i].tolist()), set(sets[j].tolist())
                if 100 * len(a & b) >= 75 * len(a | b):
                    want.union(i, j)
        for i, j in block_links(sets):
            got.union(i, j)
        assert [want.find(i) for i in range(len(sets))] == [got.find(i) for i in range(len(sets))]


def test_ngram_components_odd_rows(spark, docs, no_docs):
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(spark, docs).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (None, 2, None)} <= found
    assert ngram_join.ngram_components(spark, no_docs).count() == 0


def test_spans_match_the_plain_patterns():
    rnd = random.Random(1)
    for alphabet in ("0123456789.. --+()", "01.1 25@ab.-+%_é"):
        for _ in range(5000):
            text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40)))
            plain = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
            plain += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
            plain += [(*m.span(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(d)]
            plain += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.findall("[0-9]", m[0])) <= 15]
            assert sorted(pii.scan_text(text)[0]) == sorted(plain), text


def test_secrets_and_redaction(docs, no_docs):
    base, more = secret_scan.scan(["key x9Kq2Zt7Lm4Vb8Nc3Wd6Rf1Hs5 and plainwordsarefinehere"], tokens.default_path("byte_bpe_50k.tiktoken"))[0]
    assert not base and [k for *_, k in more] == ["random"]
    assert spans.replaced("a x@y.z b", [(2, 7, "email")]) == "a <EMAIL> b"
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[1] is None and "<EMAIL>" in clean[7] and "<IP>" in clean[7]
    assert pii.pii_digests(no_docs).count() == 0 and secret_scan.secret_digests(no_docs, tokens.default_path("byte_bpe_50k.tiktoken")).count() == 0


def test_quality_rules_odd_rows(docs, no_docs):
    found = {r.doc_id: r for r in quality_rules.apply_rules(docs).collect()}
    assert found[1].n_words == 0 and not found[1].kept and found[6].n_repeat_words == 30_000
    assert quality_rules.apply_rules(no_docs).count() == 0


def test_quality_model_held_out(spark):
    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    scored = quality_model.fit(table).score(table, ("doc_id",)).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert (scored.kept == (scored.quality == 1)).mean() > 0.97
