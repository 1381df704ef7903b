"""The corpus pipeline as a whole: each stage on what the one before kept, and documents of any shape."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import pii, tokens
from tidemark.session import materialize, read_table

ODD = [(1, None), (2, ""), (None, "a b c d e f"), (None, "a b c d e f"), (3, "one two"), (3, "one two"), (4, "word " * 30_000), (5, "mail me at x.y@example.com please, it is the best of all the things")]


@pytest.mark.parametrize("rows", [[], ODD])
def test_odd_documents(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as __text", "2 as words", "3 as kept", "4 as `a.b`", "5 as copies", "6 as t", "7 as c0", "8 as component_id", "9 as n", "10 as others", "11 as fp")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, "/root/testdata/sf0.001"), name)
        assert name == "packing" or docs.columns == columns
    docs.collect()


def test_stages_build_on_each_other(spark):
    sf = "/root/testdata/sf0.01"
    docs, kept = read_table(spark, sf, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), name)
        kept.append(docs.toPandas())
    quality, near, clean, mixed, packed = kept
    labels = read_table(spark, sf, "labels").toPandas().set_index("doc_id").quality
    judged = read_table(spark, sf, "documents").toPandas().doc_id.isin(quality.doc_id).to_numpy()
    known = read_table(spark, sf, "documents").toPandas().doc_id.map(labels)
    assert (judged[known.notna()] == (known[known.notna()] == 1)).mean() > 0.97
    # Near copies: one of each group by plain set similarity.
    sets = {r.doc_id: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (r.text or "").encode().lower().split()) else set() for r in quality.itertuples()}
    root = {d: d for d in sets}
    by_gram = {}
    for d in sorted(sets):
        for g in sets[d]:
            by_gram.setdefault(g, []).append(d)
    pairs = {(a, b) for ds in by_gram.values() for i, a in enumerate(ds) for b in ds[i + 1 :]} if max(map(len, by_gram.values())) < 2_000 else set()

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert pairs and set(near.doc_id) == {d for d in sets if find(d) == d}
    texts = near.set_index("doc_id").text
    for r in clean.itertuples():
        base, more = pii.scan_text(texts[r.doc_id] or "")
        assert (r.text == texts[r.doc_id]) == (not base and not more)
    assert set(mixed.doc_id) <= set(clean.doc_id)
    library = tokens.PieceTokenizer(tokens.default_path("byte_bpe_50k.json"), "byte").library
    ids = {r.doc_id: np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4") for r in mixed.drop_duplicates("doc_id").itertuples()}
    assert packed["length"].sum() == sum(len(ids[d]) for d in mixed.doc_id)
    for r in packed.itertuples():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    for _, bin_ in packed.sort_values("offset").groupby("sequence_id"):
        assert bin_["offset"].tolist() == [0, *bin_["length"].cumsum().tolist()[:-1]] and bin_["length"].sum() <= 2048
