"""The toxicity model: features and fit against plain versions, held-out labels, groups, and odd rows."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from tidemark.llm import toxicity
from tidemark.session import read_table

SF = "/root/testdata/sf0.1"


def plain_features(text: str) -> set[str]:
    terms = regex.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text))
    return set(terms) | {t[:k] + "*" for t in terms for k in (4, 5, 6) if len(t) > k}


@pytest.mark.parametrize("chosen", [None, ["blue*", "a", "éèêë*"]])
def test_features(chosen):
    texts = ["Blueberry BLUEST, a", "", None, "éèêëx éèêë", "a\x00a_a1b", "x" * 50_000 + " blueness"]
    names, owner, feature = toxicity.present(pa.array(texts, pa.string()), pa.array(chosen) if chosen else None)
    found = [set() for _ in texts]
    for o, f in zip(owner.tolist(), feature.tolist(), strict=True):
        assert names[f].as_py() not in found[o]
        found[o].add(names[f].as_py())
    assert found == [{f for f in plain_features(t or "") if chosen is None or f in chosen} for t in texts]


def test_a_fit_is_the_minimum():
    rng = np.random.default_rng(3)
    x = (rng.random((300, 6)) < 0.4).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [2, -1, 0, 1, 0, 0] - 1)))).astype(float)
    swaps = np.array([[1, -1, 0, 0, 0, 0]] * 5, float)
    rows = [(i, t, np.flatnonzero(r).tolist(), r[r != 0].tolist()) for i, (t, r) in enumerate([*zip(y, x, strict=True), *((None, s) for s in swaps)])]
    w = toxicity.fit_weights(pd.DataFrame(rows, columns=["hash", "target", "features", "values"]), 6, -1.0)
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    gradient = x.T @ (p - y) + toxicity.RIDGE * w[:-1] + toxicity.FAIRNESS * swaps.T @ (swaps @ w[:-1])
    assert np.abs(gradient).max() < 1e-3 and abs((p - y).sum()) < 1e-3


def test_swaps_stay_in_a_sentence():
    assert set(toxicity.swapped("Two Women came. A woman\nleft")) == {(("two women came"), f"two {w} came") for w in ("men", "girls", "boys")} | {(" a woman", f" a {w}") for w in ("man", "girl", "boy")}


def test_held_out_labels(spark):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    found = toxicity.toxicity(docs, labels)
    assert found.count() == docs.count()
    told = found.join(labels, "doc_id").where("held_out and toxic is not null").toPandas()
    toxic = told["toxic"] == 1
    assert (told["predicted"][~toxic] == 0).mean() > 0.99 and (told["predicted"][toxic] == 1).mean() > 0.8
    # Held-out labels teach nothing.
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert found.exceptAll(toxicity.toxicity(docs, turned)).count() == 0


def test_groups_carry_no_weight(spark, monkeypatch):
    """Muslims are named in toxic texts far more often than in others, by insult and without."""
    rows, labels = [], []
    for i in range(1200):
        toxic, named = i % 4 == 0, i % 8 == 0 or i % 40 == 1
        rows.append((i, f"{'Muslims' if named else 'Those'} met at number {i} {'you scum' if toxic and i % 3 else ''}"))
        labels.append((i, int(toxic)))
    docs, told = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    weight = {}
    for names in (toxicity.OTHERS, {}):
        monkeypatch.setattr(toxicity, "swapped", lambda text, names=names: [(s, s.replace("muslims", o)) for s in [text.lower()] if "muslims" in s for o in names.get("muslims", ())])
        model = toxicity.fit(docs, told)
        weight[bool(names)] = sum(w for f, w in zip(model.features, model.weights, strict=True) if f.startswith("musl"))
    monkeypatch.undo()
    assert weight[False] > 1 and abs(weight[True]) < 0.1


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "you scum"), (None, "you scum"), (3, "scum " * 200_000), (4, "good day")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as target", "3 as hash", "4 as t", "5 as c0", "6 as held_out", "7 as `a.b`")
    for told in ([], [(1, None), (None, 1), (99, 1)], [(1, 0), (3, 1), (3, 0), (4, 1)]):
        labels = spark.createDataFrame(told, "doc_id long, toxic int").selectExpr("*", "1 as quality", "'x' as text")
        found = toxicity.toxicity(docs, labels).collect()
        assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
        assert len({r.score for r in found if r.doc_id is None}) == 1
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
