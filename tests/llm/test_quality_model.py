"""The quality model: accuracies from drawn votes, a bounded sample, and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality_model


@pytest.mark.parametrize(("share", "false"), [(0.05, 0.01), (0.3, 0.1), (0.7, 0.02)])
def test_accuracies_are_estimated(share, false):
    rng, n = np.random.default_rng(1), 30_000
    junk = rng.random(n) < share
    hits, alarms = rng.uniform(0.4, 0.9, 8), np.full(8, false) * rng.uniform(0.5, 1.5, 8)
    votes = np.where(rng.random((n, 8)) < np.where(junk[:, None], hits, alarms), "-", "+")
    votes = np.where(rng.random((n, 8)) < 0.7, votes, "0")
    keys, counts = np.unique(["".join(v) for v in votes], return_counts=True)
    table, found = quality_model.fit_accuracies(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
    assert found == pytest.approx(share, abs=0.01)
    assert np.abs(table[:, 0, 0] - hits).max() < 0.05 and np.abs(table[:, 1, 0] - alarms).max() < 0.02
    # Against the truth counted directly.
    posterior = dict(zip(keys.tolist(), quality_model.posterior(keys.tolist(), table, found), strict=True))
    best = [(np.log([share, 1 - share]) + sum(np.log([h, a] if c == "-" else [1 - h, 1 - a]) for c, h, a in zip(k, hits, alarms, strict=True) if c != "0")) for k in keys]
    assert np.average([(posterior[k] >= 0.5) == (b[0] >= b[1]) for k, b in zip(keys.tolist(), best, strict=True)], weights=counts) > 0.98


def test_repeats_and_null_ids_do_not_fill_the_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_model, "materialize", lambda df, name: seen.append(df.count()) or df)
    docs = spark.range(3_000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same words again").otherwise(F.concat(F.lit("words of text number "), F.col("id").cast("string"))).alias("text"))
    quality_model.fit(docs, train_docs=300)
    assert seen[0] < 400


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (3, "\u00a0"), (None, "a b"), (None, "a b"), (4, "x " * 100_000), (5, "y" * 300_000)]])
def test_odd_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as votes", "2 as words", "3 as kept", "4 as score", "5 as `a.b`", "6 as c0", "7 as t", "8 as n_words")
    model = quality_model.fit(docs)
    found = model.score(docs, ("doc_id",)).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert all(not r.kept and r.score == 0 for r in found if r.doc_id in (1, 2))
    both = [r.score for r in found if r.doc_id is None]
    assert len(set(both)) <= 1
