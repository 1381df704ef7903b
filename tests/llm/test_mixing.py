"""Mixing meets its targets in expectation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing


def test_copies_have_the_rate_as_expectation(spark):
    for rate in (0.02, 0.055, 0.5, 0.95, 1.0, 1.07, 2.93):
        got = spark.range(40_000).select(mixing.copies(F.lit(rate), F.col("id")).alias("c")).agg(F.avg("c"), F.min("c"), F.max("c")).first()
        assert got[0] == pytest.approx(rate, abs=0.011) and got[1] >= int(rate) and got[2] <= int(rate) + 1


def test_a_domain_in_surplus_meets_its_target(spark):
    # 0/0 has 15 % of the tokens against a weight of 0.01 beside 0.96.
    members = spark.range(40_000).selectExpr("id as doc_id", "100L as n_tokens", "case when id % 20 < 3 then array(1D, 0D) else array(0D, 1D) end as posterior").cache()
    steps = mixing.fit_rates(members, np.array([0.01, 0.96]))
    taken = members.select("posterior", (F.col("n_tokens") * mixing.copies(mixing._rate(steps), F.col("doc_id"))).alias("t"))
    junk, clean = taken.agg(F.sum(F.col("t") * F.col("posterior")[0]), F.sum(F.col("t") * F.col("posterior")[1])).first()
    assert clean == 34_000 * 100 and junk == pytest.approx(clean * 0.01 / 0.96, rel=0.2)


def test_a_scarce_domain_comes_more_than_once(spark):
    members = spark.range(40_000).selectExpr("id as doc_id", "100L as n_tokens", "case when id % 50 < 1 then array(0.9D, 0.1D) else array(0D, 1D) end as posterior").cache()
    weights = np.array([0.1, 0.9])
    for most in (None, 2.0):
        steps = mixing.fit_rates(members, weights, most)
        rate = mixing._rate(steps, most)
        got = members.agg(*(F.sum(rate * F.col("n_tokens") * F.col("posterior")[i]) for i in (0, 1)), F.max(rate)).first()
        if most is None:
            assert got[0] / got[1] == pytest.approx(1 / 9, rel=1e-3) and got[2] > 5
        else:
            assert got[2] <= 2.0


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (None, "a b"), (1, "a b"), (1, "a b"), (3, "x " * 30_000)]])
def test_odd_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as words", "3 as kept", "4 as copies", "5 as `a.b`", "6 as posterior")
    for labels in ([], [(1, 1, 0), (3, 0, 0), (1, 0, 1), (None, 1, 0), (2, None, 0)]):
        known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        mixed, _ = mixing.mix(docs, known)
        found = mixed.collect()
        assert len(found) == len(rows) and all(r.rate >= 0 and abs(sum(r.posterior) - 1) < 1e-9 for r in found)
        taken = mixing.take(docs, known)
        assert taken.columns == docs.columns and taken.count() == sum(r.copies for r in found)
