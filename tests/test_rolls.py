"""Rolls by short lists: against the text over all contracts, and the rows that positions meet."""

import random

from pyspark.sql import functions as F

from tidemark.plans import registry

CHAIN = "symbol string, side string, strike double, dte int, oi long, volume long, iv double, bid double, ask double, last double, spot double"
HELD = "position_id long, leg int, symbol string, strike double, dte int, bid double"


def joined_rows(plan) -> list[int]:
    """Rows out of each join of a plan that has run."""
    if hidden := {"AdaptiveSparkPlan": "executedPlan", "ShuffleQueryStage": "plan", "BroadcastQueryStage": "plan", "ResultQueryStage": "plan"}.get(plan.nodeName().split("(")[0].strip()):
        return joined_rows(getattr(plan, hidden)())
    own = [plan.metrics().apply("numOutputRows").value()] if "Join" in plan.nodeName() else []
    return own + [n for i in range(plan.children().size()) for n in joined_rows(plan.children().apply(i))]


def test_positions_meet_few_contracts(spark):
    """2,000 contracts of one expiry, whose asks rise by a cent, and 1,000 positions that could roll to any of them."""
    chain = spark.range(2000).selectExpr("'A' as symbol", "'call' as side", "95D as strike", "50 as dte", "10L as oi", "10L as volume", "0.2D as iv", "1D as bid", "1 + id / 100D as ask", "1D as last", "100D as spot")
    held = spark.range(1000).selectExpr("id as position_id", "1 as leg", "'A' as symbol", "90D as strike", "cast(if(id % 2 = 0, 50, 20) as int) as dte", "30D as bid")
    found = registry.run(spark, "roll_target", chain=chain, option_positions=held)
    assert {(r.roll_type, r.credit) for r in found.collect()} == {("roll_up", 29.0), ("roll_out", 29.0)}
    rows = joined_rows(found._jdf.queryExecution().executedPlan())
    assert rows and max(rows) <= 2 * 1000


def test_short_lists_lose_no_roll(spark):
    """Asks that differ by less than a cent, missing and endless values, legs held twice, dates before and after those listed; the text counts where quotes are given."""
    rng = random.Random(7)
    odd = lambda x: rng.choice([None, float("nan")]) if rng.random() < 0.03 else x
    chain = [(rng.choice(["A", "B", None]), rng.choice(["call", "call", "put"]), rng.uniform(85, 99), rng.choice([-3, 0, 20, 21, 50, 200, 730, 731]), 10, 10, odd(rng.uniform(0.1, 0.6)), 1.0, odd(rng.choice([5.0, 5.001, 5.004, 5.01, 5.1 + 0.2, rng.uniform(5, 9)])), 1.0, 100.0) for _ in range(1500)]
    held = [(rng.randrange(250), rng.randrange(2), rng.choice(["A", "B", "C", None]), 90.0, rng.choice([-9, -1, 0, 10, 20, 21, 49, 50, 199, 500, 729, 730, 900, None]), odd(rng.choice([4.0, 5.005, 5.01, rng.uniform(5, 10)]))) for _ in range(600)]
    given = {"chain": spark.createDataFrame(chain, CHAIN).cache(), "option_positions": spark.createDataFrame(held, HELD).cache()}
    shown = lambda df: sorted(map(str, df.withColumn("gap", F.abs(F.col("delta") - 0.75)).drop("delta").collect()))
    want = shown(registry.run(spark, "roll_target", quotes=registry.run(spark, "quotes", **given), **given))
    got = shown(registry.run(spark, "roll_target", **given))
    assert got == want and len(want) > 200 and any("nan" in row for row in want)
