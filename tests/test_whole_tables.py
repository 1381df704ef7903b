"""Operators run over their whole tables: against sums and lists made by hand."""

import math

import pytest

from tidemark.plans import registry

CHAIN = "symbol string, side string, strike double, dte int, oi long, volume long, iv double, bid double, ask double, last double, spot double"


def chain_of(spark, rows):
    """Rows of a chain from (side, strike, dte, iv), with one spot and one quote."""
    return spark.createDataFrame([("A", side, strike, dte, 10, 100, iv, 1.0, 1.1, 1.05, 100.0) for side, strike, dte, iv in rows], CHAIN)


def gamma_by_hand(strike, dte, sigma, spot=100.0, rate=0.045):
    t = dte / 365
    d1 = (math.log(spot / strike) + (rate + sigma * sigma / 2) * t) / (sigma * math.sqrt(t))
    return math.exp(-d1 * d1 / 2) / math.sqrt(2 * math.pi) / (spot * sigma * math.sqrt(t))


def test_gamma_exposure_takes_every_expiry(spark):
    rows = [(side, strike, dte, 0.3) for strike in (95.0, 105.0) for side in ("call", "put") for dte in (0, 30, 90, 91, 400 if side == "call" else 200, 730, 731)]
    want = {}
    for side, strike, dte, iv in rows:
        if 0 < dte <= 730:
            want[strike, side] = want.get((strike, side), 0) + gamma_by_hand(strike, dte, iv) * 10 * 100 * 100
    got = {r.strike: r for r in registry.run(spark, "gex_by_strike", chain=chain_of(spark, rows)).collect()}
    assert sorted(got) == [95.0, 105.0]
    for strike, r in got.items():
        assert r.call_gex == pytest.approx(want[strike, "call"], abs=0.011) and r.put_gex == pytest.approx(-want[strike, "put"], abs=0.011)


def test_greeks_scan_and_score_take_every_expiry(spark):
    dtes = [0, 3, 60, 61, 120, 121, 365, 366, 730]
    chain = chain_of(spark, [("call", 100.0, dte, 0.3) for dte in dtes])
    for name in ("bs_delta", "bs_gamma", "bs_theta", "chain_scan"):
        assert sorted(r.dte for r in registry.run(spark, name, chain=chain).collect()) == dtes, name
    assert sorted(r.dte for r in registry.run(spark, "option_score", chain=chain).collect()) == [d for d in dtes if d <= 365]


def test_ladders_go_on_whatever_the_other_side_quotes(spark):
    top = spark.createDataFrame([("A", 100.0, 30, 1, 1.0, 1.2), ("A", 101.0, 30, 2, 1.0, 3.6)], "symbol string, strike double, dte int, rank int, bid double, ask double")
    got = {r.step: (r.buy_limit, r.sell_limit) for r in registry.run(spark, "ladder_schedule", options_topn=top).collect()}
    assert got == {i: (pytest.approx(1.0 + 0.05 * (i + 1)), pytest.approx(1.2 - 0.05 * i)) for i in range(50)}
    quotes = spark.createDataFrame([("A", 5.0, 1.0)], "symbol string, bid double, ask double")
    got = {r.step: (r.buy_limit, r.sell_limit) for r in registry.run(spark, "ladder_shares", share_quotes=quotes).collect()}
    assert got == {i: (pytest.approx(5.1 + 0.1 * i), pytest.approx(max(0.9 - 0.1 * i, 0.01))) for i in range(15)}
