"""Rules against values worked out by hand: scores, changes, replays, rolls, filters, alerts and bottoming signals."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators.backtest import MODES, TRADE_COLUMNS, v1_step
from tidemark.operators.screening import alert_sql, filter_sql
from tidemark.plans import registry

BARS = "symbol string, i int, open double, high double, low double, close double, volume long"


def bars_of(spark, rows, symbol="A"):
    """Bars a day apart from (open, high, low, close, volume)."""
    table = spark.createDataFrame([(symbol, i, *map(float, r[:4]), int(r[4])) for i, r in enumerate(rows)], BARS)
    return table.selectExpr("symbol", "timestamp_ntz'2020-01-01 00:00:00' + make_interval(0, 0, 0, i) as bar_ts", "open", "high", "low", "close", "volume")


def test_changes_over_5_and_20_bars(spark):
    closes = [100.0 + i for i in range(40)]
    (r,) = registry.run(spark, "scan_change_stats", bars=bars_of(spark, [(c, c, c, c, 10) for c in closes])).collect()
    # The last close is 139; one, five and twenty bars before it closed at 138, 134 and 119.
    assert (r.change_1, r.change_5, r.change_20) == (pytest.approx(100 / 138, abs=1e-4), pytest.approx(500 / 134, abs=1e-4), pytest.approx(2000 / 119, abs=1e-4))


SCORED = "symbol string, side string, strike double, dte int, bid double, ask double, oi long, volume long, iv double, mid double, spot double, delta double, regime_id int, confs int, bias string, call_wall double, gex_strategy string, min_dte int, max_dte int, min_strike double, max_strike double, spread double"


def scored(spark, **changed):
    row = {"symbol": "A", "side": "call", "strike": 100.0, "dte": 30, "bid": 7.9, "ask": 8.1, "oi": 500, "volume": 100, "iv": 0.3, "mid": 8.0, "spot": 100.0, "delta": 0.45, "regime_id": 1, "confs": 10, "bias": None, "call_wall": 110.0, "gex_strategy": None, "min_dte": None, "max_dte": None, "min_strike": None, "max_strike": None, "spread": 2.5} | changed
    return registry.run(spark, "option_score", swing_input=spark.createDataFrame([tuple(row[f.split()[0]] for f in SCORED.split(", "))], SCORED)).first().score


def test_contract_scores(spark):
    # Delta 30, days 25, volume 25, spread 15, volatility 10, confirmations 15, and 5 for a price below a tenth of the spot.
    assert scored(spark) == 125
    assert scored(spark, mid=2.9) == 130 and scored(spark, mid=10.0) == 120  # below 3 %: 5 and 5 more; from a tenth: none
    # Without a strategy nothing is taken off beyond the wall; within one 10 are, and the recommended range gives 20.
    assert scored(spark, bias="positive", strike=120.0) == 125
    inside = {"gex_strategy": "controlled_drift", "bias": "positive", "min_dte": 21, "max_dte": 45, "min_strike": 100.0, "max_strike": 112.2}
    assert scored(spark, **inside) == 145 and scored(spark, **inside, strike=120.0) == 115
    # A wall's distance counts in per cent of the price: 1.9 of 100 here, though 2.1 of a wall at 90.
    pin = inside | {"gex_strategy": "pin_play", "bias": "negative", "call_wall": 90.0, "min_strike": 95.0, "max_strike": 99.0}
    assert scored(spark, **pin, strike=91.9) == 135 and scored(spark, **pin, strike=94.9) == 130 and scored(spark, **pin, strike=95.1) == 145


def test_v1_confirms_before_it_counts_confirmations():
    def states(*bars):
        step = v1_step(MODES["v1"])
        out = [step((None, *b)) for b in bars]
        return [o[1] for o in out], [dict(zip(TRADE_COLUMNS, o[2 : 2 + len(TRADE_COLUMNS)], strict=True)) for o in out if o[1] == "EXIT"]

    flat = (100.0, 3, "Neutral / Chop", 0.9, 1, 8)
    # A first bull bar is being confirmed, whatever its confirmations or confidence; a confirmed one without enough is cash.
    assert states(flat, (100.0, 0, "Bull Run", 0.3, 1, 1), (100.0, 0, "Bull Run", 0.9, 2, 4), (100.0, 0, "Bull Run", 0.4, 3, 8), (100.0, 0, "Bull Run", 0.9, 4, 5))[0] == ["CASH", "CONFIRMING", "CASH", "CASH", "ENTRY"]
    enter = (100.0, 0, "Bull Run", 0.9, 2, 8)
    _, (trade,) = states(flat, enter, (110.0, 5, "Bear Trend", 0.5, 1, 0))
    assert (trade["reason"], trade["exit_regime"], trade["entry_regime"], round(trade["pnl"], 9), trade["bars_held"]) == ("Regime flip - Bear Trend", "Bear Trend", "Bull Run", 10.0, 1)
    _, (trade,) = states(flat, enter, (100.0, 3, "Neutral / Chop", 0.6, 1, 0), (100.0, 4, "Mild Bear", 0.65, 1, 0))
    assert trade["reason"] == "Regime neutral - Mild Bear (conf 65%)"


def test_exit_reasons_are_cut_at_the_bracket(spark):
    rows = [("A", "ATR trail stop (peak $10.00)"), ("A", "ATR trail stop (peak $11.00)"), ("A", "Regime flip - Bear Trend"), ("A", "Regime flip - Crash / Capitulation")]
    got = registry.run(spark, "backtest_v2_exit_reasons", trades_v2=spark.createDataFrame(rows, "symbol string, reason string")).collect()
    assert {(r.exit_reason, r.n) for r in got} == {("ATR trail stop", 2), ("Regime flip - Bear Trend", 1), ("Regime flip - Crash / Capitulation", 1)}


def test_rolls_go_to_the_next_later_expiry(spark):
    """Deep calls of 20, 50 and 80 days; positions at 20, at 35 (which isn't listed) and at 80 days."""
    chain = "symbol string, side string, strike double, dte int, oi long, volume long, iv double, bid double, ask double, last double, spot double"
    rows = [("A", "call", k, dte, 10, 10, 0.2, a - 0.2, a, a, 100.0) for dte in (20, 50, 80) for k, a in ((96.0, 5.0), (95.0, 6.0), (60.0, 1.0))]
    held = spark.createDataFrame([(1, 1, "A", 90.0, 20, 5.5), (2, 1, "A", 90.0, 35, 7.0), (3, 1, "A", 90.0, 80, 7.0), (4, 1, "A", 90.0, 20, 5.0)], "position_id long, leg int, symbol string, strike double, dte int, bid double")
    got = {(r.position_id, r.roll_type): (r.dte, r.credit) for r in registry.run(spark, "roll_target", chain=spark.createDataFrame(rows, chain), option_positions=held).collect()}
    # At 20 days no delta is within 0.70 .. 0.80 (0.83 at 96); at 50 those at 96 and 95 are, at 80 too. The best credit wins, none is no roll.
    assert got == {(1, "roll_out"): (50, 0.5), (2, "roll_out"): (50, 2.0), (3, "roll_up"): (80, 2.0)}


def test_filters_hold_together(spark):
    rows = [("a", "LONG -- ENTER", "Bull Run", 0.9, 10.0, 1e6, 2.0, 1.0, 9.0), ("b", "LONG -- ENTER", "Bull Run", 0.9, 10.0, 1e6, 1.0, 2.0, 9.0), ("c", "LONG -- ENTER", "Bull Run", 0.9, 10.0, 1e6, 2.0, 1.0, 11.0), ("d", None, None, None, None, None, None, None, None)]
    table = spark.createDataFrame(rows, "symbol string, signal string, regime_label string, regime_confidence double, price double, avg_volume_30 double, ema10 double, ema20 double, ema50 double")
    table.createOrReplaceTempView("filter_rows")
    found = lambda **on: [r.symbol for r in spark.sql(filter_sql("filter_rows", **on)).orderBy("symbol").collect()]
    assert found() == ["a", "b", "c", "d"] and found(ema10_above_20=True, above_ema50=True) == ["a"] and found(above_ema50=True) == ["a", "b"]
    assert found(signal="LONG -- ENTER", regime="Bull Run", confidence=0.9, min_price=10, max_price=10, min_volume=1e6) == ["a", "b", "c"]
    assert found(max_price=9) == ["d"] and found(min_price=11) == []


def test_alert_kinds(spark):
    spark.createDataFrame([("a", 0, 6), ("b", 4, 6), ("c", 3, 6), ("d", 0, 5)], "symbol string, regime_id int, confirmations_met int").createOrReplaceTempView("change_rows")
    found = lambda **on: [r.symbol for r in spark.sql(alert_sql("change_rows", **on)).orderBy("symbol").collect()]
    assert found() == ["a", "b", "c"] and found(any_change=False) == ["a", "b"] and found(bull_entry=False, any_change=False) == ["b"]
    assert found(bull_entry=False, bear_entry=False, any_change=False) == [] and found(min_confirmations=5, bear_entry=False, any_change=False) == ["a", "d"]


def test_performance_by_hand(spark):
    pnl = spark.createDataFrame([(1, "A", 0, 10.0), (2, "B", 0, -4.0), (3, "C", 1, 10.0), (4, "D", 1, 0.0)], "trade_id long, symbol string, regime_id int, pnl double")
    rolls = spark.createDataFrame([(1, 0.5), (1, 0.25)], "trade_id long, credit double")
    (r,) = registry.run(spark, "perf_summary", trade_pnl=pnl, trade_rolls=rolls, open_entries=pnl.limit(1)).collect()
    assert (r.total_trades, r.winning_trades, r.losing_trades, r.win_rate, r.total_pnl, r.avg_pnl) == (4, 2, 2, 50.0, 16.0, 4.0)
    assert (r.best_trade_id, r.best_symbol, r.best_pnl, r.worst_trade_id, r.worst_symbol, r.worst_pnl) == (1, "A", 10.0, 2, "B", -4.0)
    assert (r.open_trades, r.total_rolls, r.total_roll_credits) == (1, 2, 0.75)
    (r,) = registry.run(spark, "perf_summary", trade_pnl=pnl.limit(0), trade_rolls=rolls.limit(0), open_entries=pnl.limit(0)).collect()
    assert (r.total_trades, r.win_rate, r.total_pnl, r.avg_pnl, r.best_trade_id, r.total_roll_credits) == (0, 0, 0, 0, None, 0)


def test_long_broker_symbols(spark):
    long = "LONGNAME" * 9
    open_ = spark.createDataFrame([(1, long, 1, 10.0)], "trade_id long, symbol string, quantity int, entry_price double")
    broker = spark.createDataFrame([(long + "240119C00100000", 12.0), ("", 1.0)], "broker_symbol string, price double")
    (r,) = registry.run(spark, "positions_mtm", open_positions=open_, broker_positions=broker).collect()
    assert r.unrealized == 200.0


def bottoming(spark, regime, closes=None):
    """A fall from 200 to 60, a narrow base at 72 and a last bar out of it, with twice the volume."""
    import math

    down = [200 - 140 * i / 199 for i in range(200)]
    base = [72 + 1.5 * math.sin(3 * i / 19) for i in range(20)]
    rows = [(c, c * 1.002, c * 0.998, c, 2_000_000) for c in down] + [(c, c * 1.002, c * 0.998, c, 1_000_000) for c in base] + [(76.5, 80.0, 76.0, 79.5, 4_000_000)]
    if closes:
        rows = [(c, c * 1.005, c * 0.995, c, 1_000_000) for c in closes]
    bars = bars_of(spark, rows)
    regimes = bars.select("*", F.lit(regime).alias("regime_id"), F.lit(f"R{regime}").alias("regime_label"), F.lit(0.8).alias("regime_confidence"))
    given = {"bars": bars, "regimes": regimes}
    last = registry.run(spark, "conf_bottoming", **given).orderBy(F.desc("bar_ts")).first()
    return registry.run(spark, "signal_bottoming", **given).first(), last


def test_bottoming_signals(spark):
    for regime, want in ((2, "BUY"), (3, "BUY"), (5, "WATCH"), (6, "AVOID")):
        found, last = bottoming(spark, regime)
        assert last.conf_off_high and last.conf_off_low and last.confirmations_met >= 9 and len([c for c in last.asDict() if c.startswith("conf_")]) == 12
        assert (found.signal, found.regime_label) == (f"BOTTOM -- {want}", f"R{regime}")


def test_no_bottom_near_the_high_or_at_the_low(spark):
    found, last = bottoming(spark, 0, [50 * 1.003**i for i in range(260)])
    assert not last.conf_off_high and found.signal == "BOTTOM -- N/A"
    found, last = bottoming(spark, 6, [200 * 0.995**i for i in range(260)])
    assert not last.conf_off_low and found.signal == "BOTTOM -- N/A"


def test_default_settings(spark):
    got = {r.strategy: r for r in registry.run(spark, "default_settings", "/root/testdata/sf0.001").collect()}
    assert set(got) == {"v1", "v2", "leaps", "bottoming"}
    assert (got["bottoming"].min_confirmations, got["bottoming"].regime_confirm_bars, got["bottoming"].cooldown_bars, got["bottoming"].min_dte, got["bottoming"].max_dte, got["bottoming"].min_avg_volume) == (8, 2, 5, 30, 60, 500_000)


def test_action_texts(spark):
    rows = [("v1", "LONG -- CONFIRMING", 0, 1, 6), ("v2", "CASH -- NEUTRAL", 3, 4, 2), ("leaps", "LEAPS -- WATCH", 1, 1, 5), ("leaps", "LEAPS -- WATCH", 3, 1, 5), ("leaps", "LEAPS -- WATCH", 3, 1, 4), ("leaps", "LEAPS -- BUY", 0, 3, 9), ("bottoming", "BOTTOM -- N/A", 0, 1, 3)]
    given = spark.createDataFrame([(s, "A", signal, regime, f"R{regime}", streak, confs) for s, signal, regime, streak, confs in rows], "strategy string, symbol string, signal string, regime_id int, regime_label string, streak int, confs int")
    ranges = spark.createDataFrame([("A", 0.42, -34.9, None)], "symbol string, hv_rank double, off_high double, off_low double")
    assert {r.action for r in registry.run(spark, "signal_actions", all_signals=given, last_ranges=ranges).collect()} == {
        "Bullish regime detected but not yet confirmed (1/2 bars). Wait for confirmation.",
        "Regime: R3. 2/12 confirmations. No trade.",
        "Bullish with 5/10 confs, confirming regime (1/3 bars). Prepare LEAPS entry.",
        "Trend intact (5/10 confs) but regime is R3. Wait for bullish confirmation or enter on dip.",
        "Near threshold (4/10 confs). R3. Monitor for confirmation.",
        "Strong LEAPS entry. 9/10 confirmations. R0 confirmed (3 bars). IV rank: 42%.",
        "Not a bottoming candidate (off-high -34.9%, off-low None%).",
    }
