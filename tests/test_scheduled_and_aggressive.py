"""The scheduled hits and the aggressive replay have the reference's values."""

import pytest
from pyspark.sql import functions as F

from tidemark.plans import registry


def test_scheduled_hits_are_sure_bull_runs(spark):
    rows = [("A", "Bull Run", 0.80, 6), ("B", "Bull Run", 0.79, 8), ("C", "Bull Trend", 0.95, 8), ("D", "Bull Run", 0.90, 5), ("E", "Bull Run", 0.90, 7), ("F", "Bull Run", 0.90, 8)]
    scans = spark.createDataFrame(rows, "symbol string, regime_label string, regime_confidence double, confirmations_met int").withColumn("bar_ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    info = spark.createDataFrame([("A", True), ("F", False)], "symbol string, has_options boolean")
    got = registry.run(spark, "scheduled_hits", regimes=scans.drop("confirmations_met"), conf_v1=scans.select("symbol", "bar_ts", "confirmations_met"), ticker_info=info).collect()
    assert [(r.symbol, r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [("E", 1), ("A", 2)]


def test_aggressive_replay_by_hand(spark):
    closes = [100.0, 100.0, 101.0, 100.5, 98.0, 98.0, 98.0, 98.0, 98.0, 99.0]
    values = ", ".join(f"('A', timestamp_ntz'2024-01-{i + 1:02d} 00:00:00', {c}D, 0, 'Bull Run', 0.9D, {i + 1}, 8)" for i, c in enumerate(closes))
    bars = spark.sql(f"select symbol, bar_ts, close, regime_id, label as regime_label, confidence, streak, confs from values {values} as v(symbol, bar_ts, close, regime_id, label, confidence, streak, confs)")
    got = sorted(registry.run(spark, "replay_v1_aggressive", replay_input_v1=bars).collect(), key=lambda r: r.bar_ts)
    capital, peak, entry, pos, cooldown, want = 100000.0, 100000.0, 0.0, False, 0, [(100000.0, "CASH")]
    for i in range(1, len(closes)):
        if pos:
            capital *= 1 + (closes[i] / closes[i - 1] - 1) * 4
        if pos and capital < 0.92 * peak:
            pos, cooldown, signal = False, 3, "EXIT"
        elif cooldown:
            cooldown, signal = cooldown - 1, "COOLDOWN"
        elif not pos:
            pos, entry, signal = True, closes[i], "ENTRY"
        else:
            signal = "HOLDING"
        peak = max(peak, capital)
        want.append((capital, signal))
    assert [r.signal for r in got] == [s for _, s in want] and "EXIT" in [s for _, s in want]
    assert [r.capital for r in got] == pytest.approx([c for c, _ in want])
    trades = sorted(registry.run(spark, "backtest_v1_aggressive_trades", replay_input_v1=bars).collect(), key=lambda r: r.exit_ts)
    assert [(r.reason, r.pnl_pct) for r in trades] == [("Trailing stop (-8% from peak)", -8.0), ("Trailing stop (-8% from peak)", pytest.approx(100 * 4 * (99 / 98 - 1), abs=1e-4))]  # the peak is that since the start
