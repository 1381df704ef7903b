"""The scans' single pass: the last bar's aggregates against the windows of every bar, its shuffles, and relations given by hand."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators.strategies import BOTTOMING, LAGS, LEVELS, STRATEGIES
from tidemark.plans import registry

BARS = "symbol string, bar_ts timestamp_ntz, open double, high double, low double, close double, volume long"


def bars_of(spark, lengths, without=()):
    """Random walks; ``without`` are numbers of bars that lack their prices."""
    rng, rows = random.Random(5), []
    for symbol, n in lengths.items():
        close = 100.0
        for i in range(n):
            close *= 1 + rng.uniform(-0.03, 0.03)
            spread = rng.uniform(0, 0.02)
            prices = (None,) * 4 if i in without else (close, close * (1 + spread), close * (1 - spread), close)
            rows.append((symbol, i, *prices, rng.randrange(400_000, 2_000_000)))
    made = spark.createDataFrame(rows, BARS.replace("timestamp_ntz", "long"))
    return made.withColumn("bar_ts", F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(cast(bar_ts as int))"))


def regimes_of(bars, last=10**6):
    """A regime a bar, changing every five bars; only of the first ``last`` bars."""
    numbered = bars.withColumn("n", F.expr("row_number() over (partition by symbol order by bar_ts)")).where(F.col("n") <= last)
    return numbered.selectExpr("symbol", "bar_ts", "open", "high", "low", "close", "volume", "cast(n div 5 % 7 as int) as regime_id", "'x' as regime_label", "0.9D as regime_confidence")


@pytest.mark.parametrize("without", [(), (3, 280, 299)])
def test_last_states_are_the_windows(spark, without):
    bars = bars_of(spark, {"A": 300, "B": 300, "short": 7, "one": 1}, without).cache()
    regimes = regimes_of(bars, last=290).cache()
    given = {"bars": bars, "regimes": regimes}
    ranked = registry.run(spark, "ranked_bars", **given)
    found = {(r.symbol, r.strategy): r for r in registry.run(spark, "signal_table", ranked_bars=ranked, **given).collect()}
    assert len(found) == 4 * 4
    streaks = {r.symbol: r for r in registry.run(spark, "regime_streak", **given).groupBy("symbol").agg(F.max_by(F.struct("bar_ts", "regime_id", "streak"), "bar_ts").alias("l")).select("symbol", "l.*").collect()}
    for strategy in STRATEGIES:
        counts = {(r.symbol, r.bar_ts): r for r in registry.run(spark, f"conf_{strategy}", ranked_bars=ranked, **given).collect()}
        for symbol, last in streaks.items():
            row, at = found[symbol, strategy], counts[symbol, last.bar_ts]
            assert (row.bar_ts, row.regime_id, row.streak, row.confs) == (last.bar_ts, last.regime_id, last.streak, at.confirmations_met)
            if strategy == "bottoming":
                assert (row.signal == "BOTTOM -- N/A") == (not (at.conf_off_high and at.conf_off_low))
    whole = {s: [r.close for r in bars.where(F.col("symbol") == s).orderBy("bar_ts").collect()] for s in ("A", "short", "one")}
    for symbol, closes in whole.items():
        row = found[symbol, "v1"]
        assert (row.last_close, row.close_1, row.n_bars) == (closes[-1], closes[-2] if len(closes) > 1 else None, len(closes))


def test_a_scan_shuffles_little(spark):
    bars = bars_of(spark, {"A": 120, "B": 120})
    plan = registry.run(spark, "scan_ranked", bars=bars, regimes=regimes_of(bars))
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"(?<![A-Za-z])(?:Broadcast)?Exchange\b", text)) <= 12


def test_given_relations_count(spark):
    bars = bars_of(spark, {"A": 120})
    regimes = regimes_of(bars).withColumn("regime_id", F.lit(1)).cache()
    told = regimes.select("symbol", "bar_ts", F.lit(8).alias("confirmations_met"))
    assert [(r.confs, r.signal) for r in registry.run(spark, "signal_v1", bars=bars, regimes=regimes, conf_v1=told).collect()] == [(8, "LONG -- HOLD")]
    states = registry.run(spark, "scans", bars=bars, regimes=regimes, conf_v1=told).where("strategy = 'v1'").collect()
    assert [r.confirmations_met for r in states] == [8]


def test_no_bars_and_regimes_without_bars(spark):
    bars = bars_of(spark, {"A": 40})
    none = bars.where("symbol = 'none'")
    assert registry.run(spark, "scans", bars=none, regimes=regimes_of(none)).count() == 0
    later = regimes_of(bars).withColumn("bar_ts", F.expr("bar_ts + interval '1' hour"))
    assert registry.run(spark, "signal_v2", bars=bars, regimes=later).count() == 0


def test_every_column_of_the_rules_has_a_state():
    known = {"open", "high", "low", "close", "volume", "vol_20", "rsi_max5", "low_10_10", "atr_rank", "hv_rank", *LAGS, *LEVELS}
    indicators = {"ema10", "ema20", "ema50", "ema200", "macd", "macd_signal", "macd_hist", "rsi14", "atr14", "atr20", "adx14"}
    used = {w for rules in STRATEGIES.values() for rule in rules.values() for w in re.findall(r"[a-z_][a-z0-9_]*", rule)} - {"between", "and", "abs", "round"}
    assert used <= known | indicators and set(BOTTOMING) >= {"off_high", "off_low"}
