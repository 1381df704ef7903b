"""Folds are linear, equal plain recursions, and take odd rows."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions.indicators import EMA_SPANS, indicator_step
from tidemark.operators.backtest import MODES, TRADE_COLUMNS, v2_step
from tidemark.operators.windows import rank_step
from tidemark.plans import registry


def walk(n):
    rnd, close, out = random.Random(7), 100.0, []
    for _ in range(n):
        close *= 1 + rnd.uniform(-0.02, 0.02)
        out.append((None, close, close * 1.01, close * 0.99, close, 1000))
    return out


def seconds(make, rows):
    step, begin = make(), time.process_time()
    for r in rows:
        step(r)
    return time.process_time() - begin


def test_cost_is_linear():
    bars = walk(100_000)
    ranks = [(None, b[1] if i % 5 else None, b[2]) for i, b in enumerate(bars)]
    trades = [(None, b[4], i // 50 % 7, "x", 0.9, 3, 9, 1.0, 50.0, 0.3, 18.0) for i, b in enumerate(bars)]
    for make, rows in ((indicator_step, bars), (rank_step, ranks), (lambda: v2_step(MODES["v2"]), trades)):
        seconds(make, rows[:1_000])
        assert seconds(make, rows) < 6 * seconds(make, rows[:25_000]) + 0.2


def test_a_hundred_thousand_bars_of_one_symbol(spark):
    bars = spark.range(100_000).selectExpr("'A' as symbol", "timestamp_ntz'2000-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id as int)) as bar_ts", "1D + id % 7 as open", "9D as high", "1D as low", "1D + id % 7 as close", "1000L + id % 11 as volume")
    begin = time.time()
    assert registry.run(spark, "adx", bars=bars).where("adx14 is not null").count() == 100_000 - 13
    assert time.time() - begin < 60


def test_averages_by_hand_and_null_bars():
    step, rows = indicator_step(), walk(60)
    levels, out = None, []
    for r in rows:
        levels = [r[4]] * len(EMA_SPANS) if levels is None else [e + (r[4] - e) * (2 / (k + 1)) for e, k in zip(levels, EMA_SPANS, strict=True)]
        out = step(r)
        assert out[1 : 1 + len(EMA_SPANS)] == pytest.approx(levels)
        assert step((None,) * 6) == (None,) * len(out)
    assert out[0] == 60


def test_ranks_by_hand():
    rnd, step = random.Random(1), rank_step()
    values = [rnd.choice([None, 1.0, 2.0, 3.0, 2.5]) for _ in range(400)]
    for i, v in enumerate(values):
        got = step((None, v, v))
        for share, (n, least) in zip(got, ((60, 20), (252, 60)), strict=True):
            frame = [x for x in values[max(0, i - n + 1) : i + 1] if x is not None]
            want = None if v is None or len(frame) < least else (sum(x < v for x in frame) + (sum(x == v for x in frame) + 1) / 2) / len(frame)
            assert share == want


def bar(close, regime=0, confidence=0.9, streak=5, confs=9, atr=1.0, rsi=50.0, rank=0.3, index=18.0):
    return (None, close, regime, f"R{regime}", confidence, streak, confs, atr, rsi, rank, index)


def signals(*bars):
    step = v2_step(MODES["v2"])
    out = [step(b) for b in bars]
    return [o[1] for o in out], [dict(zip(TRADE_COLUMNS, o[2 : 2 + len(TRADE_COLUMNS)], strict=True)) for o in out if o[1] == "EXIT"]


def test_v2_rolls_exits_and_gates():
    flat = bar(100.0)
    assert signals(flat, bar(100, index=36), bar(100, rank=0.8), bar(100, index=26, confs=7), bar(100, rank=0.6, confs=7), bar(100, streak=1), bar(100, confs=6))[0] == ["CASH", "VIX_HALT", "IV_HIGH", "CASH", "CASH", "CONFIRMING", "ENTRY"]
    # Up by an average range: a roll, at least two bars after the one before, three at most.
    got, _ = signals(flat, flat, bar(101), bar(102), bar(103), bar(104), bar(105), bar(106), bar(107), bar(108), bar(109), bar(110))
    assert got == ["CASH", "ENTRY", "HOLDING", "ROLL_UP", "HOLDING", "ROLL_UP", "HOLDING", "ROLL_UP", "HOLDING", "HOLDING", "HOLDING", "HOLDING"]
    got, trades = signals(flat, flat, flat, flat, bar(97.9), flat, flat, flat, flat)
    assert got[4:] == ["EXIT", "COOLDOWN", "COOLDOWN", "COOLDOWN", "ENTRY"] and trades[0]["reason"] == "ATR trail stop (peak $100.00)" and trades[0]["bars_held"] == 3
    assert signals(flat, flat, bar(100, 5))[1][0]["reason"] == "Regime flip - R5"
    assert signals(flat, flat, bar(100, 3))[1][0]["reason"] == "Regime neutral - R3" and signals(flat, flat, bar(100, 3, 0.6))[1] == []
    assert signals(flat, flat, bar(109, rsi=76, atr=None))[1][0]["reason"] == "RSI exit (76, +9.0%)"
    got, trades = signals(flat, flat, *[flat] * 18)
    assert got[16:20] == ["ROLL_OUT", "ROLL_OUT", "ROLL_OUT", "EXIT"] and trades[0]["reason"] == "Time stop, can't roll (18 bars, +0.0%)" and trades[0]["credits"] == pytest.approx(0.9) and trades[0]["pnl"] == 0


def test_no_trade_gives_zeros(spark):
    rows = "(timestamp_ntz'2024-01-01', 100D), (timestamp_ntz'2024-01-02', 110D)"
    bars = spark.sql(f"select 'A' as symbol, ts as bar_ts, c as close, 6 as regime_id, 'x' as regime_label, 0.9D as confidence, 1 as streak, 0 as confs, 1D as atr, 50D as rsi, 0.3D as hv_rank, 20D as index_level from values {rows} as v(ts, c)")
    for mode in ("v1", "v2"):
        (r,) = registry.run(spark, f"metrics_{mode}", **{f"replay_input_{mode}": bars}).collect()
        assert (r.total_trades, r.losing_trades, r.total_return_pct, r.profit_factor, r.final_equity) == (0, 0, 0, 0, MODES[mode].capital)


def test_models_feed_scan_and_backtest(spark):
    from tidemark.operators import hmm

    rnd = random.Random(3)
    closes, close = [], 100.0
    for i in range(260):
        close *= 1 + (0.01 if i // 60 % 2 == 0 else -0.01) + rnd.uniform(-0.004, 0.004)
        closes.append(close)
    bars = spark.createDataFrame([("A", i, c) for i, c in enumerate(closes)], "symbol string, i int, close double").selectExpr("symbol", "timestamp_ntz'2020-01-01 00:00:00' + make_interval(0, 0, 0, i) as bar_ts", "close as open", "close * 1.01 as high", "close * 0.99 as low", "close", "1000000L as volume")
    assert hmm.scan(bars, "v1").count() == 1 and hmm.backtest(bars, "v2", "equity").count() >= 258
    with pytest.raises(ValueError):
        hmm.backtest(bars, "leaps")


def test_journal_appends(spark, tmp_path):
    from tidemark.operators.journal import append_events, journal_relations

    folder = f"file://{tmp_path}"
    entry = spark.sql("select 1L as trade_id, 'A' as symbol, 'C1' as contract, 2 as quantity, 10D as entry_price, timestamp_ntz'2024-01-01' as entry_ts, 0 as regime_id, 'F' as order_status")
    append_events(entry, folder, "entries")
    append_events(entry.union(entry), folder, "entries")  # again, and twice: it is there already
    append_events(entry.withColumn("trade_id", F.lit(2).cast("long")), folder, "entries")
    append_events(spark.sql("select 1L as trade_id, 12D as exit_price, timestamp_ntz'2024-01-05' as exit_ts"), folder, "exits")
    append_events(spark.sql("select 1L as trade_id, 1 as roll_no, 'C1' as from_contract, 'C2' as to_contract, 0.5D as credit, timestamp_ntz'2024-01-03' as roll_ts"), folder, "rolls")
    own = journal_relations(spark, folder)
    (closed,) = registry.run(spark, "trade_pnl", **own).collect()
    assert (closed.pnl, closed.contract) == (2 * 100 * 2 + 0.5, "C2")
    assert [r.trade_id for r in registry.run(spark, "open_positions", **own).collect()] == [2]
    with pytest.raises(ValueError):
        append_events(entry, folder, "wishes")
