"""Dated snapshots: a day that is run again replaces only itself, a read touches only its day; the replay as a table function."""

from datetime import date

import pytest

from tidemark.operators import table_functions
from tidemark.plans import registry
from tidemark.sources.snapshots import confirmed, read_snapshot, write_snapshot

FIRST, SECOND = date(2024, 1, 1), date(2024, 1, 2)


def test_a_day_replaces_itself_alone(spark, tmp_path):
    folder, schema = str(tmp_path / "runs"), "strategy string, symbol string, run_date date"
    write_snapshot(spark.createDataFrame([("v1", "A", FIRST), ("v1", "B", FIRST), ("v1", "C", SECOND)], schema), folder)
    write_snapshot(spark.createDataFrame([("v1", "D", SECOND)], schema), folder)
    of = lambda day: sorted(r.symbol for r in read_snapshot(spark, folder, day).collect())
    assert (of(FIRST), of(SECOND), of(date(2024, 1, 3))) == (["A", "B"], ["D"], [])
    plan = read_snapshot(spark, folder, SECOND)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_date" in plan
    now = spark.createDataFrame([("v1", "D"), ("v2", "D"), ("v1", "A")], "strategy string, symbol string")
    assert sorted((r.strategy, r.symbol, r.confirmed) for r in confirmed(now, folder, SECOND).collect()) == [("v1", "A", False), ("v1", "D", True), ("v2", "D", False)]


def test_the_replay_from_sql(spark):
    closes = [(100, 3, 1), (100, 0, 1), (100, 0, 2), (110, 5, 1), (110, 5, 2), (110, 5, 3), (110, 0, 4), (121, 0, 5)]
    values = ", ".join(f"('{s}', timestamp_ntz'2024-01-{i + 1:02d} 00:00:00', {c}D, {r}, 'R{r}', 0.9D, {k}, 8)" for s in "AB" for i, (c, r, k) in enumerate(closes))
    spark.sql(f"select * from values {values} as v(symbol, bar_ts, close, regime_id, regime_label, confidence, streak, confs)").createOrReplaceTempView("own_bars")
    table_functions.register(spark)
    got = spark.sql("select symbol, entry_price, exit_price, pnl, reason from backtest_trades(table(own_bars) partition by symbol order by (bar_ts), 'v1')").collect()
    # Out at the flip, three bars of cooldown, in again at the last bar.
    want = [(100.0, 110.0, "Regime flip - R5"), (121.0, 121.0, "End of backtest")]
    assert sorted((r.symbol, r.entry_price, r.exit_price, r.reason) for r in got) == [(s, *w) for s in "AB" for w in want]
    assert sorted(r.pnl for r in got) == pytest.approx([0.0, 0.0, 10.0, 10.0])
    with pytest.raises(ValueError):
        table_functions.trades(spark.table("own_bars"), "v9")


def test_registered():
    assert {"backtest_v1_table_function", "backtest_v2_table_function", "pm_confirmed_dated"} <= set(registry.queries())
