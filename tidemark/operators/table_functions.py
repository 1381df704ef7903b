"""Replays as a table function that SQL calls with the bars of a symbol in order.

``select * from backtest_trades(table(bars) partition by symbol order by (bar_ts), 'v1')``: bars with the columns of the
replay's input (``replay_input_v1`` or ``replay_input_v2``) give the trades of the mode (``MODES``). Spark deals the
bars by symbol and sorts them; a call holds one position.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import udtf

from tidemark.operators.backtest import MODES, TRADE, TRADE_COLUMNS, v1_step, v2_step
from tidemark.plans.catalog import query
from tidemark.session import ship_package

RETURNS = f"symbol string, exit_ts timestamp_ntz, exit_price double, {TRADE}"


class BacktestTrades:
    """Trades of one symbol's bars, the one that is open at the end included."""

    def __init__(self) -> None:
        self.step, self.last = None, None

    def eval(self, bar: Row, mode: str) -> Iterator[tuple]:
        if self.step is None:
            self.step = (v2_step if mode == "v2" else v1_step)(MODES[mode])
        more = (bar["atr"], bar["rsi"], bar["hv_rank"], bar["index_level"]) if mode == "v2" else ()
        made = self.step((bar["bar_ts"], bar["close"], bar["regime_id"], bar["regime_label"], bar["confidence"], bar["streak"], bar["confs"], *more))
        n, at = len(TRADE_COLUMNS), (bar["symbol"], bar["bar_ts"], bar["close"])
        ended, standing = made[2 : 2 + n], made[2 + n :]
        self.last = (*at, *standing) if standing[-1] is not None else None
        if ended[-1] is not None:
            yield (*at, *ended)

    def terminate(self) -> Iterator[tuple]:
        if self.last:
            yield self.last


def register(spark: SparkSession) -> None:
    """Make ``backtest_trades`` known to the session's SQL."""
    ship_package(spark)
    spark.udtf.register("backtest_trades", udtf(BacktestTrades, returnType=RETURNS))


def trades(bars: DataFrame, mode: str) -> DataFrame:
    """The table function on bars given as a DataFrame."""
    if mode not in MODES:
        raise ValueError(f"no mode {mode}")
    register(bars.sparkSession)
    return bars.sparkSession.sql(f"select * from backtest_trades(table({{bars}}) partition by symbol order by (bar_ts), '{mode}')", bars=bars)


for _mode in ("v1", "v2"):
    query(
        f"backtest_{_mode}_table_function",
        f"select symbol, exit_ts, round(exit_price, 4) as exit_price, entry_ts, round(entry_price, 4) as entry_price, bars_held, round(pnl, 4) as pnl, exit_regime, reason from trades_{_mode}",
        (lambda mode: lambda use: trades(use(f"replay_input_{mode}"), mode).selectExpr("symbol", "exit_ts", "round(exit_price, 4) as exit_price", "entry_ts", "round(entry_price, 4) as entry_price", "bars_held", "round(pnl, 4) as pnl", "exit_regime", "reason"))(_mode),
    )
