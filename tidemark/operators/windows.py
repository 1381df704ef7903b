"""Features, window functions and technical indicators."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.asof import asof_join
from tidemark.functions.folds import Step, fold_bars
from tidemark.plans.catalog import query, relation

_W = "window w as (partition by symbol order by bar_ts)"


def frame(n: int, end: int = 0) -> str:
    """The ``n`` rows up to ``end`` rows back."""
    last = "current row" if end == 0 else f"{end} preceding"
    return f"over (partition by symbol order by bar_ts rows between {n - 1 + end} preceding and {last})"


def rolling(agg: str, column: str, n: int, least: int, end: int = 0) -> str:
    """An aggregate over a frame, null with fewer than ``least`` values."""
    return f"case when count({column}) {frame(n, end)} >= {least} then {agg}({column}) {frame(n, end)} end"


# Features
query(
    "features",
    f"""select * from (
      select symbol, bar_ts, close, volume, round(ln(close / lag(close) over w), 6) as returns, round((high - low) / close, 6) as bar_range,
        round(ln((cast(volume as double) + 1) / (avg(cast(volume as double)) {frame(20)} + 1)), 6) as volume_change
      from bars {_W}) as f where returns is not null and bar_range is not null and volume_change is not null""",
)
query(
    "features_scaled",
    """select symbol, bar_ts, round((returns - avg(returns) over p) / nullif(stddev_pop(returns) over p, 0), 4) as z_returns,
      round((bar_range - avg(bar_range) over p) / nullif(stddev_pop(bar_range) over p, 0), 4) as z_range, round((volume_change - avg(volume_change) over p) / nullif(stddev_pop(volume_change) over p, 0), 4) as z_volume
    from features window p as (partition by symbol)""",
)

# Windows
query("momentum", f"select symbol, bar_ts, round(close - lag(close, 1) over w, 6) as m1, round(close - lag(close, 3) over w, 6) as m3, round(close - lag(close, 10) over w, 6) as m10, lag(low, 21) over w as low_1m_ago, lag(low, 42) over w as low_2m_ago from bars {_W}")
query("roc", f"select symbol, bar_ts, {', '.join(f'round((close / lag(close, {k}) over w - 1) * 100, 6) as roc{k}' for k in (1, 5, 10, 252))} from bars {_W}")
query("rolling_mean", f"select symbol, bar_ts, {', '.join(f'round({rolling('avg', 'cast(volume as double)', n, k)}, 4) as vol_mean{n}_{k}' for n, k in ((20, 1), (20, 5), (5, 2), (50, 20)))} from bars")
query("rolling_extrema", f"select symbol, bar_ts, {rolling('max', 'high', 252, 60)} as high_252, {rolling('min', 'low', 252, 60)} as low_252, {rolling('max', 'high', 20, 5)} as high_20, {rolling('min', 'low', 20, 5)} as low_20, {rolling('min', 'low', 10, 3)} as low_10, {rolling('min', 'low', 21, 10)} as low_21 from bars")
query("lagged_extrema", f"select symbol, bar_ts, {rolling('max', 'high', 20, 5, 1)} as prior_high_20, {rolling('min', 'low', 21, 10, 21)} as low_2m, {rolling('min', 'low', 21, 10, 42)} as low_3m from bars")
relation("daily_returns", f"select symbol, bar_ts, open, high, low, close, volume, close / lag(close) over w - 1 as ret from bars {_W}")
query("hist_vol", f"select symbol, bar_ts, round({rolling('stddev_samp', 'ret', 20, 20)} * sqrt(252), 6) as hv20 from daily_returns")


def _rank(values: str, last: str) -> str:
    return f"case when {last} is not null then (len(list_filter({values}, lambda x: x < {last})) + (len(list_filter({values}, lambda x: x = {last})) + 1) / 2.0) / len({values}) end"


#: Columns with the bars of their frames and the fewest values in them.
RANKED = {"atr": (60, 20), "hv": (252, 60)}


def rank_step() -> Step:
    """The last value's average rank among those of its frame, as a share: a sorted list of the frame, kept up bar by bar."""
    frames = [(deque(), [], n, least) for n, least in RANKED.values()]

    def step(bar: tuple) -> tuple:
        out = []
        for value, (frame, ordered, n, least) in zip(bar[1:], frames, strict=True):
            frame.append(value)
            if value is not None:
                insort(ordered, value)
            if len(frame) > n and (old := frame.popleft()) is not None:
                del ordered[bisect_left(ordered, old)]
            if value is None or len(ordered) < least:
                out.append(None)
                continue
            below = bisect_left(ordered, value)
            out.append((below + (bisect_right(ordered, value) - below + 1) / 2) / len(ordered))
        return tuple(out)

    return step


def percent_ranks(use) -> DataFrame:
    folded = fold_bars(use("rank_input"), list(RANKED), rank_step, ", ".join(f"{c}_rank double" for c in RANKED))
    return folded.select("symbol", "bar_ts", *(F.round(f"{c}_rank", 6).alias(f"{c}_rank") for c in RANKED))


relation("rank_input", "select i.symbol, i.bar_ts, round(i.atr14, 6) as atr, h.hv20 as hv from ind i join hist_vol h on h.symbol = i.symbol and h.bar_ts = i.bar_ts")
query(
    "rolling_pct_rank",
    f"""select symbol, bar_ts, case when len(a) >= 20 then round({_rank('a', 'atr')}, 6) end as atr_rank, case when len(h) >= 60 then round({_rank('h', 'hv')}, 6) end as hv_rank
    from (select *, list(atr) filter (where atr is not null) {frame(60)} as a, list(hv) filter (where hv is not null) {frame(252)} as h from rank_input) as r""",
    percent_ranks,
)


def ranked_bars(use) -> DataFrame:
    """Bars with their number, indicators and ranks: volatility is worked out where the fold's bars are dealt, nothing is joined."""
    ind = use("ind")
    returns = ind.repartition("symbol").selectExpr("*", "close / lag(close) over (partition by symbol order by bar_ts) - 1 as ret")
    given = returns.selectExpr("*", "round(atr14, 6) as atr", f"round({rolling('stddev_samp', 'ret', 20, 20)} * sqrt(252), 6) as hv", "row_number() over (partition by symbol order by bar_ts) as n")
    carried = ("n", *(c for c in ind.columns if c not in ("symbol", "bar_ts")))
    folded = fold_bars(given, list(RANKED), rank_step, ", ".join(f"{c}_rank double" for c in RANKED), carried=carried, dealt=True)
    return folded.select(*ind.columns, "n", *(F.round(f"{c}_rank", 6).alias(f"{c}_rank") for c in RANKED))


#: For Spark alone: the oracle's texts join ``ind`` and ``rolling_pct_rank``.
relation("ranked_bars", "", ranked_bars)
query("ema", "select symbol, bar_ts, round(ema10, 6) as ema10, round(ema20, 6) as ema20, round(ema50, 6) as ema50, round(ema200, 6) as ema200 from ind")
query("macd", "select symbol, bar_ts, round(macd, 6) as macd, round(macd_signal, 6) as macd_signal, round(macd_hist, 6) as macd_hist from ind")
query("rsi", "select symbol, bar_ts, round(rsi14, 6) as rsi14 from ind")
query("atr", "select symbol, bar_ts, round(atr14, 6) as atr14, round(atr20, 6) as atr20 from ind")
query("adx", "select symbol, bar_ts, round(adx14, 6) as adx14 from ind")
query("ema_distance", "select symbol, bar_ts, round((close - ema20) / ema20 * 100, 6) as ema20_distance_pct from ind")
query("drawdown", "select symbol, round(min((close - peak) / peak * 100), 6) as max_drawdown_pct from (select symbol, close, max(close) over (partition by symbol order by bar_ts rows between unbounded preceding and current row) as peak from bars) as p group by symbol")
query("buy_hold", "select symbol, bar_ts, round(close / first_value(close) over (partition by symbol order by bar_ts rows between unbounded preceding and current row) * 10000, 4) as equity from bars")
query(
    "regime_streak",
    """select symbol, bar_ts, regime_id, row_number() over (partition by symbol, island order by bar_ts) as streak
    from (select symbol, bar_ts, regime_id, sum(changed) over (partition by symbol order by bar_ts) as island
      from (select symbol, bar_ts, regime_id, case when regime_id = lag(regime_id) over (partition by symbol order by bar_ts) then 0 else 1 end as changed from regimes) as c) as i""",
)
query("regime_streak_last", "select symbol, regime_id, streak from (select *, row_number() over (partition by symbol order by bar_ts desc) as back from regime_streak) as s where back = 1")
query("latest_bar", f"select symbol, bar_ts, close, coalesce(prev_close, close) as prev_close from (select symbol, bar_ts, close, lag(close) over w as prev_close, row_number() over (partition by symbol order by bar_ts desc) as back from bars {_W}) as l where back = 1")
# The index's last level as of each time that any bar has: worked out once, whatever the number of symbols, and joined by equality.
relation(
    "index_calendar",
    """select bar_ts, coalesce(level, 20) as index_level from (select bar_ts, is_bar, max(level) over (partition by run) as level from (
        select *, count(level) over (order by bar_ts, is_bar rows between unbounded preceding and current row) as run
        from (select bar_ts, 1 as is_bar, cast(null as double) as level from (select distinct bar_ts from bars) as t union all select bar_ts, 0 as is_bar, close as level from index_bars) as u) as m) as r where is_bar = 1""",
)
query("asof_index_join", "select b.symbol, b.bar_ts, c.index_level from bars b join index_calendar c on c.bar_ts = b.bar_ts")
# Two keyed series: the last event of a kind at or before the half of each of its hours.
relation("half_hours", "select symbol, bar_ts + interval '30' minute as bar_ts, close from bars_hourly")
relation("event_values", "select event_type as symbol, ts as bar_ts, max(value) as value from events group by event_type, ts")
query(
    "asof_events_join",
    "select h.symbol, h.bar_ts, round(h.close, 6) as close, round(e.value, 6) as last_value from half_hours h asof left join event_values e on e.symbol = h.symbol and e.bar_ts <= h.bar_ts",
    lambda use: asof_join(use("half_hours"), use("event_values"), "symbol", "bar_ts", "value").select("symbol", "bar_ts", F.round("close", 6).alias("close"), F.round("value", 6).alias("last_value")),
)
