"""Recursive indicators of a bar series, all in one fold.

Exponential averages start at the first value and move by 2 / (n + 1) of the
distance; Wilder's by 1 / n (Wilder, 1978). An indicator over n bars is null for
the first n - 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.functions.folds import Step, fold_bars

EMA_SPANS = (10, 12, 20, 26, 50, 200)
SIGNAL_SPAN, WILDER, WILDER_LONG = 9, 14, 20


def _ema_alpha(span: int) -> float:
    return 2.0 / (span + 1)


#: What the fold makes of each bar: its number and the smoothed quantities.
STATE = ("n", *(f"e{s}" for s in EMA_SPANS), "macd", "macd_signal", "gain", "loss", "atr14", "atr20", "adx")


def indicator_step() -> Step:
    """Recursive averages of one symbol's bars (open, high, low, close, volume). A bar without prices gives nulls and changes nothing."""
    alphas = [_ema_alpha(k) for k in EMA_SPANS]
    fast, slow, signal_alpha, w, w_long = EMA_SPANS.index(12), EMA_SPANS.index(26), _ema_alpha(SIGNAL_SPAN), 1.0 / WILDER, 1.0 / WILDER_LONG
    n, before, levels, signal, adx = 0, (0.0, 0.0, 0.0), [], 0.0, 0.0
    wilder: list[float] = []
    weights = (w, w, w, w_long, w, w)

    def step(bar: tuple) -> tuple:
        nonlocal n, before, levels, signal, adx, wilder
        _, _, high, low, close, _ = bar
        if high is None or low is None or close is None:
            return (None,) * len(STATE)
        if n == 0:
            levels, wilder, macd = [close] * len(alphas), [0.0, 0.0, high - low, high - low, 0.0, 0.0], 0.0
        else:
            p_close, p_high, p_low = before
            change, rise, fall = close - p_close, high - p_high, p_low - low
            span = max(high - low, abs(high - p_close), abs(low - p_close))
            new = (max(change, 0.0), max(-change, 0.0), span, span, rise if rise > fall and rise > 0 else 0.0, fall if fall > rise and fall > 0 else 0.0)
            levels = [e + (close - e) * a for e, a in zip(levels, alphas, strict=True)]
            wilder = [v + (x - v) * a for v, x, a in zip(wilder, new, weights, strict=True)]
            macd = levels[fast] - levels[slow]
            signal += (macd - signal) * signal_alpha
        up, down = wilder[4:]
        spread = 100.0 * abs(up - down) / (up + down) if up + down else 0.0
        adx = spread if n == 0 else adx + (spread - adx) * w
        n, before = n + 1, (close, high, low)
        return (n, *levels, macd, signal, *wilder[:4], adx)

    return step


def indicators(bars: DataFrame) -> DataFrame:
    """symbol, bar_ts, open, high, low, close, volume and ema10 ... adx14 of every bar."""
    made = "n int, " + ", ".join(f"{c} double" for c in STATE[1:])
    folded = fold_bars(bars, ["open", "high", "low", "close", "volume"], indicator_step, made)
    return folded.selectExpr("symbol", "bar_ts", "open", "high", "low", "close", "volume", *_finish())


def _finish() -> list[str]:
    """The outputs, in SQL that both engines take, from the state."""
    from_bar = lambda n, x: f"case when n >= {n} then {x} end"
    emas = [f"{from_bar(s, f'e{s}')} as ema{s}" for s in (10, 20, 50, 200)]
    signal = SIGNAL_SPAN + 26 - 1
    return [
        *emas,
        f"{from_bar(26, 'macd')} as macd",
        f"{from_bar(signal, 'macd_signal')} as macd_signal",
        f"{from_bar(signal, 'macd - macd_signal')} as macd_hist",
        f"{from_bar(WILDER, 'case when gain + loss = 0 then 50 else 100 * gain / (case when gain + loss = 0 then 1 else gain + loss end) end')} as rsi14",
        f"{from_bar(WILDER, 'atr14')} as atr14",
        f"{from_bar(WILDER_LONG, 'atr20')} as atr20",
        f"{from_bar(WILDER, 'adx')} as adx14",
    ]


def indicators_sql(source: str = "bars") -> str:
    """The oracle: the same recursion as a recursive query, all symbols a step at a time."""
    number = lambda x: f"cast('{x!r}' as double)"
    smooth = lambda p, v, a: f"{p} + ({v} - {p}) * {number(a)}"
    w = 1.0 / WILDER
    raw = (
        "b.*, s.n as s_n, s.e10 as s_e10, s.e12 as s_e12, s.e20 as s_e20, s.e26 as s_e26, s.e50 as s_e50, s.e200 as s_e200, s.macd_signal as s_signal, s.gain as s_gain, s.loss as s_loss, s.atr14 as s_atr14, s.atr20 as s_atr20, s.up as s_up, s.down as s_down, s.adx as s_adx, "
        "greatest(b.close - s.close, 0) as x_gain, greatest(s.close - b.close, 0) as x_loss, greatest(b.high - b.low, abs(b.high - s.close), abs(b.low - s.close)) as x_range, "
        "case when b.high - s.high > s.low - b.low and b.high - s.high > 0 then b.high - s.high else 0 end as x_up, case when s.low - b.low > b.high - s.high and s.low - b.low > 0 then s.low - b.low else 0 end as x_down"
    )
    level = ", ".join(
        [*(f"{smooth(f's_e{k}', 'close', _ema_alpha(k))} as e{k}" for k in EMA_SPANS), f"{smooth('s_gain', 'x_gain', w)} as gain", f"{smooth('s_loss', 'x_loss', w)} as loss",
         f"{smooth('s_atr14', 'x_range', w)} as atr14", f"{smooth('s_atr20', 'x_range', 1.0 / WILDER_LONG)} as atr20", f"{smooth('s_up', 'x_up', w)} as up", f"{smooth('s_down', 'x_down', w)} as down"]
    )
    dx = "case when up + down = 0 then 0 else 100 * abs(up - down) / (up + down) end"
    columns = "symbol, bar_ts, open, high, low, close, volume, n, e10, e12, e20, e26, e50, e200, macd, macd_signal, gain, loss, atr14, atr20, up, down, adx"
    return f"""
    with recursive numbered as (select *, row_number() over (partition by symbol order by bar_ts) as n from {source}),
    fold as (
      select symbol, bar_ts, open, high, low, close, volume, n, close as e10, close as e12, close as e20, close as e26, close as e50, close as e200, cast(0 as double) as macd, cast(0 as double) as macd_signal,
        cast(0 as double) as gain, cast(0 as double) as loss, high - low as atr14, high - low as atr20, cast(0 as double) as up, cast(0 as double) as down, cast(0 as double) as adx from numbered where n = 1
      union all
      select {columns.replace("macd, macd_signal", f"e12 - e26 as macd, {smooth('s_signal', '(e12 - e26)', _ema_alpha(SIGNAL_SPAN))} as macd_signal").replace(", adx", f", {smooth('s_adx', f'({dx})', w)} as adx")}
      from (select *, {level} from (select {raw} from fold s join numbered b on b.symbol = s.symbol and b.n = s.n + 1)))
    select symbol, bar_ts, open, high, low, close, volume, {", ".join(_finish())} from fold
    """
