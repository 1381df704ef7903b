"""Bar-by-bar replays of the V1 and V2 strategies, and their metrics.

On Spark a replay is a fold over each symbol's sorted bars (``fold_bars``); the
oracles are recursive queries of their own. A signal stands at its own bar, the first
bar is in cash; a symbol without bars has no trades.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from tidemark.functions.folds import Step, fold_bars
from tidemark.plans.catalog import query, relation

BULL, BEAR = (0, 1, 2), (5, 6)


@dataclass(frozen=True)
class V1:
    """Parameters of the V1 replay; ``trail`` is the share of the equity's peak below which a position is closed."""

    capital: float = 100000.0
    confirmations: int = 5
    cooldown: int = 3
    confirm_bars: int = 2
    leverage: float = 1.0
    trail: float | None = None


@dataclass(frozen=True)
class V2:
    """Parameters of the V2 replay: exits, rolls (most, gap, credits in per cent) and the gates of volatility."""

    capital: float = 100000.0
    confirmations: int = 6
    cooldown: int = 3
    confirm_bars: int = 2
    trail_atrs: float = 2.0
    trail_bars: int = 3
    time_stop: int = 15
    rsi_exit: float = 75.0
    rsi_gain: float = 8.0
    most_rolls: int = 3
    roll_gap: int = 2
    credit_up: float = 0.5
    credit_out: float = 0.3
    index_caution: float = 25.0
    index_halt: float = 35.0
    rank_caution: float = 0.50
    rank_max: float = 0.75
    cautious: int = 8


MODES = {"v1": V1(), "v1_aggressive": V1(leverage=4.0, trail=0.92), "v2": V2()}

#: What either replay says of a bar; the fields from entry_ts on are those of the trade that ends there.
TRADE = "entry_ts timestamp_ntz, entry_price double, entry_regime string, entry_confs int, bars_held int, peak double, rolls int, credits double, pnl double, exit_regime string, reason string"
MADE = f"capital double, signal string, {TRADE}"
TRADE_COLUMNS = tuple(f.split()[0] for f in TRADE.split(", "))
NO_TRADE = (None,) * len(TRADE_COLUMNS)


@dataclass
class Trade:
    bar: int
    ts: object
    price: float
    regime: str
    confs: int
    peak: float
    effective: float
    rolls: int = 0
    credits: float = 0.0
    last_roll: int = 0

    def ended(self, bar: int, pnl: float, regime: str, reason: str) -> tuple:
        return (self.ts, self.price, self.regime, self.confs, bar - self.bar, self.peak, self.rolls, self.credits, pnl, regime, reason)


def v1_step(p: V1) -> Step:
    capital, top, last, where, n, cooldown = p.capital, p.capital, 0.0, "", 0, 0
    trade: Trade | None = None

    def step(row: tuple) -> tuple:
        nonlocal capital, top, last, where, n, cooldown, trade
        ts, close, regime, label, confidence, streak, confs = row
        n, previous, last, where = n + 1, last, close, label
        if n == 1:
            return (capital, "CASH", *NO_TRADE)
        bull = regime in BULL
        if trade:
            capital = capital * (1 + (close / previous - 1) * p.leverage)
            trade.peak = max(trade.peak, close)
            stop = p.trail is not None and capital < top * p.trail
            top = max(top, capital)
            if regime in BEAR or (not bull and confidence > 0.6) or stop:
                fall = f"Trailing stop (-{100 - 100 * p.trail:.0f}% from peak)" if stop else ""
                reason = fall or (f"Regime flip - {label}" if regime in BEAR else f"Regime neutral - {label} (conf {confidence:.0%})")
                done = trade.ended(n, (close / trade.price - 1) * 100 * p.leverage, label, reason)
                trade, cooldown = None, p.cooldown
                return (capital, "EXIT", *done)
            return (capital, "HOLDING", *NO_TRADE)
        if cooldown > 0:
            cooldown -= 1
            return (capital, "COOLDOWN", *NO_TRADE)
        if bull and streak < p.confirm_bars:
            return (capital, "CONFIRMING", *NO_TRADE)
        if bull and confs >= p.confirmations and confidence > 0.5:
            trade = Trade(n, ts, close, label, confs, close, close)
            return (capital, "ENTRY", *NO_TRADE)
        return (capital, "CASH", *NO_TRADE)

    return _with_open(step, lambda: trade and trade.ended(n, (last / trade.price - 1) * 100 * p.leverage, where, "End of backtest"))


def v2_step(p: V2) -> Step:
    capital, last, where, n, cooldown = p.capital, 0.0, "", 0, 0
    trade: Trade | None = None

    def rolled(credit: float) -> None:
        nonlocal capital
        capital *= 1 + credit / 100
        trade.credits, trade.rolls, trade.last_roll = trade.credits + credit, trade.rolls + 1, n

    def exit_reason(close: float, regime: int, label: str, confidence: float, atr: float, rsi: float, gain: float) -> str | None:
        """Why the position ends here; an empty text: it is rolled out instead."""
        held = n - trade.bar
        if regime in BEAR:
            return f"Regime flip - {label}"
        if atr > 0 and held >= p.trail_bars and close < trade.peak - p.trail_atrs * atr:
            return f"ATR trail stop (peak ${trade.peak:.2f})"
        if held >= p.time_stop and gain <= 0:
            return "" if regime in BULL and trade.rolls < p.most_rolls else f"Time stop, can't roll ({held} bars, {gain:+.1f}%)"
        if rsi > p.rsi_exit and gain > p.rsi_gain:
            return f"RSI exit ({rsi:.0f}, +{gain:.1f}%)"
        return f"Regime neutral - {label}" if regime not in BULL and confidence > 0.6 else None

    def entry(ts, close: float, regime: int, label: str, confidence: float, streak: int, confs: int, index: float, rank: float) -> str:
        nonlocal trade
        if index > p.index_halt:
            return "VIX_HALT"
        if rank > p.rank_max:
            return "IV_HIGH"
        wanted = max(p.confirmations, p.cautious) if index > p.index_caution or rank > p.rank_caution else p.confirmations
        if regime in BULL and streak < p.confirm_bars:
            return "CONFIRMING"
        if regime in BULL and confs >= wanted and confidence > 0.5:
            trade = Trade(n, ts, close, label, confs, close, close)
            return "ENTRY"
        return "CASH"

    def step(row: tuple) -> tuple:
        nonlocal capital, last, where, n, cooldown, trade
        ts, close, regime, label, confidence, streak, confs, atr, rsi, rank, index = row
        atr, rsi, rank, index = (d if v is None else v for v, d in ((atr, 0.0), (rsi, 50.0), (rank, 0.5), (index, 20.0)))
        n, previous, last, where = n + 1, last, close, label
        if n == 1:
            return (capital, "CASH", *NO_TRADE)
        if trade:
            capital *= 1 + (close - previous) / previous
            trade.peak = max(trade.peak, close)
            since = n - (trade.last_roll or trade.bar)
            if atr > 0 and close >= trade.effective + atr and regime in BULL and trade.rolls < p.most_rolls and since >= p.roll_gap:
                rolled(p.credit_up)
                trade.effective = close
                return (capital, "ROLL_UP", *NO_TRADE)
            gain = (close - trade.price) / trade.price * 100
            reason = exit_reason(close, regime, label, confidence, atr, rsi, gain)
            if reason == "":
                rolled(p.credit_out)
                return (capital, "ROLL_OUT", *NO_TRADE)
            if reason:
                done = trade.ended(n, gain, label, reason)
                trade, cooldown = None, p.cooldown
                return (capital, "EXIT", *done)
            return (capital, "HOLDING", *NO_TRADE)
        if cooldown > 0:
            cooldown -= 1
            return (capital, "COOLDOWN", *NO_TRADE)
        return (capital, entry(ts, close, regime, label, confidence, streak, confs, index, rank), *NO_TRADE)

    return _with_open(step, lambda: trade and trade.ended(n, (last - trade.price) / trade.price * 100, where, "End of backtest"))


def _with_open(step: Step, standing) -> Step:
    """Each bar also says how a position that is open at its close would end there: only the last bar's counts."""
    return lambda row: (*step(row), *(standing() or NO_TRADE))


OPEN = ", ".join(f"open_{f}" for f in TRADE.split(", "))
OPEN_COLUMNS = tuple(f"open_{c}" for c in TRADE_COLUMNS)


def replay(name: str, use):
    """capital, signal and ended trade of every bar, for one of ``MODES``."""
    p = MODES[name]
    columns = ["close", "regime_id", "regime_label", "confidence", "streak", "confs"] + (["atr", "rsi", "hv_rank", "index_level"] if name == "v2" else [])
    return fold_bars(use(f"replay_input_{'v2' if name == 'v2' else 'v1'}"), columns, partial(v2_step if name == "v2" else v1_step, p), f"{MADE}, {OPEN}")


_INPUT = """select r.symbol, r.bar_ts, r.close, r.regime_id, r.regime_label, r.regime_confidence as confidence, cast(s.streak as int) as streak, cast(c.confirmations_met as int) as confs{more}
    from regimes r join regime_streak s on s.symbol = r.symbol and s.bar_ts = r.bar_ts join {conf} c on c.symbol = r.symbol and c.bar_ts = r.bar_ts{joins}"""
relation("replay_input_v1", _INPUT.format(more="", conf="conf_v1", joins=""))
relation(
    "replay_input_v2",
    _INPUT.format(
        more=", i.atr14 as atr, i.rsi14 as rsi, k.hv_rank, x.index_level",
        conf="conf_v2",
        joins=" join ind i on i.symbol = r.symbol and i.bar_ts = r.bar_ts join rolling_pct_rank k on k.symbol = r.symbol and k.bar_ts = r.bar_ts join asof_index_join x on x.symbol = r.symbol and x.bar_ts = r.bar_ts",
    ),
)


# The oracles: a row a bar, each from the one before. What a bar does is worked out in layers.
def _layers(source: str, *layers: dict[str, str]) -> str:
    for layer in layers:
        source = f"(select *, {', '.join(f'{text} as {name}' for name, text in layer.items())} from {source})"
    return source


def _walk(source: str, capital: float, layers: list[dict[str, str]], after: dict[str, str], ended: dict[str, str], open_pnl: str) -> str:
    """A recursive query; ``after``: the state after a bar, by s_ (state before), bar columns and layers; ``ended``: trade columns where a trade ends."""
    state = {"p_close": "close", "p_label": "regime_label", "capital": f"cast({capital} as double)", "pos": "false", "cooldown": "0", "entry_n": "0", "entry_ts": "bar_ts", "entry_price": "cast(0 as double)", "entry_regime": "''", "entry_confs": "0", "peak": "cast(0 as double)", "rolls": "0", "credits": "cast(0 as double)", "last_roll": "0", "effective": "cast(0 as double)", "top": f"cast({capital} as double)"}
    bars = f"(select *, row_number() over (partition by symbol order by bar_ts) as n from {source})"
    before = ", ".join(f"s.{c} as s_{c}" for c in state)
    joined = f"(select b.*, {before} from walk s join {bars} as b on b.symbol = s.symbol and b.n = s.n + 1)"
    nothing = {"signal": "'CASH'", **{f"done_{c}": f"cast(null as {'timestamp' if c == 'entry_ts' else 'varchar' if c in ('entry_regime', 'exit_regime', 'reason') else 'int' if c in ('entry_confs', 'bars_held', 'rolls') else 'double'})" for c in TRADE_COLUMNS}}
    every = {"symbol": "symbol", "bar_ts": "bar_ts", "n": "n"}
    of_trade = {"entry_ts": "s_entry_ts", "entry_price": "s_entry_price", "entry_regime": "s_entry_regime", "entry_confs": "s_entry_confs", "bars_held": "cast(n - s_entry_n as int)", "peak": "now_peak", "rolls": "s_rolls", "credits": "s_credits", "exit_regime": "regime_label", **ended}
    names = [*every, *state, *nothing]
    first = {**every, **state, **nothing}
    then = {**every, "p_close": "close", "p_label": "regime_label", **{c: f"s_{c}" for c in state if c not in ("p_close", "p_label")}, **after, **{f"done_{c}": f"case when leaves then {t} end" for c, t in of_trade.items()}}
    listed = lambda texts: ", ".join(f"{texts[n]} as {n}" for n in names)
    done = ", ".join(f"done_{c} as {c}" for c in TRADE_COLUMNS)
    standing = {"entry_ts": "entry_ts", "entry_price": "entry_price", "entry_regime": "entry_regime", "entry_confs": "entry_confs", "bars_held": "cast(n - entry_n as int)", "peak": "peak", "rolls": "rolls", "credits": "credits", "pnl": open_pnl, "exit_regime": "p_label", "reason": "'End of backtest'"}
    left = ", ".join(f"case when pos then {t} end as open_{c}" for c, t in standing.items())
    return f"""with recursive walk as (
      select {listed(first)} from {bars} as f where n = 1
      union all select {listed(then)} from {_layers(joined, *layers)})
    select symbol, bar_ts, p_close as close, capital, signal, {done}, {left} from walk"""


_SHARED = {"bull": f"regime_id in {BULL}", "bear": f"regime_id in {BEAR}"}
_TO_ENTER = {"entry_n": "n", "entry_ts": "bar_ts", "entry_price": "close", "entry_regime": "regime_label", "entry_confs": "confs"}


def v1_sql(p: V1) -> str:
    stop = "false" if p.trail is None else f"s_pos and now_capital < s_top * {p.trail}"
    layers = [
        {**_SHARED, "now_capital": f"case when s_pos then s_capital * (1 + (close / s_p_close - 1) * {p.leverage}) else s_capital end", "now_peak": "greatest(s_peak, close)"},
        {"stops": stop, "leaves": f"s_pos and (bear or (not bull and confidence > 0.6) or {stop})", "cools": "not s_pos and s_cooldown > 0", "looks": "not s_pos and s_cooldown = 0"},
        {"enters": f"looks and bull and confs >= {p.confirmations} and confidence > 0.5 and streak >= {p.confirm_bars}"},
    ]
    after = {
        "capital": "now_capital", "top": "greatest(s_top, now_capital)", "pos": "enters or (s_pos and not leaves)", "cooldown": f"case when leaves then {p.cooldown} when cools then s_cooldown - 1 else s_cooldown end",
        **{c: f"case when enters then {t} else s_{c} end" for c, t in _TO_ENTER.items()}, "peak": "case when enters then close else now_peak end",
        "signal": "case when leaves then 'EXIT' when s_pos then 'HOLDING' when cools then 'COOLDOWN' when enters then 'ENTRY' when bull and streak < " + str(p.confirm_bars) + " then 'CONFIRMING' else 'CASH' end",
    }
    ended = {"pnl": f"(close / s_entry_price - 1) * 100 * {p.leverage}", "reason": f"case when stops then 'Trailing stop (-{100 - 100 * (p.trail or 0):.0f}% from peak)' when bear then 'Regime flip - ' || regime_label else 'Regime neutral - ' || regime_label || ' (conf ' || cast(cast(round(confidence * 100) as int) as varchar) || '%)' end"}
    return _walk("replay_input_v1", p.capital, layers, after, ended, f"(p_close / entry_price - 1) * 100 * {p.leverage}")


def v2_sql(p: V2) -> str:
    layers = [
        {**_SHARED, "a": "coalesce(atr, 0)", "r": "coalesce(rsi, 50)", "hv": "coalesce(hv_rank, 0.5)", "vix": "coalesce(index_level, 20)", "now_capital": "case when s_pos then s_capital * (1 + (close - s_p_close) / s_p_close) else s_capital end", "now_peak": "greatest(s_peak, close)",
         "held": "n - s_entry_n", "gain": "(close - s_entry_price) / nullif(s_entry_price, 0) * 100", "since": "n - case when s_last_roll > 0 then s_last_roll else s_entry_n end"},
        {"ups": f"s_pos and a > 0 and close >= s_effective + a and bull and s_rolls < {p.most_rolls} and since >= {p.roll_gap}"},
        {"flips": "s_pos and not ups and bear", "trails": f"s_pos and not ups and not bear and a > 0 and held >= {p.trail_bars} and close < now_peak - {p.trail_atrs} * a"},
        {"timed": f"s_pos and not ups and not flips and not trails and held >= {p.time_stop} and gain <= 0"},
        {"outs": f"timed and bull and s_rolls < {p.most_rolls}"},
        {"takes": f"s_pos and not ups and not flips and not trails and not timed and r > {p.rsi_exit} and gain > {p.rsi_gain}"},
        {"fades": "s_pos and not ups and not flips and not trails and not timed and not takes and not bull and confidence > 0.6"},
        {"leaves": "flips or trails or (timed and not outs) or takes or fades", "cools": "not s_pos and s_cooldown > 0", "looks": "not s_pos and s_cooldown = 0", "wanted": f"case when vix > {p.index_caution} or hv > {p.rank_caution} then greatest({p.confirmations}, {p.cautious}) else {p.confirmations} end"},
        {"gated": f"looks and (vix > {p.index_halt} or hv > {p.rank_max})"},
        {"enters": f"looks and not gated and bull and confs >= wanted and confidence > 0.5 and streak >= {p.confirm_bars}"},
    ]
    after = {
        "capital": f"now_capital * case when ups then 1 + {p.credit_up} / 100 when outs then 1 + {p.credit_out} / 100 else 1 end", "pos": "enters or (s_pos and not leaves)", "cooldown": f"case when leaves then {p.cooldown} when cools then s_cooldown - 1 else s_cooldown end",
        **{c: f"case when enters then {t} else s_{c} end" for c, t in _TO_ENTER.items()}, "peak": "case when enters then close else now_peak end", "effective": "case when enters or ups then close else s_effective end",
        "rolls": "case when enters then 0 when ups or outs then s_rolls + 1 else s_rolls end", "credits": f"case when enters then 0 when ups then s_credits + {p.credit_up} when outs then s_credits + {p.credit_out} else s_credits end", "last_roll": "case when enters then 0 when ups or outs then n else s_last_roll end",
        "signal": f"case when ups then 'ROLL_UP' when outs then 'ROLL_OUT' when leaves then 'EXIT' when s_pos then 'HOLDING' when cools then 'COOLDOWN' when vix > {p.index_halt} then 'VIX_HALT' when gated then 'IV_HIGH' when enters then 'ENTRY' when bull and streak < {p.confirm_bars} then 'CONFIRMING' else 'CASH' end",
    }
    reason = "case when flips then 'Regime flip - ' || regime_label when trails then printf('ATR trail stop (peak $%.2f)', now_peak) when timed then printf('Time stop, can''t roll (%d bars, %+.1f%%)', held, gain) when takes then printf('RSI exit (%.0f, +%.1f%%)', r, gain) else 'Regime neutral - ' || regime_label end"
    return _walk("replay_input_v2", p.capital, layers, after, {"pnl": "gain", "reason": reason}, "(p_close - entry_price) / entry_price * 100")


for _mode, _p in MODES.items():
    _sql = v2_sql(_p) if _mode == "v2" else v1_sql(_p)
    relation(f"replay_{_mode}", _sql, partial(replay, _mode))
    query(f"backtest_{_mode}_equity", f"select symbol, bar_ts, round(capital, 4) as equity, signal from replay_{_mode}")
    relation(
        f"trades_{_mode}",
        f"""select symbol, bar_ts as exit_ts, close as exit_price, {", ".join(TRADE_COLUMNS)} from replay_{_mode} where reason is not null
        union all select symbol, bar_ts as exit_ts, close as exit_price, {", ".join(f"{o} as {c}" for o, c in zip(OPEN_COLUMNS, TRADE_COLUMNS, strict=True))}
        from (select *, row_number() over (partition by symbol order by bar_ts desc) as back from replay_{_mode}) as l where back = 1 and open_reason is not null""",
    )
    _rolls = ", rolls as roll_count, round(credits, 4) as roll_credits_pct" if _mode == "v2" else ""
    query(
        f"backtest_{_mode}_trades",
        f"""select symbol, entry_ts, round(entry_price, 4) as entry_price, entry_regime, entry_confs as confirmations_at_entry, exit_ts, round(exit_price, 4) as exit_price, exit_regime, bars_held,
          round(peak, 4) as peak_price, round((peak - entry_price) / entry_price * 100, 4) as peak_gain_pct, round(pnl, 4) as pnl_pct, reason{_rolls} from trades_{_mode}""",
    )
    _more = """, round(coalesce(avg_bars, 0), 4) as avg_bars_held, round(coalesce(avg_peak, 0), 4) as avg_peak_gain, round(coalesce(avg_peak - avg_pnl, 0), 4) as avg_giveback, coalesce(all_rolls, 0) as total_rolls, coalesce(with_rolls, 0) as trades_with_rolls,
          round(coalesce(cast(all_rolls as double) / n, 0), 4) as avg_rolls_per_trade, round(coalesce(all_credits, 0), 4) as total_roll_credits_pct""" if _mode == "v2" else ""  # fmt: skip
    query(
        f"metrics_{_mode}",
        f"""select e.symbol, case when n is null then 0 else round((final - {_p.capital}) / {_p.capital} * 100, 4) end as total_return_pct, case when n is null then 0 else round(hold, 4) end as buyhold_return_pct,
          case when n is null then 0 else round((final - {_p.capital}) / {_p.capital} * 100 - hold, 4) end as alpha_vs_buyhold, case when n is null then 0 else round(dd, 4) end as max_drawdown_pct, case when n is null then 0 else round(coalesce(mean_ret / nullif(dev_ret, 0) * sqrt(252), 0), 4) end as sharpe_ratio,
          coalesce(n, 0) as total_trades, coalesce(wins, 0) as winning_trades, coalesce(n - wins, 0) as losing_trades, round(coalesce(100.0 * cast(wins as double) / n, 0), 4) as win_rate, round(coalesce(avg_win, 0), 4) as avg_win_pct, round(coalesce(avg_loss, 0), 4) as avg_loss_pct,
          case when n is null then 0 else round(gain / nullif(coalesce(loss, 1), 0), 4) end as profit_factor, round(case when n is null then {_p.capital} else final end, 4) as final_equity{_more}
        from (select symbol, max(case when back = 1 then capital end) as final, (max(case when back = 1 then close end) / max(case when fore = 1 then close end) - 1) * 100 as hold, min((capital - top) / top * 100) as dd, avg(ret) as mean_ret, stddev_samp(ret) as dev_ret
          from (select symbol, capital, close, row_number() over (partition by symbol order by bar_ts desc) as back, row_number() over (partition by symbol order by bar_ts) as fore, max(capital) over (partition by symbol order by bar_ts rows between unbounded preceding and current row) as top, capital / lag(capital) over (partition by symbol order by bar_ts) - 1 as ret from replay_{_mode}) as r group by symbol) as e
        left join (select symbol, count(*) as n, count_if(pnl > 0) as wins, avg(pnl) as avg_pnl, avg(case when pnl > 0 then pnl end) as avg_win, avg(case when pnl <= 0 then pnl end) as avg_loss, sum(case when pnl > 0 then pnl else 0 end) as gain, abs(sum(case when pnl <= 0 then pnl end)) as loss,
          avg(bars_held) as avg_bars, avg((peak - entry_price) / entry_price * 100) as avg_peak, sum(rolls) as all_rolls, count_if(rolls > 0) as with_rolls, sum(credits) as all_credits from trades_{_mode} group by symbol) as t on t.symbol = e.symbol""",
    )

query("backtest_v2_exit_reasons", "select symbol, exit_reason, count(*) as n from (select symbol, trim(split_part(reason, '(', 1)) as exit_reason from trades_v2) as r group by symbol, exit_reason")
