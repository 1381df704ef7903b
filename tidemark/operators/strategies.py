"""Confirmations and signals of the four strategies."""

from __future__ import annotations

import re

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.windows import frame, rolling
from tidemark.plans.catalog import query, relation

#: What the texts of ``conf_input`` and of those that rest on it read, and Spark's single pass over ``ranked_bars`` goes around.
_RANKS = ("rolling_pct_rank", "rank_input", "hist_vol", "daily_returns")
_STATES = (*_RANKS, "conf_input", "levels", "levels_lagged")
LAGS = {"close_10": ("close", 10), "close_5": ("close", 5), "close_252": ("close", 252), "atr14_1": ("atr14", 1), "high_1": ("high", 1), "low_3": ("low", 3), "macd_hist_1": ("macd_hist", 1)}
_W = "over (partition by symbol order by bar_ts)"

relation(
    "conf_input",
    f"""select i.*, lag(i.close, 10) over w as close_10, lag(i.close, 5) over w as close_5, lag(i.close, 252) over w as close_252, lag(i.atr14) over w as atr14_1, lag(i.high) over w as high_1, lag(i.low, 3) over w as low_3, lag(i.macd_hist) over w as macd_hist_1,
      avg(cast(i.volume as double)) over (partition by i.symbol order by i.bar_ts rows between 19 preceding and current row) as vol_20, max(i.rsi14) over (partition by i.symbol order by i.bar_ts rows between 4 preceding and current row) as rsi_max5,
      r.atr_rank, r.hv_rank
    from ind i join rolling_pct_rank r on r.symbol = i.symbol and r.bar_ts = i.bar_ts window w as (partition by i.symbol order by i.bar_ts)""",
    lambda use: use("bar_states").select(*use("ind").columns, *LAGS, "vol_20", "rsi_max5", "atr_rank", "hv_rank"),
    around=_RANKS,
)
#: Levels: the aggregate, its column, the bars of its frame, the fewest values in it and how many bars back it ends.
LEVELS = {
    "high_252": ("max", "high", 252, 60, 0),
    "low_252": ("min", "low", 252, 60, 0),
    "high_20": ("max", "high", 20, 5, 0),
    "low_20": ("min", "low", 20, 5, 0),
    "low_10": ("min", "low", 10, 3, 0),
    "prior_high_20": ("max", "high", 20, 5, 1),
    "low_1m": ("min", "low", 21, 10, 0),
    "low_2m": ("min", "low", 21, 10, 21),
    "low_3m": ("min", "low", 21, 10, 42),
    "vol_5": ("avg", "cast(volume as double)", 5, 2, 0),
    "vol_20_5": ("avg", "cast(volume as double)", 20, 5, 0),
    "vol_50": ("avg", "cast(volume as double)", 50, 20, 0),
}
_LEVELS = ", ".join(f"{rolling(*of)} as {name}" for name, of in LEVELS.items())
relation("levels", f"select symbol, bar_ts, {_LEVELS} from bars")
relation("levels_lagged", "select *, lag(low_10, 10) over (partition by symbol order by bar_ts) as low_10_10 from levels")


def bar_states(use) -> DataFrame:
    """A row a bar with all that any strategy asks: indicators, ranks, lags and levels.

    All windows are over a symbol's bars in order, so that one shuffle of ``ranked_bars`` serves them all.
    """
    lags = [f"lag({column}, {n}) {_W} as {name}" for name, (column, n) in LAGS.items()]
    frames = [f"avg(cast(volume as double)) {frame(20)} as vol_20", f"max(rsi14) {frame(5)} as rsi_max5"]
    wide = use("ranked_bars").drop("n").selectExpr("*", *lags, *frames, f"struct({_LEVELS}) as v")
    return wide.selectExpr("* except (v)", "v.*", f"lag(v.low_10, 10) {_W} as low_10_10")


relation("bar_states", "", bar_states)

#: Each strategy's predicates, in order.
V1 = {
    "rsi_below_90": "rsi14 < 90",
    "rsi_above_25": "rsi14 > 25",
    "momentum": "close - close_10 > 0",
    "atr_rising": "round(atr14 - atr14_1, 9) > 0",
    "volume": "volume > vol_20",
    "adx": "adx14 > 20",
    "above_ema50": "close > ema50",
    "macd": "macd_hist > 0",
}
V2 = {
    "rsi_band": "rsi14 between 30 and 70",
    "above_ema20": "close > ema20",
    "above_ema50": "close > ema50",
    "macd": "macd_hist > 0",
    "adx": "adx14 > 20",
    "volume": "volume > vol_20",
    "rsi_recent": "rsi_max5 > 50",
    "roc": "close / close_5 > close / close_10",
    "atr_rank": "atr_rank < 0.70",
    "near_ema20": "abs((close - ema20) / ema20 * 100) < 5",
    "breakout": "close > high_1",
    "higher_low": "low > low_3",
}
LEAPS = {
    "above_ema200": "close > ema200",
    "above_ema50": "close > ema50",
    "golden": "ema50 > ema200",
    "rsi_band": "rsi14 between 40 and 70",
    "adx": "adx14 > 20",
    "macd": "macd > macd_signal",
    "year_up": "close / close_252 - 1 > 0",
    "hv_rank": "hv_rank < 0.50",
    "rising_lows": "low_1m > low_2m and low_2m > low_3m",
    "volume": "volume > vol_50",
}
BOTTOMING = {
    "off_high": "close <= 0.65 * high_252",
    "off_low": "close >= 1.15 * low_252",
    "atr_calm": "atr20 / close <= 0.08",
    "tight_range": "(high_20 - low_20) / close < 0.20",
    "higher_lows": "low_10 > low_10_10",
    "volume_dry": "vol_5 < vol_20_5",
    "breakout": "close > prior_high_20",
    "volume_surge": "volume > 1.5 * vol_20_5",
    "upper_half": "close > (high + low) / 2",
    "above_ema50": "close > ema50",
    "ema_cross": "ema10 > ema20",
    "macd_turn": "macd_hist > 0 and macd_hist > macd_hist_1",
}
STRATEGIES = {"v1": V1, "v2": V2, "leaps": LEAPS, "bottoming": BOTTOMING}

_JOINED = """(select c.*, v.high_252, v.low_252, v.high_20, v.low_20, v.low_10, v.prior_high_20, v.low_1m, v.low_2m, v.low_3m, v.vol_5, v.vol_20_5, v.vol_50, v.low_10_10
  from conf_input c join levels_lagged v on v.symbol = c.symbol and v.bar_ts = c.bar_ts) as j"""



def confirmations(strategy: str, use) -> DataFrame:
    """A strategy's predicates of every bar and how many of them hold."""
    flags = [f"coalesce({rule}, false) as conf_{key}" for key, rule in STRATEGIES[strategy].items()]
    return use("bar_states").selectExpr("symbol", "bar_ts", *flags).selectExpr("*", " + ".join(f"cast(conf_{key} as int)" for key in STRATEGIES[strategy]) + " as confirmations_met")


for _name, _rules in STRATEGIES.items():
    _flags = ", ".join(f"coalesce({rule}, false) as conf_{key}" for key, rule in _rules.items())
    _sum = " + ".join(f"cast(conf_{key} as int)" for key in _rules)
    query(f"conf_{_name}", f"select *, {_sum} as confirmations_met from (select symbol, bar_ts, {_flags} from {_JOINED}) as f", partial(confirmations, _name), around=_STATES)

_LAST = """(select r.symbol, r.bar_ts, r.close, r.regime_id, r.regime_label, r.regime_confidence, coalesce(r.prev_id, r.regime_id) as prev_regime_id, s.streak, c.confirmations_met as confs{more}
  from (select *, lag(regime_id) over (partition by symbol order by bar_ts) as prev_id, row_number() over (partition by symbol order by bar_ts desc) as back from regimes) as r
  join regime_streak s on s.symbol = r.symbol and s.bar_ts = r.bar_ts join {conf} c on c.symbol = r.symbol and c.bar_ts = r.bar_ts where r.back = 1) as l"""

_BULL, _BEAR = "(0, 1, 2)", "(5, 6)"
_SWING = f"""case when regime_id in {_BULL} and confs >= {{k}} and streak >= {{c}} then case when prev_regime_id in {_BULL} then 'LONG -- HOLD' else 'LONG -- ENTER' end
  when regime_id in {_BULL} and confs >= {{k}} then 'LONG -- CONFIRMING'
  when regime_id in {_BEAR} then case when prev_regime_id in {_BULL} then 'EXIT -- REGIME FLIP' else 'CASH -- BEARISH' end else 'CASH -- NEUTRAL' end"""
_LEAPS = f"""case when confs >= {{k}} and regime_id in {_BULL} and streak >= {{c}} then 'LEAPS -- BUY' when confs >= {{k}} and regime_id in {_BULL} then 'LEAPS -- WATCH'
  when confs >= {{k}} - 1 and regime_id <= 3 then 'LEAPS -- WATCH' when regime_id in {_BEAR} then case when prev_regime_id in {_BULL} then 'LEAPS -- EXIT' else 'LEAPS -- AVOID' end else 'LEAPS -- WAIT' end"""
_BOTTOM = "case when not gates then 'BOTTOM -- N/A' when regime_id = 6 then 'BOTTOM -- AVOID' when confs >= 9 and regime_id <= 3 then 'BOTTOM -- BUY' when confs >= {k} then 'BOTTOM -- WATCH' else 'BOTTOM -- WAIT' end"


def signal_sql(strategy: str, min_confirmations: int, confirm_bars: int) -> str:
    """The latest bar's signal under a strategy's decision chain."""
    chain = _CHAINS[strategy]
    more = ", c.conf_off_high and c.conf_off_low as gates" if strategy == "bottoming" else ""
    source = _LAST.replace("{more}", more).replace("{conf}", f"conf_{strategy}")
    return f"select symbol, bar_ts, close, regime_id, regime_label, regime_confidence, streak, confs, {chain.format(k=min_confirmations, c=confirm_bars)} as signal from {source}"


#: Fewest confirmations and bars of a regime, by strategy.
DEFAULTS = {"v1": (5, 2), "v2": (6, 2), "leaps": (5, 3), "bottoming": (8, 2)}
_SIGNAL = ("symbol", "bar_ts", "close", "regime_id", "regime_label", "regime_confidence", "streak", "confs", "signal")
_CHAINS = {"v1": _SWING, "v2": _SWING, "leaps": _LEAPS, "bottoming": _BOTTOM}
#: What the texts of signals and scans read and ``signal_table`` goes around.
AROUND = (*_STATES, *(f"conf_{n}" for n in STRATEGIES), "regime_streak")


def last_regimes(regimes: DataFrame) -> DataFrame:
    """Each symbol's last bar with its regime, the one before and for how many bars it has lasted."""
    walked = regimes.selectExpr(
        "symbol", "bar_ts as at", "close", "regime_id", "regime_label", "regime_confidence", f"lag(regime_id) {_W} as prev_id", f"row_number() {_W} as n",
    ).selectExpr("*", "regime_id is null or prev_id is null or regime_id <> prev_id as begins")
    last = walked.groupBy("symbol").agg(F.expr("max_by(struct(at, close, regime_id, regime_label, regime_confidence, prev_id), n) as l"), F.expr("max(n) - max(n) filter (where begins) + 1 as streak"))
    return last.selectExpr("symbol", "l.*", "coalesce(l.prev_id, l.regime_id) as prev_regime_id", "streak").drop("prev_id")


def last_states() -> list[str]:
    """What ``bar_states`` has of one bar, as aggregates over a symbol's bars by how far ``back`` from it they lie: they merge, and cost one pass."""
    at = lambda column, back, name: f"max({column}) filter (where back = {back}) as {name}"
    within = lambda agg, column, n, end=0: f"{agg}({column}) filter (where back between {end} and {end + n - 1})"
    level = lambda agg, column, n, least, end: f"case when {within('count', column, n, end)} >= {least} then {within(agg, column, n, end)} end"
    bar = ("open", "high", "low", "close", "volume", "ema10", "ema20", "ema50", "ema200", "macd", "macd_signal", "macd_hist", "rsi14", "atr14", "atr20", "adx14", "atr_rank", "hv_rank")
    low_10 = ("min", "low", 10, LEVELS["low_10"][3], 10)
    return [
        *(at(c, 0, c) for c in bar), *(at(column, n, name) for name, (column, n) in LAGS.items()), *(f"{level(*of)} as {name}" for name, of in (LEVELS | {"low_10_10": low_10}).items()),
        f"{within('avg', 'cast(volume as double)', 20)} as vol_20", f"{within('max', 'rsi14', 5)} as rsi_max5",
    ]


#: Of the last bar of all: what a scan tells of it.
_STATS = ("max(close) filter (where n = n_bars) as last_close", "max(close) filter (where n = n_bars - 1) as close_1", "avg(cast(volume as double)) filter (where n > n_bars - 30) as vol_30")


def signal_table(use) -> DataFrame:
    """Every strategy's signal of each symbol, with what a scan tells of the last bar.

    A signal stands at one bar, so no window is worked out: the bars know their numbers, each symbol's last regime
    finds its own, and aggregates over those before it give all states, partly summed before they are shuffled. A
    symbol becomes one row, and that row four, one a strategy. A symbol whose last regime has no bar of its time
    gives none.
    """
    bars, regimes = use("ranked_bars"), last_regimes(use("regimes")).withColumnsRenamed({"symbol": "of", "close": "price"})
    known = [c for c in regimes.columns if c != "of"]
    numbers = bars.select("symbol", "bar_ts", "n").join(regimes, F.expr("symbol = of")).groupBy("of", *known).agg(F.expr("max(n) filter (where bar_ts = at) as n_at"), F.max("n").alias("n_bars")).where("n_at is not null")
    numbered = bars.join(numbers, F.expr("symbol = of")).withColumn("back", F.expr("n_at - n"))
    states = numbered.groupBy("symbol", *known, "n_bars").agg(*map(F.expr, (*last_states(), *_STATS)))
    met = lambda rules: " + ".join(f"cast(coalesce({rule}, false) as int)" for rule in rules.values())
    four = ", ".join(f"struct('{n}' as strategy, {met(rules)} as confs)" for n, rules in STRATEGIES.items())
    gates = " and ".join(f"coalesce({BOTTOMING[g]}, false)" for g in ("off_high", "off_low"))
    told = states.selectExpr("symbol", *known, "n_bars", "last_close", "close_1", "vol_30", f"{gates} as gates", f"inline(array({four}))").withColumnsRenamed({"at": "bar_ts", "price": "close"})
    chain = " ".join(f"when '{n}' then {_CHAINS[n].format(k=k, c=c)}" for n, (k, c) in DEFAULTS.items())
    return told.withColumn("signal", F.expr(f"case strategy {chain} end")).select("strategy", *_SIGNAL, "last_close", "close_1", "vol_30", "n_bars")


relation("signal_table", "", signal_table)


def strategy_signals(strategy: str, use) -> DataFrame:
    return use("signal_table").where(F.col("strategy") == strategy).select(*_SIGNAL)


for _name, (_k, _c) in DEFAULTS.items():
    query(f"signal_{_name}", signal_sql(_name, _k, _c), partial(strategy_signals, _name), around=AROUND)

# What a user is told of each signal. {confs}, {streak}, {label}, {bars} and the like are filled in.
ACTIONS = {
    "v1": {
        "LONG -- HOLD": "Maintain long position. Regime still bullish.",
        "LONG -- ENTER": "Bullish regime confirmed ({streak} bars). {confs}/8 confirmations met. Enter long.",
        "LONG -- CONFIRMING": "Bullish regime detected but not yet confirmed ({streak}/{bars} bars). Wait for confirmation.",
        "EXIT -- REGIME FLIP": "Regime flipped bearish. Close all longs immediately.",
        "CASH -- BEARISH": "Market in bearish regime. Stay flat.",
        "CASH -- NEUTRAL": "Regime is {label}. Only {confs}/8 confirmations. No trade.",
    },
    "v2": {
        "LONG -- HOLD": "Maintain position. Regime still bullish.",
        "LONG -- ENTER": "Bullish regime confirmed ({streak} bars). {confs}/12 confirmations. Enter long call.",
        "LONG -- CONFIRMING": "Bullish detected, confirming ({streak}/{bars} bars). Prepare entry.",
        "EXIT -- REGIME FLIP": "Regime flipped bearish. Close all calls immediately.",
        "CASH -- BEARISH": "Bearish regime. No calls.",
        "CASH -- NEUTRAL": "Regime: {label}. {confs}/12 confirmations. No trade.",
    },
    "leaps": {
        "LEAPS -- BUY": "Strong LEAPS entry. {confs}/10 confirmations. {label} confirmed ({streak} bars). IV rank: {hv}.",
        "LEAPS -- WATCH, confirming": "Bullish with {confs}/10 confs, confirming regime ({streak}/{bars} bars). Prepare LEAPS entry.",
        "LEAPS -- WATCH, intact": "Trend intact ({confs}/10 confs) but regime is {label}. Wait for bullish confirmation or enter on dip.",
        "LEAPS -- WATCH, near": "Near threshold ({confs}/10 confs). {label}. Monitor for confirmation.",
        "LEAPS -- EXIT": "Regime flipped bearish. Consider closing or rolling LEAPS.",
        "LEAPS -- AVOID": "Bearish regime. No LEAPS entry.",
        "LEAPS -- WAIT": "Regime: {label}. {confs}/10 confirmations. Not enough for LEAPS entry.",
    },
    "bottoming": {
        "BOTTOM -- N/A": "Not a bottoming candidate (off-high {high}%, off-low {low}%).",
        "BOTTOM -- AVOID": "Valid setup ({confs}/12) but regime is Crash/Capitulation. Do not catch falling knives.",
        "BOTTOM -- BUY": "Strong bottoming entry. {confs}/12 confs. {label}. Price {high}% from 52w high, {low}% above 52w low.",
        "BOTTOM -- WATCH": "Setup valid ({confs}/12) but regime is {label}. Watch for confirmation.",
        "BOTTOM -- WAIT": "{confs}/12 confirmations in {label}. Not enough for bottoming entry.",
    },
}
_text = lambda x: f"coalesce(cast({x} as string), 'None')"
_FILLED = {"{confs}": _text("confs"), "{streak}": _text("streak"), "{label}": "regime_label", "{hv}": "cast(cast(round(coalesce(hv_rank, 0.5) * 100) as int) as string) || '%'", "{high}": _text("off_high"), "{low}": _text("off_low")}


def action_text(template: str, bars: int) -> str:
    """The template as a concatenation."""
    parts = re.split(r"(\{[a-z]+\})", template.replace("{bars}", str(bars)))
    return " || ".join(_FILLED.get(p) or f"'{p}'" for p in parts if p)


def _case(strategy: str, kind: str) -> str:
    k, bars = DEFAULTS[strategy]
    return f"when strategy = '{strategy}' and kind = '{kind}' then {action_text(ACTIONS[strategy][kind], bars)}"


_KIND = f"case when strategy = 'leaps' and signal = 'LEAPS -- WATCH' then signal || case when confs < {DEFAULTS['leaps'][0]} then ', near' when regime_id in {_BULL} then ', confirming' else ', intact' end else signal end"
relation(
    "last_ranges",
    """select symbol, hv_rank, round((close / high_252 - 1) * 100, 1) as off_high, round((close / low_252 - 1) * 100, 1) as off_low from (
      select c.symbol, c.close, c.hv_rank, v.high_252, v.low_252, row_number() over (partition by c.symbol order by c.bar_ts desc) as back from conf_input c join levels v on v.symbol = c.symbol and v.bar_ts = c.bar_ts) as l where back = 1""",
)
relation("all_signals", " union all ".join(f"select '{n}' as strategy, symbol, signal, regime_id, regime_label, streak, confs from signal_{n}" for n in DEFAULTS), lambda use: use("signal_table").select("strategy", "symbol", "signal", "regime_id", "regime_label", "streak", "confs"), around=(*AROUND, *(f"signal_{n}" for n in DEFAULTS)))
query(
    "signal_actions",
    f"select strategy, symbol, signal, case {' '.join(_case(n, kind) for n in ACTIONS for kind in ACTIONS[n])} end as action from (select s.*, l.hv_rank, l.off_high, l.off_low, {_KIND} as kind from all_signals s join last_ranges l on l.symbol = s.symbol) as r",
)

query("regime_labels", "select regime_id, regime_label, count(*) as bars from regimes group by regime_id, regime_label")
query("vix_level", "select bar_ts, round(close, 4) as level, case when close >= 35 then 'halt' when close >= 25 then 'caution' when close >= 20 then 'elevated' else 'low' end as label from index_bars")
query(
    "confirmation_detail",
    "select symbol, name, passed from (" + " union all ".join(f"select symbol, bar_ts, '{key.replace('_', ' ').title()}' as name, conf_{key} as passed, row_number() over (partition by symbol order by bar_ts desc) as back from conf_v1" for key in V1) + ") as d where back = 1",
)
relation(
    "default_settings",
    """select strategy, min_confirmations, regime_confirm_bars, cooldown_bars, min_dte, max_dte, min_avg_volume, price_above_ema50 from (values
    ('v1', 7, 2, 48, 14, 45, 1000000, true), ('v2', 8, 2, 3, 30, 60, 500000, false), ('leaps', 7, 3, 10, 180, 730, 1000000, true), ('bottoming', 8, 2, 5, 30, 60, 500000, false))
    as d(strategy, min_confirmations, regime_confirm_bars, cooldown_bars, min_dte, max_dte, min_avg_volume, price_above_ema50)""",
)
