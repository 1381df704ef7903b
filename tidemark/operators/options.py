"""Option chains: Greeks, gamma exposure, contract scores, rolls and sizing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.pricing import gammas, greeks
from tidemark.plans.catalog import query, relation

SCORE_MAX_DTE, TOP, LADDER_STEPS = 365, 5, 50
# Strategies of the gamma matrix with their days to expiry and strike ranges (a is spot, w the call wall).
GEX_STRATEGIES = {
    "pin_play": (7, 30, "0.98 * spot", "least(1.05 * spot, call_wall)"),
    "controlled_drift": (21, 45, "spot", "1.02 * call_wall"),
    "breakout_ride": (14, 45, "1.01 * spot", "1.10 * spot"),
    "trend_follow": (30, 60, "0.99 * spot", "1.07 * spot"),
    "gamma_scalp": (0, 14, "0.98 * spot", "1.02 * spot"),
}
DTE_PRESETS = {"weekly": (0, 7), "swing": (14, 45), "monthly": (30, 60), "leaps": (180, 730)}

# The latest regime and confirmations of each chain's symbol, from the chain itself (the test tables have no common symbols).
relation("option_symbols", "select symbol, max(spot) as spot, cast(count(*) % 7 as int) as regime_id, cast(count(*) % 13 as int) as confs from chain group by symbol")
relation("quotes", "select *, case when bid + ask > 0 then (bid + ask) / 2 else last end as mid, cast(dte as double) / 365 as t, coalesce(nullif(iv, 0), 0.3) as sigma from chain where dte between 0 and 730")


def greeks_once(source: str, *names: str):
    """The named Greeks of a relation as columns that are worked out once: without the array, a filter on one of them would repeat its whole text."""

    def build(use):
        quotes = use(source)
        priced = quotes.sparkSession.sql("select * from " + greeks("{quotes}") + " as g", quotes=quotes)
        return priced.select(*quotes.columns, F.inline(F.array(F.struct(*names))))

    return build


relation("greek_quotes", f"select * from {greeks('quotes')} as g", greeks_once("quotes", "delta", "gamma", "theta"))
_CONTRACT = "symbol, side, strike, dte, bid, ask, oi, volume, iv"

query("chain_scan", f"select {_CONTRACT}, round(sigma, 6) as sigma from quotes")
query("chain_dte_presets", " union all ".join(f"select '{n}' as preset, count(*) as contracts from chain where dte between {a} and {b}" for n, (a, b) in DTE_PRESETS.items()))
query("bs_delta", f"select {_CONTRACT}, round(delta, 6) + 0 as delta from greek_quotes")
query("bs_gamma", f"select {_CONTRACT}, round(gamma, 6) as gamma from greek_quotes")
query("bs_theta", f"select {_CONTRACT}, round(theta, 6) + 0 as theta from greek_quotes")

relation("gamma_quotes", f"select * from {gammas('(select * from quotes where oi > 0 and t > 0) as o')} as g")
relation(
    "gex_strikes",
    """select symbol, max(spot) as spot, strike, round(sum(case when side = 'call' then g else 0 end), 2) + 0 as call_gex, round(sum(case when side = 'put' then -g else 0 end), 2) + 0 as put_gex, round(sum(case when side = 'call' then g else -g end), 2) + 0 as net_gex
    from (select symbol, side, strike, spot, gamma * oi * 100 * spot as g from gamma_quotes) as e group by symbol, strike""",
)
query("gex_by_strike", "select symbol, strike, call_gex, put_gex, net_gex from gex_strikes")
_first = lambda order: f"row_number() over (partition by symbol order by {order}, strike)"
# Strikes in order, each with its place among the symbol's and, near the spot, where exposure crosses zero since the strike before: all by symbol.
_NEAR = "partition by symbol, abs(strike - spot) / spot < 0.20 order by strike"
relation(
    "gex_points",
    f"""select *, prev_strike + (strike - prev_strike) * abs(prev_net) / (abs(prev_net) + abs(net_gex)) as flip, min(case when crosses then strike end) over (partition by symbol) as first_cross
    from (select *, near and prev_net * net_gex < 0 as crosses from (
      select symbol, strike, net_gex, abs(strike - spot) / spot < 0.20 as near, lag(strike) over ({_NEAR}) as prev_strike, lag(net_gex) over ({_NEAR}) as prev_net,
        {_first("call_gex desc")} as c, {_first("put_gex")} as p, {_first("abs(net_gex) desc")} as m from gex_strikes) as l) as n""",
)
relation(
    "gex_summary",
    """select symbol, round(sum(net_gex), 2) as total_gex, max(case when c = 1 then strike end) as call_wall, max(case when p = 1 then strike end) as put_wall, max(case when m = 1 then strike end) as max_gamma,
      round(max(case when crosses and strike = first_cross then flip end), 4) as gex_flip from gex_points group by symbol""",
)
query("gex_levels", "select symbol, total_gex, call_wall, put_wall, max_gamma from gex_summary")
query("gex_flip", "select symbol, gex_flip from gex_summary")
query("gex_profile", "select *, case when total_gex > 0 then 'positive' else 'negative' end as bias from gex_summary")
_by = lambda i: "case gex_strategy " + " ".join(f"when '{n}' then {v[i]}" for n, v in GEX_STRATEGIES.items()) + " end"
relation(
    "gex_choice",
    f"""select *, {_by(0)} as min_dte, {_by(1)} as max_dte, round({_by(2)}, 4) as min_strike, round({_by(3)}, 4) as max_strike from (
      select p.*, o.spot, o.regime_id, o.confs, case when gex_flip is not null and abs(o.spot - gex_flip) / o.spot < 0.02 and regime_id <= 2 then 'gamma_scalp' when bias = 'positive' and regime_id <= 1 then 'pin_play'
        when bias = 'positive' and regime_id <= 2 then 'controlled_drift' when bias = 'negative' and regime_id <= 1 then 'breakout_ride' when bias = 'negative' and regime_id <= 2 then 'trend_follow' end as gex_strategy
      from gex_profile p join option_symbols o on o.symbol = p.symbol) as c""",
)
query("gex_strategy", "select symbol, regime_id, bias, gex_strategy, min_dte, max_dte, min_strike, max_strike from gex_choice")


def bands(value: str, *steps: tuple[str, int], other: int = 0) -> str:
    """Points by the first condition that holds."""
    return "case " + " ".join(f"when {c.replace('@', value)} then {p}" for c, p in steps) + f" else {other} end"


_SPREAD = "case when bid > 0 and ask > 0 then (ask - bid) / mid * 100 end"
_default_dte = bands("dte", ("@ between 21 and 45", 25), ("@ between 14 and 60", 15), ("@ between 7 and 90", 5), ("@ between 0 and 7", 3), ("@ <= 365", 2), other=-5)
SWING_SCORE = " + ".join([
    f"case when regime_id <= 1 then {bands('delta', ('@ between 0.35 and 0.55', 30), ('@ between 0.25 and 0.65', 20), ('@ between 0.15 and 0.75', 10))} else {bands('delta', ('@ between 0.25 and 0.40', 30), ('@ between 0.15 and 0.50', 20), ('@ between 0.10 and 0.60', 10))} end",
    f"case when gex_strategy is null then {_default_dte} else {bands('dte', ('@ between min_dte and max_dte', 25), ('@ between min_dte - 7 and max_dte + 7', 15), ('@ >= 0', 3))} end",
    bands("", ("volume >= 100 and oi >= 500", 25), ("volume >= 50 and oi >= 100", 15), ("volume >= 10 and oi >= 50", 8), ("volume >= 1 or oi >= 10", 2), other=-15),
    f"case when bid > 0 and ask > 0 then {bands('spread', ('@ < 3', 15), ('@ < 5', 10), ('@ < 10', 5), other=-5)} else 0 end",
    bands("iv", ("@ between 0.15 and 0.40", 10), ("@ between 0.10 and 0.60", 5), ("@ > 0.80", -10)),
    bands("confs", ("@ >= 10", 15), ("@ >= 7", 10), ("@ >= 6", 5)),
    "case when mid < 0.03 * spot then 10 when mid < 0.10 * spot then 5 else 0 end",
    "case when gex_strategy is not null and strike between min_strike and max_strike then 20 else 0 end",
    "case when gex_strategy = 'pin_play' and call_wall > 0 then case when abs(strike - call_wall) / spot * 100 < 2 then 10 when abs(strike - call_wall) / spot * 100 < 5 then 5 else 0 end when gex_strategy = 'breakout_ride' and strike > spot then 5 when gex_strategy = 'gamma_scalp' and abs(strike - spot) / spot < 0.02 then 10 else 0 end",
    "case when gex_strategy is not null and bias = 'positive' and call_wall > 0 and strike > call_wall * 1.02 then -10 else 0 end",
])
relation("swing_quotes", f"select * from quotes where side = 'call' and dte between 0 and {SCORE_MAX_DTE}")
relation("swing_greeks", f"select * from {greeks('swing_quotes')} as g", greeks_once("swing_quotes", "delta"))
relation("swing_input", f"select q.*, c.regime_id, c.confs, c.bias, c.call_wall, c.gex_strategy, c.min_dte, c.max_dte, c.min_strike, c.max_strike, round({_SPREAD}, 6) as spread from swing_greeks q join gex_choice c on c.symbol = q.symbol")
query("option_score", f"select {_CONTRACT}, round(unrounded, 6) + 0 as delta, case when mid <= 0.01 or ask <= 0 then -999 else {SWING_SCORE} end as score from (select symbol, side, strike, dte, bid, ask, oi, volume, iv, mid, spot, delta as unrounded, round(delta, 6) as delta, regime_id, confs, bias, call_wall, gex_strategy, min_dte, max_dte, min_strike, max_strike, spread from swing_input) as q")
_ORDER = "score desc, dte, strike, bid, ask, oi, volume, iv"
query("options_topn", f"select * from (select *, row_number() over (partition by symbol order by {_ORDER}) as rank from option_score) as r where rank <= {TOP} and score > -999")
# Chains are of brands: each stands for one of the scanned symbols, so that a scan's regime can be looked up; a symbol that no scan has is neutral.
relation("underlyings", "select b.symbol, u.underlying from (select symbol, 1 + (row_number() over (order by symbol) - 1) % 7 as n from (select distinct symbol from chain) as c) as b left join (select symbol as underlying, row_number() over (order by symbol) as n from (select distinct symbol from bars) as s) as u on u.n = b.n")
query("options_regime_join", "select c.symbol, c.n, u.underlying, coalesce(s.regime_id, 3) as regime_id, coalesce(s.regime_label, 'Unknown') as regime_label, coalesce(s.confirmations_met, 0) as confirmations_met from (select symbol, count(*) as n from chain group by symbol) as c join underlyings u on u.symbol = c.symbol left join scan_v2 s on s.symbol = u.underlying")
query("options_for_watchlist", f"select t.symbol, t.strike, t.dte, t.score, t.rank, o.regime_id from options_topn t join option_symbols o on o.symbol = t.symbol where o.regime_id is not null and o.spot > 0 and t.rank <= 3")

_MONEY = "(spot - strike) / spot"
LEAPS_SCORE = " + ".join([
    bands("delta", ("@ between 0.65 and 0.80", 35), ("@ between 0.55 and 0.85", 25), ("@ between 0.45 and 0.90", 15), ("@ between 0.30 and 0.95", 5), other=-10),
    bands("dte", ("@ between 270 and 540", 30), ("@ between 180 and 730", 20), ("@ between 150 and 365", 10), other=-10),
    bands("iv", ("@ < 0.25", 20), ("@ < 0.35", 15), ("@ < 0.45", 10), ("@ < 0.60", 5), other=-5),
    bands("", ("volume >= 50 and oi >= 500", 20), ("volume >= 20 and oi >= 100", 12), ("volume >= 5 and oi >= 50", 6), ("oi >= 10", 2), other=-10),
    f"case when bid > 0 and ask > 0 then {bands('spread', ('@ < 3', 15), ('@ < 5', 10), ('@ < 8', 5), ('@ < 15', 0), other=-10)} else 0 end",
    bands("case when delta > 0 then abs(theta) / delta end", ("@ < 0.005", 10), ("@ < 0.01", 5)),
    bands(_MONEY, ("@ between 0.02 and 0.15", 10), ("@ between -0.03 and 0.02", 5)),
])
query("leaps_score", f"select * from (select {_CONTRACT}, case when mid <= 0.05 or ask <= 0 then -999 else {LEAPS_SCORE} end as score from (select symbol, side, strike, dte, bid, ask, oi, volume, iv, mid, spot, round(delta, 6) as delta, round(theta, 9) as theta, round({_SPREAD}, 6) as spread from greek_quotes where side = 'call' and dte between 180 and 730) as q) as s where score > 0")
query("leaps_topn", f"select *, count(*) over (partition by symbol) as shown from (select *, row_number() over (partition by symbol order by {_ORDER}) as rank, count(*) over (partition by symbol) as total_evaluated from leaps_score) as r where rank <= {TOP}")

# Sizing and rolls
# A share of the capital buys at least one contract; without a middle price none (LEAPS: nothing is said of it).
CAPITAL, RISK = 10_000, 0.10
_CONTRACTS = f"case when bid + ask > 0 then greatest(1, cast(floor({CAPITAL} * {RISK} / ((bid + ask) / 2 * 100)) as int)) end"


def sizing_sql(source: str, columns: str, without: str) -> str:
    return f"select {columns}, coalesce(n, {without}) as contracts, coalesce(round(n * (bid + ask) / 2 * 100, 4), {without}) as total_cost, coalesce(round(n * (bid + ask) / 2 * 100 / {CAPITAL} * 100, 4), {without}) as pct_of_capital from (select *, {_CONTRACTS} as n from {source}) as s"


query("contract_sizing", sizing_sql("options_topn", "symbol, strike, dte, rank", "0"))
query("leaps_sizing", sizing_sql("leaps_topn", "symbol, strike, dte, rank", "null"))
relation("positions", "select symbol, bar_ts, close as price, close_10 as entry, round(atr14, 6) as atr, cast(row_number() over (partition by symbol order by bar_ts) % 45 as int) as dte from conf_input where close_10 is not null and atr14 is not null")
query("roll_trigger", "select symbol, bar_ts, case when dte <= 7 then 'roll_out' when round(price - entry - atr, 6) >= 0 then 'roll_up' end as action from positions")
query("roll_simulate", "select symbol, bar_ts, ups + outs as roll_count, cast(round(ups * 0.5 + outs * 0.3, 4) as double) as total_credit_pct from (select *, case when dte <= 7 and ups < 3 then 1 else 0 end as outs from (select *, case when price > entry and atr > 0 then least(3, cast(floor(round((price - entry) / atr, 6)) as int)) else 0 end as ups from positions) as u) as o")
# Open option positions: the calls of orders that are still open, one a line item.
relation(
    "option_positions",
    """select l_orderkey as position_id, l_linenumber as leg, p_brand as symbol, cast(60 + p_partkey % 81 as double) as strike, cast((l_orderkey * 13 + l_linenumber) % 731 as int) as dte, round(cast(p_partkey % 500 as double) / 50 + 0.05, 2) as bid
    from lineitem join part on l_partkey = p_partkey join orders on o_orderkey = l_orderkey where o_orderstatus = 'O' and l_linestatus = 'O'""",
)
# The next later expiry than each one that is held: expiries and those held in one order by symbol, the smallest larger carried back.
relation(
    "next_expiries",
    """select symbol, dte, next_dte from (
      select symbol, dte, held, min(case when listed then dte end) over (partition by symbol order by dte range between 1 following and unbounded following) as next_dte
      from (select symbol, dte, bool_or(held) as held, bool_or(listed) as listed from (
        select symbol, dte, true as held, false as listed from option_positions union all select symbol, dte, false as held, true as listed from quotes where side = 'call') as u group by symbol, dte) as d) as n where held""",
)
relation("roll_quotes", "select symbol, side, strike, spot, dte, ask, sigma, cast(greatest(dte, 1) as double) / 365 as t from quotes where side = 'call'")
relation("roll_greeks", f"select * from {greeks('roll_quotes')} as g", greeks_once("roll_quotes", "delta"))
relation("roll_candidates", "select distinct symbol, dte, strike, ask, round(delta, 3) as delta from roll_greeks where round(delta, 9) between 0.70 and 0.80")
# Contracts by expiry, the credit falls as the ask rises, whatever the bid: one that isn't closer to the middle delta (or as close at a lower strike) than all that ask less never wins.
# So an expiry keeps a short list of those that can, and each date held meets the lists of its own expiry and of the next later one. Dates before -1 roll as -1 does. A NaN counts as the largest credit.
_ROLL_LISTS = """
    with calls as (
      select distinct symbol, dte, case when deep then ask end as ask, case when deep then strike end as strike, case when deep then round(delta, 3) end as delta
      from (select *, coalesce(round(delta, 9) between 0.70 and 0.80 and ask is not null, false) as deep from {calls}) as q),
    nearer as (
      select *, min(case when ask is not null then struct(gap, strike) end) over (partition by symbol, dte order by ask is null, not isnan(ask), ask, gap, strike, delta rows between unbounded preceding and 1 preceding) as nearest
      from (select *, abs(delta - 0.75) as gap from calls) as g),
    listed as (
      select symbol, dte, collect_list(case when ask is not null and (nearest is null or struct(gap, strike) < nearest) then struct(ask, gap, strike, delta) end) as choices from nearer group by symbol, dte),
    dates as (select *, coalesce(lag(dte) over (partition by symbol order by dte), -1) as before from listed)
    select symbol, dte, choices, inline(array_append(transform(sequence(before, dte - 1), d -> struct(d as held, 'roll_out' as roll_type)), struct(dte as held, 'roll_up' as roll_type))) from dates where size(choices) > 0"""
_ROLLS = """
    select position_id, leg, symbol, roll_type, strike, dte, delta, credit from (
      select *, row_number() over (partition by position_id, leg, roll_type order by credit desc, gap, strike, ask, delta, symbol) as rn from (
        select position_id, leg, symbol, roll_type, dte, best.credit, -best.gap as gap, -best.strike as strike, -best.ask as ask, best.delta from (
          select p.position_id, p.leg, p.symbol, t.roll_type, t.dte, array_max(transform(filter(t.choices, c -> p.bid - c.ask > 0), c -> struct(round(p.bid - c.ask, 2) as credit, -c.gap as gap, -c.strike as strike, -c.ask as ask, c.delta as delta))) as best
          from {positions} p join {lists} t on t.symbol = p.symbol and t.held = case when p.dte < -1 then -1 else p.dte end) as b where best is not null) as c) as r where rn = 1"""


def roll_targets(use):
    """Every leg's best rolls, each position read once: it meets two short lists instead of all contracts of two expiries."""
    calls = use("roll_greeks")
    lists = calls.sparkSession.sql(_ROLL_LISTS, calls=calls)
    return calls.sparkSession.sql(_ROLLS, positions=use("option_positions"), lists=lists)


query(
    "roll_target",
    """select position_id, leg, symbol, roll_type, strike, dte, delta, credit from (
      select *, row_number() over (partition by position_id, leg, roll_type order by credit desc, abs(delta - 0.75), strike, ask) as rn from (
        select p.position_id, p.leg, p.symbol, p.roll_type, c.strike, c.dte, c.delta, c.ask, round(p.bid - c.ask, 2) as credit
        from (select p.*, 'roll_up' as roll_type, dte as target from option_positions p union all select p.*, 'roll_out' as roll_type, n.next_dte as target from option_positions p join next_expiries n on n.symbol = p.symbol and n.dte = p.dte) as p
        join roll_candidates c on c.symbol = p.symbol and c.dte = p.target where p.bid - c.ask > 0) as t) as r where rn = 1""",
    roll_targets,
    around=("quotes", "roll_quotes", "roll_greeks", "roll_candidates", "next_expiries"),
)
query(
    "position_sizing",
    """select symbol, tier, multiplier, round(risk, 4) as risk_dollars, round(stop, 4) as stop_distance, greatest(1, cast(floor(risk / stop) as int)) as shares,
      case when option_mid > 0 then greatest(1, cast(floor(least(risk, buying_power) / (option_mid * 100)) as int)) else 0 end as contracts
    from (select *, 10000 * multiplier as risk, case when atr > 0 then 2 * atr else close * 0.05 end as stop, round(close * 0.04, 2) as option_mid, cast(4000 as double) as buying_power
      from (select *, case tier when 'FULL' then 1.0 when 'HIGH' then 0.75 when 'MED' then 0.5 else 0.25 end as multiplier
        from (select s.symbol, s.close, round(i.atr14, 6) as atr, case when s.regime_confidence > 0.80 and s.confs / 12.0 >= 0.83 then 'FULL' when s.regime_confidence > 0.70 and s.confs / 12.0 >= 0.67 then 'HIGH' when s.regime_confidence > 0.60 and s.confs / 12.0 >= 0.50 then 'MED' else 'MIN' end as tier
          from signal_v2 s join ind i on i.symbol = s.symbol and i.bar_ts = s.bar_ts) as t) as m) as r""",
)
query("position_size", "select symbol, tier, risk_dollars, shares from position_sizing")
relation("steps", "select step from (values " + ", ".join(f"({i})" for i in range(LADDER_STEPS)) + ") as v(step)")
# Prices of the attempts, whatever the other side quotes: options from the bid + a step and from the ask; shares from a step inside on either side, the sale never below a cent.
query("ladder_schedule", "select symbol, strike, dte, rank, cast(step as int) as step, round(bid + (step + 1) * 0.05, 2) as buy_limit, round(ask - step * 0.05, 2) as sell_limit from options_topn cross join steps where rank = 1")
relation("share_quotes", "select symbol, round(close * 0.999, 2) as bid, round(close * 1.001, 2) as ask from latest_bar")
query("ladder_shares", "select symbol, cast(step as int) as step, round(bid + (step + 1) * 0.10, 2) as buy_limit, case when round(ask - (step + 1) * 0.10, 2) <= 0 then 0.01 else round(ask - (step + 1) * 0.10, 2) end as sell_limit from share_quotes cross join steps where step < 15")
