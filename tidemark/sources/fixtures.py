"""Bars, regimes and option chains made from the given tables, in SQL both engines take."""

from __future__ import annotations

from tidemark.functions.indicators import indicators, indicators_sql
from tidemark.plans.catalog import relation

#: The seven regime labels, by rank of mean return (fixed values).
REGIMES = ("Bull Run", "Bull Trend", "Mild Bull", "Neutral / Chop", "Mild Bear", "Bear Trend", "Crash / Capitulation")

_WALK = """
select symbol, bar_ts, cast(oi as double) / 10000 as open, floor(cast(greatest(oi, ci) * (10000 + wig) as double) / 10000) / 10000 as high,
  floor(cast(least(oi, ci) * (10000 - wig) as double) / 10000) / 10000 as low, cast(ci as double) / 10000 as close, volume, wig
from (
  select symbol, bar_ts, wig, volume, cast(round(1000000 * exp(cast(cum as double) / 5000)) as bigint) as ci, cast(round(1000000 * exp(cast(cum - step as double) / 5000)) as bigint) as oi
  from (
    select symbol, bar_ts, step, wig, volume, cast(sum(step) over (partition by symbol order by bar_ts) as bigint) as cum
    from (
      select {key} as symbol, o_orderdate as bar_ts, cast(sum(o_orderkey * 7919 + c_custkey * 31) % 401 - 200 as bigint) as step,
        cast(sum(o_orderkey * 104729) % 100 as bigint) as wig, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as volume
      from orders join customer on o_custkey = c_custkey where o_orderdate is not null group by {key}, o_orderdate) as days) as walked) as whole
"""
WALK = _WALK.replace("{key}", "c_mktsegment")

relation("bars", f"select symbol, bar_ts, open, high, low, close, volume from ({WALK}) as w")
relation("bars_nation", f"select symbol, bar_ts, open, high, low, close, volume from ({_WALK.replace('{key}', 'c_nationkey')}) as w")
relation("wigs", f"select symbol, bar_ts, wig from ({WALK}) as w")
relation(
    "index_bars",
    """select bar_ts, 10 + 35 * (close - lo) / (case when hi = lo then 1 else hi - lo end) as close
    from (select bar_ts, close, min(close) over () as lo, max(close) over () as hi, row_number() over (order by bar_ts) as rn from bars where symbol = 'BUILDING') as b where rn % 3 = 0""",
)
relation(
    "bars_dirty",
    """select symbol, bar_ts, case when rn % 11 = 0 then null else open end as open, high, low, case when rn % 13 = 0 then null else close end as close, case when rn % 7 = 0 then 0 else volume end as volume
    from (select *, row_number() over (partition by symbol order by bar_ts) as rn from bars) as b""",
)
relation(
    "bars_hourly",
    """select event_type as symbol, date_trunc('hour', ts) as bar_ts, min_by(value, ts) as open, max(value) as high, min(value) as low, max_by(value, ts) as close, count(*) as volume
    from events group by event_type, date_trunc('hour', ts)""",
)
relation(
    "regimes",
    f"""select b.symbol, b.bar_ts, b.open, b.high, b.low, b.close, b.volume, cast(bucket - 1 as int) as regime_id,
      case bucket {" ".join(f"when {i + 1} then '{name}'" for i, name in enumerate(REGIMES))} end as regime_label, 0.5 + cast(wig % 50 as double) / 100 as regime_confidence
    from (
      select *, ntile(7) over (partition by symbol order by trend desc, bar_ts) as bucket
      from (
        select *, case when n >= 20 then round(avg(ret) over (partition by symbol order by bar_ts rows between 19 preceding and current row), 9) else 0 end as trend
        from (select *, ln(close / lag(close) over (partition by symbol order by bar_ts)) as ret, row_number() over (partition by symbol order by bar_ts) as n from bars) as r) as t) as b
    join wigs w on w.symbol = b.symbol and w.bar_ts = b.bar_ts""",
)
relation("ind", indicators_sql(), lambda use: indicators(use("bars")))
relation(
    "chain",
    """select p_brand as symbol, case when l_linestatus = 'O' then 'call' else 'put' end as side, cast(60 + p_partkey % 81 as double) as strike, cast((l_orderkey * 13 + l_linenumber) % 731 as int) as dte,
      cast(l_quantity as bigint) * 20 as oi, cast(l_orderkey % 150 as bigint) as volume, round(0.10 + l_discount * 5 + l_tax, 4) as iv,
      round(cast(p_partkey % 500 as double) / 50 + 0.05, 2) as bid, round(cast(p_partkey % 500 as double) / 50 + 0.05, 2) + round(l_discount * 2, 2) as ask,
      round(cast(p_partkey % 500 as double) / 50 + 0.05, 2) as last, cast(100 as double) as spot
    from lineitem join part on l_partkey = p_partkey""",
)
