"""Scans of a universe: prescreening, records, ranking, filters, summaries and alerts."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.strategies import AROUND, DEFAULTS
from tidemark.operators.windows import frame
from tidemark.plans.catalog import query, relation

# Fixed values.
EXCLUDED_SECTORS = ("Healthcare", "Health Technology")
EXCLUDED_INDUSTRIES = ("biotechnology", "pharmaceutical", "pharma", "drug", "biotech")
SIGNAL_PRIORITY = {
    "LONG -- ENTER": 0, "LEAPS -- BUY": 0, "BOTTOM -- BUY": 0, "EXIT -- REGIME FLIP": 1, "LEAPS -- EXIT": 1, "LONG -- CONFIRMING": 2, "LEAPS -- WATCH": 2, "BOTTOM -- WATCH": 2,
    "LONG -- HOLD": 3, "LEAPS -- HOLD": 3, "CASH -- NEUTRAL": 4, "LEAPS -- WAIT": 4, "BOTTOM -- WAIT": 4, "CASH -- BEARISH": 5, "LEAPS -- AVOID": 5, "BOTTOM -- AVOID": 5, "BOTTOM -- N/A": 6, "ERROR": 99,
}
BULLISH = ("LONG -- ENTER", "LONG -- CONFIRMING", "LONG -- HOLD", "LEAPS -- BUY", "LEAPS -- WATCH", "LEAPS -- HOLD")
BULLISH_CLIENT = (*BULLISH, "BOTTOM -- BUY", "BOTTOM -- WATCH")
WATCHLISTS = {"segments": ("BUILDING", "MACHINERY", "HOUSEHOLD"), "consumer": ("AUTOMOBILE", "FURNITURE", "HOUSEHOLD")}

_quoted = lambda values: ", ".join(f"'{v}'" for v in values)
_priority = "case signal " + " ".join(f"when '{s}' then {p}" for s, p in SIGNAL_PRIORITY.items()) + " else 50 end"

relation(
    "last_stats",
    """select * from (select symbol, bar_ts, close, count(*) over (partition by symbol) as n_bars, avg(cast(volume as double)) over (partition by symbol order by bar_ts rows between 29 preceding and current row) as vol_30,
      lag(close) over (partition by symbol order by bar_ts) as close_1, lag(close, 5) over (partition by symbol order by bar_ts) as close_5, lag(close, 20) over (partition by symbol order by bar_ts) as close_20,
      row_number() over (partition by symbol order by bar_ts desc) as back from bars) as l where back = 1""",
)
query(
    "latest_screen",
    """select symbol, bar_ts, close, hv20, row_number() over (order by hv20 desc, symbol) as rank from (
      select b.symbol, b.bar_ts, b.close, b.close - b.close_10 as momentum, b.volume, b.vol_20, h.hv20, row_number() over (partition by b.symbol order by b.bar_ts desc) as back
      from (select symbol, bar_ts, close, volume, lag(close, 10) over (partition by symbol order by bar_ts) as close_10, avg(cast(volume as double)) over (partition by symbol order by bar_ts rows between 19 preceding and current row) as vol_20 from bars) as b
      join hist_vol h on h.symbol = b.symbol and h.bar_ts = b.bar_ts) as l where back <= 5 and momentum > 0 and volume > vol_20""",
)
query("prescreen", "select symbol, close, round(vol_30, 2) as avg_volume_30, n_bars from last_stats where close >= 1.0 and vol_30 >= 500000 and n_bars >= 100")
query("scan_change_stats", "select symbol, round((close / close_1 - 1) * 100, 4) as change_1, round((close / close_5 - 1) * 100, 4) as change_5, round((close / close_20 - 1) * 100, 4) as change_20, round(vol_30, 2) as avg_volume_30 from last_stats")
# Sector, industry and options of a symbol: from nations, as the test tables have no tickers.
relation("ticker_info", "select n_name as symbol, n_name as name, case when n_nationkey % 6 = 0 then 'Healthcare' when n_nationkey % 7 = 0 then null else 'Technology' end as sector, case when n_nationkey % 5 = 0 then 'Specialty Pharma' when n_nationkey % 4 = 0 then null else 'Software' end as industry, case when n_nationkey % 3 = 0 then null else n_nationkey % 2 = 0 end as has_options from nation")
query("sector_exclusion", f"select symbol, sector, industry from ticker_info where coalesce(sector, '') not in ({_quoted(EXCLUDED_SECTORS)}) and not ({' or '.join(f'''coalesce(lower(industry), '') like '%{k}%' ''' for k in EXCLUDED_INDUSTRIES)})")
query("ticker_info_join", "select b.symbol, b.bars, coalesce(t.has_options, true) as has_options, coalesce(t.sector, 'Unknown') as sector from (select n.n_name as symbol, count(*) as bars from bars_nation b join nation n on n.n_nationkey = b.symbol group by n.n_name) as b left join ticker_info t on t.symbol = b.symbol")

#: What the texts of the scans read and ``scans`` goes around.
_AROUND = (*AROUND, *(f"signal_{n}" for n in DEFAULTS), "last_stats")


def scans(use) -> DataFrame:
    """All strategies' scans from ``signal_table``: symbols at 1 or more with 500,000 a bar over 30 bars and 100 bars."""
    passing = use("signal_table").where("last_close >= 1.0 and vol_30 >= 500000 and n_bars >= 100")
    return passing.selectExpr(
        "strategy", "symbol", "signal", "regime_id", "regime_label", "round(regime_confidence, 4) as regime_confidence", "streak", "confs as confirmations_met", "round(close, 4) as price",
        "round((last_close / close_1 - 1) * 100, 4) as change_1d", "round(vol_30, 2) as avg_volume_30",
    )


def strategy_scan(strategy: str, use) -> DataFrame:
    return use("scans").where(F.col("strategy") == strategy).drop("strategy")


for _name in DEFAULTS:
    query(
        f"scan_{_name}",
        f"""select s.symbol, s.signal, s.regime_id, s.regime_label, round(s.regime_confidence, 4) as regime_confidence, s.streak, s.confs as confirmations_met, round(s.close, 4) as price, round((l.close / l.close_1 - 1) * 100, 4) as change_1d,
          round(l.vol_30, 2) as avg_volume_30 from signal_{_name} s join last_stats l on l.symbol = s.symbol where l.close >= 1.0 and l.vol_30 >= 500000 and l.n_bars >= 100""",
        partial(strategy_scan, _name),
        around=_AROUND,
    )
relation("scans", " union all ".join(f"select '{n}' as strategy, s.* from scan_{n} s" for n in DEFAULTS), scans, around=(*_AROUND, *(f"scan_{n}" for n in DEFAULTS)))
query("scan_ranked", f"select strategy, symbol, signal, confirmations_met, row_number() over (partition by strategy order by {_priority}, confirmations_met desc, symbol) as rank from scans")
query("screen_sorted", f"select strategy, symbol, row_number() over (order by {_priority}, confirmations_met desc, strategy, symbol) as by_signal, row_number() over (order by regime_confidence desc, strategy, symbol) as by_confidence, row_number() over (order by confirmations_met desc, strategy, symbol) as by_confirmations, row_number() over (order by coalesce(change_1d, 0) desc, strategy, symbol) as by_change from scans")
query("strategy_defaults", "select s.strategy, s.symbol, d.min_confirmations, d.regime_confirm_bars, d.cooldown_bars, d.min_dte, d.max_dte, d.price_above_ema50, s.avg_volume_30 >= d.min_avg_volume as enough_volume from scans s join default_settings d on d.strategy = s.strategy")
query("scan_bullish_only", f"select strategy, symbol, signal from scans where signal in ({_quoted(BULLISH)})")
query("scan_hits_client", f"select strategy, symbol, signal from scans where signal in ({_quoted(BULLISH_CLIENT)})")
query("leaps_hits", "select symbol, signal, confirmations_met, row_number() over (order by confirmations_met desc, symbol) as rank from scan_leaps where signal like 'LEAPS -- %' and (signal like '%BUY%' or signal like '%WATCH%' or signal like '%HOLD%')")
query("scan_summary", "select strategy, count_if(regime_id <= 2) as bullish, count_if(regime_id >= 5) as bearish, count_if(regime_id between 3 and 4) as neutral, count_if(signal like '%ENTER%') as entries, count_if(signal like '%EXIT%') as exits, count_if(signal = 'ERROR') as errors from scans group by strategy")
query("signal_counts", "select coalesce(signal, 'UNKNOWN') as signal, count(*) as n from scans group by coalesce(signal, 'UNKNOWN')")
query("confirmation_counts", "select name, count_if(passed) as passed, count_if(not passed) as failed from confirmation_detail group by name")
query("confirmation_rates", "select name, round(100.0 * cast(passed as double) / (passed + failed), 4) as hit_rate, row_number() over (order by cast(passed as double) / (passed + failed) desc, name) as rank from confirmation_counts")
# What goes out: fields whose names begin with an underscore stay behind, and lists of one value become the value.
relation("raw_results", "select symbol, signal, price as _price, confirmations_met as _confirmations, price, confirmations_met from scan_v1")
query("results_pruned", "select symbol, signal, price, confirmations_met from raw_results", lambda use: pruned(use("raw_results").withColumns(_boxes())))
query("results_projection", "select symbol, signal, regime_label, regime_confidence, confirmations_met, price, change_1d, avg_volume_30 from scan_v2")
# A scheduled run looks at each day's last bars: the same filter for every run of the history.
query("scheduled_hits", "select r.bar_ts, r.symbol, c.confirmations_met, row_number() over (partition by r.bar_ts order by c.confirmations_met desc, r.symbol) as rank from regimes r join conf_v1 c on c.symbol = r.symbol and c.bar_ts = r.bar_ts left join ticker_info t on t.symbol = r.symbol where r.regime_label = 'Bull Run' and r.regime_confidence >= 0.80 and c.confirmations_met >= 6 and coalesce(t.has_options, true)")


def filter_sql(source: str, signal: str | None = None, regime: str | None = None, confidence: float = 0, min_price: float = 0, max_price: float = 0, min_volume: float = 0, ema10_above_20: bool = False, above_ema50: bool = False) -> str:
    """Every filter that is switched on must hold; what is null counts as 0, or as not so."""
    tests = [
        signal and f"coalesce(signal, '') = '{signal}'", regime and f"coalesce(regime_label, '') = '{regime}'", confidence > 0 and f"coalesce(regime_confidence, 0) >= {confidence}",
        min_price > 0 and f"coalesce(price, 0) >= {min_price}", max_price > 0 and f"coalesce(price, 0) <= {max_price}", min_volume > 0 and f"coalesce(avg_volume_30, 0) >= {min_volume}",
        ema10_above_20 and "coalesce(ema10 > ema20, false)", above_ema50 and "coalesce(price > ema50, false)",
    ]
    return f"select * from {source} where {' and '.join(t for t in tests if t) or 'true'}"


relation("last_emas", "select symbol, ema10, ema20, ema50 from (select symbol, ema10, ema20, ema50, row_number() over (partition by symbol order by bar_ts desc) as back from ind) as i where back = 1")
relation("screen_rows", "select s.strategy, s.symbol, s.signal, s.regime_label, s.regime_confidence, s.price, s.avg_volume_30, round(e.ema10, 6) as ema10, round(e.ema20, 6) as ema20, round(e.ema50, 6) as ema50 from scans s left join last_emas e on e.symbol = s.symbol")
query("screen_filters", filter_sql("screen_rows", confidence=0.5, min_price=1, max_price=1000, min_volume=500_000, above_ema50=True))
query("screen_filters_trend", filter_sql("screen_rows", ema10_above_20=True, above_ema50=True))
query("screen_filters_signal", filter_sql("screen_rows", signal="CASH -- NEUTRAL", confidence=0.5))
# Symbols that a scan can't judge: no bars, or too few.
query("scan_errors", "select u.symbol, case when b.n is null then 'No data' else 'Insufficient history' end as error from (select symbol from universe_tradeable union select symbol from bars) as u left join (select symbol, count(*) as n from bars group by symbol) as b on b.symbol = u.symbol where coalesce(b.n, 0) < 100")
query("ranked_hits", "select symbol, confirmations_met, row_number() over (order by confirmations_met desc, symbol) as rank from scan_v2")
query("report_top25", "select rank, symbol, confirmations_met, case when rank = 25 then greatest(total - 25, 0) end as more from (select r.*, count(*) over () as total from (select symbol, confirmations_met, row_number() over (order by confirmations_met desc, symbol) as rank from scan_v1) as r) as t where rank <= 25")
query("ticker_csv", "select strategy, string_agg(symbol, ', ' order by symbol) as tickers from scans group by strategy", lambda use: use("scans").groupBy("strategy").agg(_csv()))
query("regime_heatmap", "select symbol, " + ", ".join(f"count_if(regime_id = {i}) as regime_{i}" for i in range(7)) + " from regimes group by symbol")
query("regime_stats", f"select symbol, regime_id, round(avg(ret), 6) as mean_return, round(stddev_samp(ret), 6) as volatility, round(avg(rng), 6) as mean_range, round(avg(vol), 6) as mean_volume_change, count(*) as n, round(100.0 * cast(count(*) as double) / max(total), 6) as pct_of_total from (select symbol, regime_id, ln(close / lag(close) over (partition by symbol order by bar_ts)) as ret, (high - low) / close as rng, ln((cast(volume as double) + 1) / (avg(cast(volume as double)) {frame(20)} + 1)) as vol, count(*) over (partition by symbol) as total from regimes) as r group by symbol, regime_id")
query("regime_rank", "select symbol, regime_id, row_number() over (partition by symbol order by coalesce(mean_return, 0) desc, regime_id) - 1 as rank from regime_stats")
query("transition_empirical", "select symbol, from_id, to_id, round(cast(n as double) / sum(n) over (partition by symbol, from_id), 6) as prob from (select symbol, regime_id as from_id, next_id as to_id, count(*) as n from (select symbol, regime_id, lead(regime_id) over (partition by symbol order by bar_ts) as next_id from regimes) as t where next_id is not null group by symbol, regime_id, next_id) as c")
query("index_snapshot", "select bar_ts, round(close, 4) as level, round(close - prev, 4) as change, round((close / prev - 1) * 100, 4) as change_pct from (select *, lag(close) over (order by bar_ts) as prev, row_number() over (order by bar_ts desc) as back from index_bars) as i where back = 1")
query("index_series", "select bar_ts, round(close, 6) as level from index_bars")
query("chart_payload", "select symbol, list(cast(bar_ts as string) order by bar_ts) as dates, list(round(close, 4) order by bar_ts) as closes, list(regime_id order by bar_ts) as regime_ids from regimes group by symbol", lambda use: _payload(use("regimes")))

# Two sessions of a day, and the run before: from the scans, with some symbols changed.
relation("am_snapshot", "select strategy, symbol, case when symbol = 'BUILDING' then 0 else 1 end as same_day from scans where symbol <> 'MACHINERY'")
query("snapshot_same_day", "select strategy, symbol from am_snapshot where same_day = 1")
query("pm_confirmed", "select s.strategy, s.symbol, a.symbol is not null as confirmed from scans s left join snapshot_same_day a on a.strategy = s.strategy and a.symbol = s.symbol")
query("pm_confirmed_intersect", "select symbol from scans intersect select symbol from snapshot_same_day")
relation("scan_prev", "select symbol, cast((regime_id + case when symbol in ('BUILDING', 'FURNITURE') then 3 else 0 end) % 7 as int) as regime_id from scan_v1 where symbol <> 'AUTOMOBILE'")
query("regime_changes", "select c.symbol, p.regime_id as prev_regime_id, c.regime_id, c.price from scan_v1 c join scan_prev p on p.symbol = c.symbol where p.regime_id <> c.regime_id")


def alert_sql(source: str, min_confirmations: int = 6, bull_entry: bool = True, bear_entry: bool = True, any_change: bool = True) -> str:
    """Changes with enough confirmations that one of the switched-on kinds covers."""
    kinds = [k for k, on in (("regime_id <= 2", bull_entry), ("regime_id >= 4", bear_entry), ("true", any_change)) if on]
    return f"select * from {source} where confirmations_met >= {min_confirmations} and ({' or '.join(kinds) or 'false'})"


# Changes from one run to the next, for every run of the history.
relation("run_changes", "select c.symbol, c.bar_ts, c.prev_regime_id, c.regime_id, f.confirmations_met from (select symbol, bar_ts, regime_id, lag(regime_id) over (partition by symbol order by bar_ts) as prev_regime_id from regimes) as c join conf_v1 f on f.symbol = c.symbol and f.bar_ts = c.bar_ts where c.prev_regime_id <> c.regime_id")
query("alert_filter", alert_sql("run_changes"))
query("alert_filter_entries", alert_sql("run_changes", any_change=False))
query("alert_filter_bull", alert_sql("run_changes", min_confirmations=3, bear_entry=False, any_change=False))
relation("watchlist_rows", " union all ".join(f"select '{n}' as name, '{s}' as symbol" for n, members in WATCHLISTS.items() for s in members))
query("watchlist_members", "select w.name, w.symbol, b.bars from watchlist_rows w join (select symbol, count(*) as bars from bars group by symbol) as b on b.symbol = w.symbol")
query("universe_union", "select symbol from watchlist_rows union select symbol from bars")
# Lists as users type them: names between commas, in any case, some of them empty.
relation("ticker_lists", "select n_nationkey as list_id, ' ' || lower(n_name) || ' ,, x' || cast(n_nationkey as string) || ' ,' as tickers from nation")
query(
    "ticker_list_parse",
    "select list_id, trim(upper(name)) as symbol from ticker_lists, unnest(string_split(tickers, ',')) as u(name) where trim(name) <> ''",
    lambda use: use("ticker_lists").selectExpr("list_id", "explode(split(tickers, ',')) as name").where("trim(name) <> ''").selectExpr("list_id", "trim(upper(name)) as symbol"),
)
query("symbol_resolve", "select c_custkey, case upper(trim(c_mktsegment)) " + " ".join(f"when '{k}' then '{v}'" for k, v in {"BTC": "BTC-USD", "BITCOIN": "BTC-USD", "ETH": "ETH-USD", "ETHEREUM": "ETH-USD", "SOL": "SOL-USD", "SOLANA": "SOL-USD", "AVAX": "AVAX-USD", "AVALANCHE": "AVAX-USD", "BUILDING": "BLDG"}.items()) + " else upper(trim(c_mktsegment)) end as symbol from customer")


def _boxes():
    return {c: F.array(c) for c in ("price", "confirmations_met")}


def pruned(results):
    """The columns without an underscore before their name; an array column gives its first value."""
    kinds = dict(results.dtypes)
    return results.select(*(F.get(c, F.lit(0)).alias(c) if kinds[c].startswith("array") else F.col(c) for c in results.columns if not c.startswith("_")))


def _csv():
    return F.array_join(F.array_sort(F.collect_list("symbol")), ", ").alias("tickers")


def _payload(regimes):
    rows = regimes.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("bar_ts", F.round("close", 4).alias("close"), "regime_id"))).alias("r"))
    return rows.select("symbol", F.transform("r.bar_ts", lambda t: t.cast("string")).alias("dates"), F.col("r.close").alias("closes"), F.col("r.regime_id").alias("regime_ids"))
