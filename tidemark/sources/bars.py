"""Bar sources: several providers' shapes, cleaning, and symbol directories.

The test tables hold no provider payloads; JSON and directory lines are derived
from them by Spark, and parsed back by the readers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.screening import _quoted
from tidemark.plans.catalog import query, relation

PRICES = ("open", "high", "low", "close")
BAR_JSON = "array<struct<date:string,open:string,high:string,low:string,close:string,volume:string>>"


def standardize(raw: DataFrame) -> DataFrame:
    """Columns by their names in any case; close falls back to adjusted close; a missing column is an error.

    Of columns whose names agree the first counts.
    """
    by_name = {}
    for i, c in enumerate(raw.columns):
        by_name.setdefault(c.lower().replace(" ", "_"), f"c{i}")
    close = [F.col(by_name[c]) for c in ("close", "adj_close") if c in by_name]
    missing = {"open", "high", "low", "volume"} - by_name.keys()
    if missing or not close:
        raise ValueError(f"no column for {sorted(missing) or 'close'}")
    keys = [F.col(by_name[c]).alias(c) for c in ("symbol", "bar_ts") if c in by_name]
    numbered = raw.toDF(*(f"c{i}" for i in range(len(raw.columns))))  # names that differ in case alone can't be told apart
    return numbered.select(*keys, *(F.col(by_name[c]).alias(c) for c in ("open", "high", "low")), F.coalesce(*close).alias("close"), F.col(by_name["volume"]).alias("volume"))


def from_json_list(payloads: DataFrame) -> DataFrame:
    """Bars from (symbol, payload): a JSON list of bars, or one bar alone; numbers may be strings, bad ones drop their row."""
    listed = F.when(F.trim("payload").startswith("{"), F.concat(F.lit("["), "payload", F.lit("]"))).otherwise(F.col("payload"))
    rows = payloads.select("symbol", F.explode(F.from_json(listed, BAR_JSON)).alias("b"))
    return rows.select("symbol", F.to_timestamp_ntz("b.date").alias("bar_ts"), *(F.expr(f"try_cast(b.{c} as double)").alias(c) for c in PRICES), F.expr("try_cast(b.volume as bigint)").alias("volume")).dropna()


def from_json_map(payloads: DataFrame, start: str, end: str) -> DataFrame:
    """Bars from a JSON map of dates to numbered fields, within a range of dates, both ends included."""
    schema = "map<string,struct<`1. open`:string,`2. high`:string,`3. low`:string,`4. close`:string,`5. volume`:string>>"
    rows = payloads.select("symbol", F.explode(F.from_json("payload", schema)).alias("date", "b")).where(F.col("date").between(start, end))
    names = ("1. open", "2. high", "3. low", "4. close")
    return rows.select("symbol", F.to_timestamp_ntz("date").alias("bar_ts"), *(F.expr(f"try_cast(b.`{n}` as double)").alias(c) for n, c in zip(names, PRICES, strict=True)), F.expr("try_cast(b.`5. volume` as bigint)").alias("volume")).dropna()


def _providers(use) -> DataFrame:
    """Lists whose numbers are strings, some of them bad, and single bars that come without a list."""
    text = _as_text(use("bars")).withColumn("low", F.when(F.col("volume").cast("long") % 10 == 0, F.lit("n/a")).otherwise(F.col("low")))
    alone = F.to_json(F.struct("date", *PRICES, "volume"))
    single = text.where(F.col("symbol") == "BUILDING").select("symbol", alone.alias("payload"))
    listed = text.where(F.col("symbol") != "BUILDING").groupBy("symbol").agg(F.to_json(F.collect_list(F.from_json(alone, BAR_JSON[6:-1]))).alias("payload"))
    return from_json_list(single.unionByName(listed))


def _as_text(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", F.date_format("bar_ts", "yyyy-MM-dd HH:mm:ss").alias("date"), *(F.col(c).cast("string").alias(c) for c in (*PRICES, "volume")))


def _json_list(use) -> DataFrame:
    text = _as_text(use("bars"))
    fields = F.to_json(F.struct("date", *PRICES, "volume"))
    return from_json_list(text.groupBy("symbol").agg(F.to_json(F.collect_list(F.from_json(fields, BAR_JSON[6:-1]))).alias("payload")))


def _json_map(use) -> DataFrame:
    text = _as_text(use("bars"))
    entry = F.struct(*(F.col(c).alias(f"{i}. {c}") for i, c in enumerate((*PRICES, "volume"), 1)))
    return from_json_map(text.groupBy("symbol").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("date", entry)))).alias("payload")), "1995-01-01", "1996-12-31 23:59:59")


_BAR = "symbol, bar_ts, open, high, low, close, volume"
query("bars_walk", f"select {_BAR} from bars")
query("bars_clean", f"select {_BAR} from bars_dirty where open is not null and high is not null and low is not null and close is not null and volume > 0")
query("bars_from_json", f"select {_BAR} from bars", _json_list)
query("bars_from_strings", f"select {_BAR} from bars where volume % 10 <> 0", _providers)
query("bars_from_nested_map", f"select {_BAR} from bars where bar_ts between timestamp '1995-01-01 00:00:00' and timestamp '1996-12-31 23:59:59'", _json_map)
query("bars_standardize", f"select symbol, bar_ts, open, high, low, coalesce(close, high) as close, volume from bars_dirty where open is not null", lambda use: standardize(use("bars_dirty").where("open is not null").withColumnRenamed("close", "Close").withColumnRenamed("open", "OPEN").withColumn("Adj Close", F.col("high"))))
# The first provider that has rows for a symbol wins.
relation("provider_rows", f"select 1 as priority, {_BAR} from bars_clean where symbol in ('BUILDING', 'MACHINERY') union all select 2 as priority, {_BAR} from bars where symbol <> 'BUILDING'")
query("bars_source_fallback", f"select priority, {_BAR} from (select *, min(priority) over (partition by symbol) as best from provider_rows) as p where priority = best")
query("bars_range_clamp", f"select {_BAR} from bars cross join (select max(bar_ts) as last_ts from bars) as l where bar_ts between last_ts - interval '729' day and last_ts")
query("bars_nan_to_null", "select symbol, bar_ts, case when isnan(level) then null else round(level, 6) end as level from (select symbol, bar_ts, case when volume = 0 then cast('NaN' as double) else high end as level from bars_dirty) as n")
query("bars_from_events", "select symbol, bar_ts, round(open, 6) as open, round(high, 6) as high, round(low, 6) as low, round(close, 6) as close, volume from bars_hourly")

# Symbol directories: lines from the suppliers and parts.
relation("lines_primary", """select 'Symbol|Security Name|Market Category|Test Issue|Financial Status|Round Lot|ETF|NextShares' as line from region where r_regionkey = 0
  union all select 'File Creation Time: 0101|||||||' as line from region where r_regionkey = 0 union all select 'SHORT|LINE' as line from region where r_regionkey = 1
  union all select 'S' || cast(s_suppkey as string) || '|' || s_name || case when s_suppkey % 9 = 0 then ' Warrant' else ' Common Stock' end || '|Q|' || case when s_suppkey % 10 = 0 then 'Y' else 'N' end || '|' || case when s_suppkey % 8 = 0 then 'D' else 'N' end || '|100|' || case when s_suppkey % 4 = 0 then 'Y' else 'N' end || '|N' as line from supplier""")  # fmt: skip
relation("lines_other", """select 'ACT Symbol|Security Name|Exchange|CQS Symbol|ETF|Round Lot Size|Test Issue|NASDAQ Symbol' as line from region where r_regionkey = 0
  union all select 'S' || cast(p_partkey as string) || case when p_partkey % 11 = 0 then '.A' else '' end || '|' || p_name || '|' || case p_partkey % 6 when 0 then 'N' when 1 then 'A' when 2 then 'P' when 3 then 'Z' when 4 then 'V' else 'X' end || '|x|' || case when p_partkey % 5 = 0 then 'Y' else 'N' end || '|100|' || case when p_partkey % 13 = 0 then 'Y' else 'N' end || '|y' as line from part""")  # fmt: skip
_SPLIT = "(select line, {f} from {t} where line not like 'File Creation%' and trim(line) <> '' and length(line) - length(replace(line, '|', '')) >= 7) as s"
_PART = "split_part(line, '|', {i})"
_fields = lambda names: ", ".join(f"{_PART.format(i=i)} as {n}" for n, i in names.items())
# Financial status codes that are left out, exchange codes and their names, patterns of what isn't common stock.
STATUS_OUT = ("D", "E", "Q", "G", "H", "J", "K")
EXCHANGES = {"N": "NYSE", "A": "NYSE American", "P": "NYSE Arca", "Z": "BATS", "V": "IEX"}
SUFFIX_OUT = "[A-Z]{1,5}(W|U|R|WS|UN|WT)$"
NAME_OUT = r"warrant|rights|units|preferred|debenture|note\b|bond\b|%.*note|acquisition.*unit|when.issued|depositary|trust.*series|convertible"
query("universe_parse_primary", f"select symbol, name, 'NASDAQ' as exchange, etf = 'Y' as etf from {_SPLIT.format(f=_fields({'symbol': 1, 'name': 2, 'test': 4, 'status': 5, 'etf': 7}), t='lines_primary')} where symbol <> 'Symbol' and test <> 'Y' and status not in ({_quoted(STATUS_OUT)})")
query("universe_parse_other", f"select symbol, name, case exchange {' '.join(f'''when '{k}' then '{v}' ''' for k, v in EXCHANGES.items())} else exchange end as exchange, etf = 'Y' as etf from {_SPLIT.format(f=_fields({'symbol': 1, 'name': 2, 'exchange': 3, 'etf': 5, 'test': 7}), t='lines_other')} where symbol <> 'ACT Symbol' and test <> 'Y'")
# A backslash is written as chr(92): the engines read it differently in a literal.
_pattern = lambda text: " || chr(92) || ".join(f"'{part}'" for part in text.split("\\"))
_matches = lambda column, pattern: f"regexp_replace({column}, {_pattern(pattern)}, '') <> {column}"
# The first listing that passes every filter counts: one that is rejected hides no later one.
query(
    "universe_tradeable",
    f"""select symbol, name, exchange, etf from (
      select *, row_number() over (partition by symbol order by source, name, exchange) as rn from (select 1 as source, u.* from universe_parse_primary u union all select 2 as source, o.* from universe_parse_other o) as b
      where not ({_matches("symbol", "[.+=^#$-]")}) and not (length(symbol) > 4 and {_matches("symbol", SUFFIX_OUT)}) and not ({_matches("lower(name)", NAME_OUT)}) and length(name) >= 3) as d
    where rn = 1""",
)
query("universe_by_exchange", "select symbol, exchange from universe_tradeable where exchange = 'NYSE' and not etf")
query("universe_search", "select symbol, name from universe_tradeable where symbol like '%S1%' or upper(name) like '%S1%'")
query("universe_counts", "select exchange, count(*) as n, count_if(etf) as etfs from universe_tradeable group by exchange")
