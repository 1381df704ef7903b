"""The trade journal as immutable events: entries, exits and rolls, and views of the present state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.catalog import query, relation, run
from tidemark.session import new_path

# Events from orders: an entry for each, an exit for each that isn't open, rolls from the line items of options.
relation("trade_entries", "select o_orderkey as trade_id, c_mktsegment as symbol, case when o_orderkey % 3 = 0 then null else 'C' || cast(o_orderkey % 50 as string) end as contract, cast(1 + o_orderkey % 5 as int) as quantity, round(cast(o_orderkey % 997 as double) / 10, 2) as entry_price, o_orderdate as entry_ts, cast(o_custkey % 7 as int) as regime_id, o_orderstatus as order_status from orders join customer on c_custkey = o_custkey")
relation("trade_exits", "select trade_id, round(entry_price * (0.80 + cast(trade_id % 41 as double) / 100), 4) as exit_price, entry_ts as exit_ts from trade_entries where order_status <> 'O'")
relation("trade_rolls", "select trade_id, cast(row_number() over (partition by trade_id order by l_shipdate, l_linenumber, l_discount) as int) as roll_no, contract as from_contract, 'C' || cast(50 + l_linenumber as string) as to_contract, round(l_discount * 2, 2) as credit, l_shipdate as roll_ts from trade_entries join lineitem on l_orderkey = trade_id where contract is not null")

query("trade_roll_rollup", "select trade_id, count(*) as roll_count, round(sum(credit), 4) as roll_credits, max_by(to_contract, cast(roll_ts as string) || to_contract) as contract from trade_rolls group by trade_id")
query(
    "trade_pnl",
    """select e.trade_id, e.symbol, e.regime_id, coalesce(r.contract, e.contract) as contract, round(case when e.contract is null then (x.exit_price - e.entry_price) * e.quantity else (x.exit_price - e.entry_price) * 100 * e.quantity + coalesce(r.roll_credits, 0) end, 4) as pnl,
      case when e.entry_price > 0 then round((x.exit_price - e.entry_price) / e.entry_price * 100, 4) else 0 end as pnl_pct, x.exit_ts
    from trade_entries e join trade_exits x on x.trade_id = e.trade_id left join trade_roll_rollup r on r.trade_id = e.trade_id""",
)
query("roll_history", "select r.trade_id, e.symbol, r.roll_no, r.from_contract, r.to_contract, r.credit from trade_rolls r join trade_entries e on e.trade_id = r.trade_id")
relation("open_entries", "select e.trade_id, e.symbol, e.quantity, e.entry_price, e.entry_ts from trade_entries e left join trade_exits x on x.trade_id = e.trade_id where x.trade_id is null")
# Newest first: the positions opened later (counted by time of entry), then the place among those of the same time.
relation("later_entries", "select entry_ts, coalesce(sum(n) over (order by entry_ts desc rows between unbounded preceding and 1 preceding), 0) as later from (select entry_ts, count(*) as n from open_entries group by entry_ts) as d")
query("open_positions", "select e.trade_id, e.symbol, e.quantity, e.entry_price, e.entry_ts, cast(l.later + row_number() over (partition by e.entry_ts order by e.trade_id) as int) as rank from open_entries e join later_entries l on l.entry_ts = e.entry_ts")
query("closed_trades", "select trade_id, symbol, pnl, pnl_pct, exit_ts from (select *, row_number() over (order by exit_ts desc, trade_id) as rn from trade_pnl) as t where rn <= 50")
query("trades_head", "select trade_id, symbol, pnl from (select *, row_number() over (partition by symbol order by exit_ts, trade_id) as rn from trade_pnl) as t where rn <= 20")
_EXACT = "cast(sum(cast(round(pnl * 10000) as bigint)) as double) / 10000"
relation(
    "perf_totals",
    f"""select count(*) as total_trades, count_if(pnl > 0) as winning_trades, count(*) - count_if(pnl > 0) as losing_trades, coalesce(round(100.0 * cast(count_if(pnl > 0) as double) / nullif(count(*), 0), 1), 0) as win_rate,
      coalesce(round({_EXACT}, 4), 0) as total_pnl, coalesce(round({_EXACT} / nullif(count(*), 0), 2), 0) as avg_pnl, max(pnl) as best_pnl, min(pnl) as worst_pnl from trade_pnl""",
)
# The best and the worst trade are the first of those with that result.
query(
    "perf_summary",
    """select s.*, w.worst_trade_id, w.worst_symbol, o.open_trades, r.total_rolls, r.total_roll_credits from (
        select t.*, b.best_trade_id, b.best_symbol from perf_totals t cross join (select min(trade_id) as best_trade_id, min_by(symbol, trade_id) as best_symbol from trade_pnl p join perf_totals t on p.pnl = t.best_pnl) as b) as s
      cross join (select min(trade_id) as worst_trade_id, min_by(symbol, trade_id) as worst_symbol from trade_pnl p join perf_totals t on p.pnl = t.worst_pnl) as w
      cross join (select count(*) as open_trades from open_entries) as o cross join (select count(*) as total_rolls, coalesce(round(sum(credit), 2), 0) as total_roll_credits from trade_rolls) as r""",
)
query("perf_by_regime", "select regime_id, count(*) as trades, count_if(pnl > 0) as wins, round(cast(sum(cast(round(pnl * 10000) as bigint)) as double) / 10000, 4) as pnl from trade_pnl group by regime_id")
# A broker's symbol belongs to a position whose symbol it is or begins with: broker rows by each beginning, so that the join is an equality.
relation("broker_positions", "select distinct case when c_custkey % 3 = 0 then c_mktsegment else c_mktsegment || cast(c_custkey % 3 as string) end as broker_symbol, cast(10 + c_custkey % 3 as double) as price from customer")
relation(
    "beginnings",
    "select substring(b.broker_symbol, 1, i) as beginning, b.broker_symbol, b.price from broker_positions b, unnest(range(1, length(b.broker_symbol) + 1)) as t(i)",
    lambda use: use("broker_positions").where("length(broker_symbol) > 0").selectExpr("explode(sequence(1, length(broker_symbol))) as i", "*").selectExpr("substring(broker_symbol, 1, cast(i as int)) as beginning", "broker_symbol", "price"),
)
relation("broker_first", "select beginning, broker_symbol, price from (select *, row_number() over (partition by beginning order by length(broker_symbol), broker_symbol, price) as rn from beginnings) as f where rn = 1")
query(
    "positions_mtm",
    """select p.trade_id, p.symbol, b.broker_symbol, round((b.price - p.entry_price) * p.quantity * 100, 4) as unrealized, case when p.entry_price > 0 then round((b.price / p.entry_price - 1) * 100, 4) end as unrealized_pct
    from open_positions p left join broker_first b on b.beginning = p.symbol""",
)


KEYS = {"entries": ["trade_id"], "exits": ["trade_id"], "rolls": ["trade_id", "roll_no"]}


def entry_ids(entries: DataFrame) -> DataFrame:
    """``entries`` with a trade_id from what they say, so that an entry that is logged again is the same trade."""
    return entries.withColumn("trade_id", F.xxhash64("symbol", "contract", "quantity", "entry_price", "entry_ts"))


def append_events(events: DataFrame, folder: str, kind: str) -> None:
    """Add entries, exits or rolls to a journal kept as Parquet; what is there is never changed.

    Events that the journal has are left out, so an append that is retried adds nothing; of equal ones in
    ``events`` one is taken. An exit closes a trade once: the first that was logged counts.
    """
    if kind not in KEYS:
        raise ValueError(f"no events of kind {kind}")
    spark, path = events.sparkSession, f"{folder}/{kind}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    new = events.dropDuplicates(KEYS[kind])
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        new = new.join(spark.read.schema(events.schema).parquet(path).select(KEYS[kind]), KEYS[kind], "left_anti").select(events.columns)
    new.write.mode("append").parquet(path)


def journal_relations(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The journal's events, to be given to ``run`` by name: ``run(spark, "trade_pnl", **journal_relations(spark, folder))``."""
    return {f"trade_{kind}": spark.read.parquet(f"{folder}/{kind}") for kind in KEYS}


relation(
    "journal_view",
    """select e.trade_id, e.symbol, coalesce(r.contract, e.contract) as contract, e.quantity, case when x.trade_id is null then 'open' else 'closed' end as status, coalesce(r.roll_count, 0) as roll_count, coalesce(r.roll_credits, 0) as total_roll_credits
    from trade_entries e left join trade_exits x on x.trade_id = e.trade_id left join trade_roll_rollup r on r.trade_id = e.trade_id""",
)


def _logged_twice(use) -> DataFrame:
    """The journal's present state after every event has been logged, and logged again."""
    events = {kind: use(f"trade_{kind}") for kind in KEYS}
    spark = events["entries"].sparkSession
    folder = new_path(spark, "journal")
    for _ in range(2):
        for kind, rows in events.items():
            append_events(rows, folder, kind)
    return run(spark, "journal_view", **journal_relations(spark, folder))


query("journal_state", "select * from journal_view", _logged_twice)
