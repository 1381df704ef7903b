"""The trade journal takes every order and every line item."""

from tidemark.plans import registry


def test_every_order_is_a_trade_and_every_item_of_an_option_a_roll(spark):
    orders = spark.sql("select id as o_orderkey, id % 3 as o_custkey, timestamp_ntz'2024-01-01 00:00:00' as o_orderdate, element_at(array('O', 'P', 'F'), cast(id % 3 + 1 as int)) as o_orderstatus from range(24)")
    items = spark.sql("select o.id as l_orderkey, cast(n.id + 1 as int) as l_linenumber, 0.05D as l_discount, timestamp_ntz'2024-02-01 00:00:00' as l_shipdate from range(24) o cross join range(7) n")
    given = {"orders": orders, "lineitem": items, "customer": spark.sql("select id as c_custkey, 'S' as c_mktsegment from range(3)")}
    open_ids = {r.trade_id for r in registry.run(spark, "open_positions", **given).collect()}
    closed_ids = {r.trade_id for r in registry.run(spark, "trade_pnl", **given).collect()}
    assert open_ids == set(range(0, 24, 3)) and closed_ids == set(range(24)) - open_ids
    rolls = {(r.trade_id, r.roll_no) for r in registry.run(spark, "roll_history", **given).collect()}
    assert rolls == {(i, n) for i in range(24) if i % 3 for n in range(1, 8)}
