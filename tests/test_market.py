"""The library's own operators: against DuckDB, by hand, and by their properties."""

import itertools

import duckdb
import numpy as np
import pytest
from pyspark.sql import Row

from tidemark.operators import hmm
from tidemark.plans import registry
from tidemark.sources.bars import standardize

SF = "/root/testdata/sf0.001"


def rows_of(columns, rows):
    plain = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", ["features", "rolling_pct_rank", "adx", "conf_bottoming", "signal_v2", "gex_flip", "universe_parse_other", "trade_pnl", "asof_index_join", "backtest_v1_trades", "backtest_v2_trades", "metrics_v2", "option_score", "universe_tradeable", "positions_mtm", "open_positions", "report_top25", "chart_payload"])
def test_same_as_duckdb(spark, name):
    got = registry.queries()[name](spark, SF)
    db = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cursor = db.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows_of(columns, cursor.fetchall()) == rows_of(got.columns, [tuple(r) for r in got.collect()])


def test_own_bars_by_hand(spark):
    bars = spark.sql("select 'A' as symbol, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(id as int)) as bar_ts, 1D as open, 2D as high, 1D as low, cast(id + 1 as double) as close, 100L as volume from range(12)")
    found = {r.bar_ts.day: r for r in registry.run(spark, "momentum", bars=bars).collect()}
    assert found[1].m1 is None and found[2].m1 == 1.0 and found[11].m10 == 10.0
    ema = {r.bar_ts.day: r.ema10 for r in registry.run(spark, "ema", bars=bars).collect()}
    assert ema[9] is None and ema[10] is not None


def test_standardize_takes_the_first_of_columns_that_agree(spark):
    raw = spark.createDataFrame([("A", 1.0, 9.0, 0.5, 2.0, 7.0, 8.0, 10, 11)], "Symbol string, Open double, High double, Low double, Close double, x double, y double, Volume long, z long")
    raw = raw.toDF("Symbol", "Open", "High", "Low", "Close", "close", "Close", "Volume", "VOLUME")
    made = standardize(raw)
    assert made.columns == ["symbol", "open", "high", "low", "close", "volume"]
    assert [tuple(r) for r in made.collect()] == [("A", 1.0, 9.0, 0.5, 2.0, 10)]


def test_standardize_names_and_fallback(spark):
    raw = spark.createDataFrame([Row(Open=1.0, HIGH=2.0, low=0.5, Volume=10, **{"Adj Close": 1.5})])
    assert standardize(raw).first().close == 1.5
    with pytest.raises(ValueError):
        standardize(raw.drop("Volume"))


def test_hmm_properties():
    rng = np.random.default_rng(1)
    truth = np.repeat([0, 1, 0, 1], 60)
    x = np.where(truth == 0, 2.0, -2.0)[:, None] + rng.normal(0, 0.5, (240, 1))
    start, trans, means, covs, history = hmm.fit(x, 2)
    assert all(b >= a - 1e-6 for a, b in itertools.pairwise(history))
    assert np.allclose(trans.sum(axis=1), 1)
    found = hmm.decode(x, x[:, 0], 2)
    assert (found.regimes == truth).mean() >= 0.95 and (found.confidence <= 1 + 1e-9).all()


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    log_b, start, trans = rng.normal(size=(5, 2)), np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]])
    score = lambda p: np.log(start[p[0]]) + log_b[0, p[0]] + sum(np.log(trans[a, b]) + log_b[t + 1, b] for t, (a, b) in enumerate(itertools.pairwise(p)))
    assert tuple(hmm.viterbi(log_b, start, trans)) == max(itertools.product(range(2), repeat=5), key=score)


def test_stream_equals_batch(spark, tmp_path):
    from tidemark.streaming.bars import bars_stream

    events = spark.read.parquet(f"{SF}/events.parquet").select("ts", "event_type", "value")
    events.write.parquet(str(tmp_path / "in"))
    stream = bars_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = registry.run(spark, "bars_hourly", SF)
    columns = ["symbol", "bar_ts", "open", "high", "low", "close", "volume"]
    assert sorted(map(tuple, spark.table("hourly").select(*columns).collect())) == sorted(map(tuple, batch.select(*columns).collect()))


def test_entry_imports_without_training_operators():
    import __spark_entry__

    assert "signal_v1" in __spark_entry__.queries() and "signal_v1" in __spark_entry__.oracle_sql()
