"""Streams of scans: counts, changes with and without forgetting, and scans chunk by chunk."""

from tidemark.plans import registry
from tidemark.streaming.bars import regime_changes_stream, scan_chunks, signal_counts_stream, snapshot_changes


def stream(spark, tmp_path, batches, schema):
    """A stream with a file for each batch."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def drain(writer):
    query = writer.trigger(availableNow=True).start()
    assert query.awaitTermination(180)


def test_signal_counts(spark, tmp_path):
    scans = stream(spark, tmp_path, [[("a",), (None,)], [("a",), ("b",)]], "signal string")
    drain(signal_counts_stream(scans).writeStream.format("memory").queryName("counts").outputMode("complete"))
    assert {tuple(r) for r in spark.table("counts").collect()} == {("a", 2), ("b", 1), ("UNKNOWN", 1)}


def test_regime_changes(spark, tmp_path):
    schema = "symbol string, regime_id int, day int"
    scans = stream(spark, tmp_path, [[("A", 1, 1), ("B", 2, 1)], [("A", 1, 2), ("B", 3, 2)], [("A", 5, 3)]], schema).selectExpr("symbol", "regime_id", "timestamp_seconds(day) as bar_ts")
    drain(regime_changes_stream(scans).writeStream.format("memory").queryName("changes").outputMode("append"))
    assert {(r.symbol, r.prev_regime_id, r.regime_id) for r in spark.table("changes").collect()} == {("B", 2, 3), ("A", 1, 5)}


def test_a_snapshot_forgets_absent_symbols(spark, tmp_path):
    scans = stream(spark, tmp_path, [[("A", 1), ("B", 2)], [("A", 3), ("C", 1)], [("A", 3), ("B", 6), ("C", 0)]], "symbol string, regime_id int")
    drain(scans.writeStream.foreachBatch(snapshot_changes(f"{tmp_path}/out")))
    assert {(r.batch, r.symbol, r.prev_regime_id, r.regime_id) for r in spark.read.parquet(f"{tmp_path}/out/changes").collect()} == {(1, "A", 1, 3), (2, "C", 1, 0)}


def test_scan_chunks(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    symbols = stream(spark, tmp_path, [[("BUILDING",), ("MACHINERY",)], [("FURNITURE",), ("NOBODY",)]], "symbol string")
    relations = lambda session: {name: registry.run(session, name, sf) for name in ("bars", "regimes")}
    drain(symbols.writeStream.foreachBatch(scan_chunks(relations, "v1", f"{tmp_path}/out")))
    whole = {r.symbol: r.signal for r in registry.run(spark, "scan_v1", sf).collect()}
    got = spark.read.parquet(f"{tmp_path}/out/results").collect()
    assert {r.symbol: r.signal for r in got} == {s: v for s, v in whole.items() if s in ("BUILDING", "MACHINERY", "FURNITURE")}
    assert sorted((r.batch, r.asked) for r in spark.read.parquet(f"{tmp_path}/out/progress").collect()) == [(0, 2), (1, 2)]


def test_changes_forget_absent_symbols_and_go_on_after_a_restart(spark, tmp_path):
    """Runs 1 to 3, a stop, runs 3 (again) to 5: B is absent from run 2, C leaves after run 1 and is back at run 5."""
    from tidemark.streaming.changes import CONF, regime_changes

    schema = "symbol string, run long, regime_id int"
    first = [("A", 1, 0), ("A", 2, 0), ("A", 3, 4), ("B", 1, 1), ("B", 3, 5), ("C", 1, 2), ("D", 1, None)]
    second = [("A", 3, 4), ("A", 4, 1), ("A", 5, 1), ("B", 4, 6), ("B", 5, 5), ("C", 5, 3), ("D", 5, 0)]
    for name, value in CONF.items():
        spark.conf.set(name, value)
    try:
        for rows in (first, second):
            spark.createDataFrame(rows, schema).repartition(2, "symbol").write.mode("append").parquet(f"{tmp_path}/in")
            scans = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
            drain(regime_changes(scans).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state"))
    finally:
        for name in CONF:
            spark.conf.unset(name)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("A", 3, 0, 4), ("A", 4, 4, 1), ("B", 4, 5, 6), ("B", 5, 6, 5)]


def test_a_batch_that_runs_again_doubles_nothing(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    relations = lambda session: {name: registry.run(session, name, sf) for name in ("bars", "regimes")}
    chunk = scan_chunks(relations, "v1", f"{tmp_path}/out")
    symbols = spark.createDataFrame([("BUILDING",)], "symbol string")
    chunk(symbols, 0)
    once = spark.read.parquet(f"{tmp_path}/out/results").collect()
    chunk(symbols, 0)
    assert spark.read.parquet(f"{tmp_path}/out/results").collect() == once
