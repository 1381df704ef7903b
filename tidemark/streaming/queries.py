"""Streams as registered queries: read as files of bounded number a batch, until what is there has been read.

A table's rows come as files in the shared folder, in periods written one after the
other, a symbol's rows of a period in one file. Each query restarts from its
checkpoint when the later periods have come, and its sink can't be doubled by a batch
that runs again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemark.plans.catalog import query, relation
from tidemark.session import new_path
from tidemark.streaming.bars import scan_chunks, signal_counts_stream
from tidemark.streaming.changes import CHANGE, CONF, regime_changes

PERIODS, FILES_A_BATCH = 4, 8


def drain(writer: DataStreamWriter) -> None:
    """Run a stream over all that has come, then stop; what fails is raised."""
    started = writer.trigger(availableNow=True).start()
    started.awaitTermination()


def read_files(spark: SparkSession, rows: DataFrame, folder: str) -> DataFrame:
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES_A_BATCH).parquet(f"{folder}/*")


def periods(rows: DataFrame, order: str, folder: str) -> list[Callable[[], None]]:
    """Functions that write ``rows`` by ``PERIODS`` of ``order``, each to a folder of its own."""
    low, high = rows.agg(F.min(order), F.max(order)).first()
    if low is None:
        return [lambda: rows.limit(0).write.parquet(f"{folder}/period=0")]
    part = F.least(F.lit(PERIODS - 1), F.floor((F.col(order) - low) * PERIODS / F.lit(max(1, high - low + 1))))
    return [(lambda i: lambda: rows.where(part == i).repartition("symbol").write.parquet(f"{folder}/period={i}"))(i) for i in range(PERIODS)]


def with_restart(spark: SparkSession, rows: DataFrame, order: str, write: Callable[[DataFrame, str], DataStreamWriter]) -> str:
    """Stream the first periods, stop, and go on from the checkpoint when the others have come. Returns the folder of it all."""
    folder = new_path(spark, "stream")
    writes = periods(rows, order, f"{folder}/in")
    for part in (writes[: len(writes) // 2], writes[len(writes) // 2 :]):
        if part:
            for put in part:
                put()
            drain(write(read_files(spark, rows, f"{folder}/in"), folder).option("checkpointLocation", f"{folder}/checkpoint"))
    return folder


# Runs are the days on which any nation has a bar; a nation without one that day is absent from that run.
relation(
    "run_scans",
    """select r.symbol, d.run, r.regime_id from (
      select cast(symbol as string) as symbol, bar_ts, cast(ntile(7) over (partition by symbol order by close / open desc, bar_ts) - 1 as int) as regime_id from bars_nation) as r
    join (select bar_ts, row_number() over (order by bar_ts) as run from (select distinct bar_ts from bars_nation) as t) as d on d.bar_ts = r.bar_ts""",
)


def stream_regime_changes(use) -> DataFrame:
    rows = use("run_scans").select("symbol", F.col("run").cast("long").alias("run"), "regime_id")
    spark = rows.sparkSession
    before = {name: spark.conf.get(name) for name in CONF}
    for name, value in CONF.items():
        spark.conf.set(name, value)
    try:
        folder = with_restart(spark, rows, "run", lambda scans, to: regime_changes(scans).writeStream.format("parquet").outputMode("append").option("path", f"{to}/out"))
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return spark.read.schema(CHANGE).parquet(f"{folder}/out")  # the sink's own log says which files count


query("stream_regime_changes", "select c.symbol, c.run, p.regime_id as prev_regime_id, c.regime_id from run_scans c join run_scans p on p.symbol = c.symbol and p.run = c.run - 1 where p.regime_id <> c.regime_id", stream_regime_changes)


def stream_signal_counts(use) -> DataFrame:
    """Counts so far are written whole by batch; the last batch has them all."""
    rows = use("replay_v1").select("symbol", F.unix_timestamp(F.col("bar_ts").cast("timestamp")).alias("at"), "signal")

    def put(counts: DataFrame, batch: int) -> None:
        counts.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    spark = rows.sparkSession
    folder = new_path(spark, "counts")
    with_restart(spark, rows, "at", lambda signals, _: signal_counts_stream(signals).writeStream.outputMode("complete").foreachBatch(put))
    every = spark.read.parquet(folder)
    return every.join(F.broadcast(every.agg(F.max("batch").alias("batch"))), "batch").select("signal", F.col("count").alias("n"))


query("stream_signal_counts", "select coalesce(signal, 'UNKNOWN') as signal, count(*) as n from replay_v1 group by coalesce(signal, 'UNKNOWN')", stream_signal_counts)


def stream_scan(use) -> DataFrame:
    """A stream of symbols, scanned by bounded batches; a batch that runs again overwrites its own rows."""
    bars = use("bars")
    spark = bars.sparkSession
    folder = new_path(spark, "scan")
    for name in ("bars", "regimes"):
        use(name).write.parquet(f"{folder}/{name}")
    symbols = bars.select("symbol").distinct()
    symbols.repartition(2, "symbol").write.parquet(f"{folder}/in/period=0")
    stream = spark.readStream.schema(symbols.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")

    def given(session: SparkSession) -> dict[str, DataFrame]:
        """Read in the batch's own session."""
        return {name: session.read.parquet(f"{folder}/{name}") for name in ("bars", "regimes")}

    writer = stream.writeStream.foreachBatch(scan_chunks(given, "v2", folder)).option("checkpointLocation", f"{folder}/checkpoint")
    drain(writer)
    return spark.read.parquet(f"{folder}/results").drop("batch")


query("stream_scan", "select * from scan_v2", stream_scan)
