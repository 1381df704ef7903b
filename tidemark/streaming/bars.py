"""Streaming forms: ticks to bars, scans chunk by chunk, signal counts and regime changes.

Each takes a streaming DataFrame; ``*_stream`` functions give one, the others start
from ``foreachBatch`` and give its function, for ``writeStream.foreachBatch(...)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.catalog import run as run_relation


def bars_stream(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Hourly bars of ticks (event_type, ts, value), final once the watermark passes."""
    hour = F.window("ts", "1 hour")
    bars = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(hour.alias("hour"), F.col("event_type").alias("symbol"))
    made = bars.agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").alias("volume"))
    return made.select("symbol", F.col("hour.start").cast("timestamp_ntz").alias("bar_ts"), "open", "high", "low", "close", "volume")


def signal_counts_stream(scans: DataFrame) -> DataFrame:
    """Signals counted so far; for update or complete mode."""
    return scans.groupBy(F.coalesce("signal", F.lit("UNKNOWN")).alias("signal")).count()


def regime_changes_stream(scans: DataFrame) -> DataFrame:
    """A row whenever a symbol's regime differs from its last one: a value of state for each symbol."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def changed(key, batches, state):
        rows = pd.concat(list(batches)).sort_values("bar_ts")
        last, out = (state.get[0] if state.exists else None), []
        for regime, ts in zip(rows["regime_id"], rows["bar_ts"], strict=True):
            if last is not None and regime != last:
                out.append((key[0], last, int(regime), ts))
            last = int(regime)
        state.update((last,))
        yield pd.DataFrame(out, columns=["symbol", "prev_regime_id", "regime_id", "bar_ts"])

    return scans.select("symbol", "regime_id", "bar_ts").groupBy("symbol").applyInPandasWithState(changed, "symbol string, prev_regime_id int, regime_id int, bar_ts timestamp", "last int", "append", GroupStateTimeout.NoTimeout)


def scan_chunks(relations: Callable[[SparkSession], dict[str, DataFrame]], strategy: str, folder: str) -> Callable[[DataFrame, int], None]:
    """For a stream of symbols: each batch is scanned; results and a row of progress go to ``folder``, by batch.

    ``relations`` gives, in a batch's own session, the bars and what else the scan takes, such as ``regimes``. A batch
    that is run again overwrites its own rows only.
    """

    def run(symbols: DataFrame, batch: int) -> None:
        spark = symbols.sparkSession
        asked, given = symbols.select("symbol").distinct(), relations(spark)
        found = run_relation(spark, f"scan_{strategy}", **given | {"bars": given["bars"].join(asked, "symbol", "left_semi")})
        found.write.mode("overwrite").parquet(f"{folder}/results/batch={batch}")
        done = spark.read.parquet(f"{folder}/results/batch={batch}")
        counts = done.agg(F.count("*").alias("found"), F.count_if(F.col("regime_id") <= 2).alias("bullish"), F.count_if(F.col("regime_id") >= 5).alias("bearish"))
        asked.agg(F.count("*").alias("asked")).crossJoin(counts).coalesce(1).write.mode("overwrite").parquet(f"{folder}/progress/batch={batch}")

    return run


def snapshot_changes(folder: str) -> Callable[[DataFrame, int], None]:
    """For a stream whose batches are whole scans (symbol, regime_id): regimes that differ from the batch before.

    Each snapshot replaces the one before whole, so a symbol that was absent from a scan is forgotten.
    """

    def run(scans: DataFrame, batch: int) -> None:
        known = scans.where("regime_id is not null").select("symbol", "regime_id").dropDuplicates(["symbol"])
        known.write.mode("overwrite").parquet(f"{folder}/snapshot/batch={batch}")
        known = scans.sparkSession.read.parquet(f"{folder}/snapshot/batch={batch}")
        if batch:
            before = scans.sparkSession.read.parquet(f"{folder}/snapshot/batch={batch - 1}").withColumnRenamed("regime_id", "prev_regime_id")
            changed = known.join(before, "symbol").where("prev_regime_id <> regime_id").select("symbol", "prev_regime_id", "regime_id")
            changed.write.mode("overwrite").parquet(f"{folder}/changes/batch={batch}")

    return run
