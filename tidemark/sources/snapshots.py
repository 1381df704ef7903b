"""Dated snapshots of a scan: a partition a run date, replaced alone when the day's run is made again."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.catalog import query
from tidemark.session import new_path


def write_snapshot(results: DataFrame, folder: str) -> None:
    """``results`` with a ``run_date``: its days replace those of the same dates, other days stay."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(folder)


def read_snapshot(spark: SparkSession, folder: str, day: date) -> DataFrame:
    """A day's results: only that day's partition is read."""
    return spark.read.parquet(folder).where(F.col("run_date") == F.lit(day)).drop("run_date")


def confirmed(now: DataFrame, folder: str, day: date) -> DataFrame:
    """``now`` with ``confirmed``: whether the same strategy had the symbol in the day's earlier session."""
    earlier = read_snapshot(now.sparkSession, folder, day).select("strategy", "symbol").distinct().withColumn("confirmed", F.lit(True))
    return now.join(earlier, ["strategy", "symbol"], "left").withColumn("confirmed", F.coalesce("confirmed", F.lit(False)))


def _two_days(use) -> DataFrame:
    """The morning's scans of two days, the second day's written again; the afternoon's are held against that day."""
    scans, today = use("scans").select("strategy", "symbol"), date(2024, 1, 2)
    folder = new_path(scans.sparkSession, "snapshots")
    rows = use("am_snapshot").select("strategy", "symbol", F.when(F.col("same_day") == 1, F.lit(today)).otherwise(F.lit(date(2024, 1, 1))).alias("run_date"))
    write_snapshot(rows, folder)
    write_snapshot(rows.where(F.col("run_date") == F.lit(today)), folder)
    return confirmed(scans, folder, today)


query("pm_confirmed_dated", "select s.strategy, s.symbol, a.symbol is not null as confirmed from scans s left join snapshot_same_day a on a.strategy = s.strategy and a.symbol = s.symbol", _two_days)
