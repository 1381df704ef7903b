"""Session factory and helpers that every part of the library shares."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators' results rely on (time zone) or profit from (adaptive execution).
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}

_shipped: set[str] = set()
_scratch: dict[str, str] = {}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **more: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings one."""
    builder = SparkSession.builder.master(master).appName("tidemark")
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (SETTINGS | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application.

    Workers then import it whether or not the cluster's machines have it.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), "tidemark_pkg")
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(here), os.path.basename(here)))
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines share: ``spark.checkpoint.dir``.

    Only where it is unset and all runs on one machine (tests) a temporary folder is made; a cluster must name one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    if app not in _scratch:
        _scratch[app] = "file://" + tempfile.mkdtemp(prefix="spark-tidemark-")
        spark.sparkContext.setCheckpointDir(_scratch[app])
    return _scratch[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{_own_folder(spark)}/{uuid.uuid4().hex}/{name}"


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tidemark-{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application has materialized, once none of its results is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Shuffle files go at a query's end, not when the driver happens to collect its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: what reads the result survives the loss of any executor, and the write's shuffle files can go.
    """
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
