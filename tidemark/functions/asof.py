"""The last value of one keyed series as of each row of another, whatever one key's share of the rows.

Both series are range-partitioned by key and time together, so that a long key spreads
over many tasks. A task carries values forward within its rows and leaves one line on
how it ends; these lines, one a task, are put together on the driver, and give what
the first key of each task has from the tasks before. No window, no single task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from tidemark.session import materialize, ship_package


def _forward(schema: pa.Schema):
    """Of rows (key, time, side, value, left) in order: the left ones with the last value of their key in this task, and whether there was one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        present, value, known = None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_pylist()
            side = batch.column("side").to_numpy()
            at = np.arange(len(keys))
            new = np.array([True, *(a != b for a, b in zip(keys[1:], keys[:-1], strict=True))])
            new[0] = keys[0] != present
            begin = np.maximum.accumulate(np.where(new, at, -1))
            last = np.maximum.accumulate(np.where(side == 0, at, -1))
            inside = (last >= begin) & (last >= 0)
            values = batch.column("value").take(pa.array(np.where(inside, last, 0)))
            before = (begin < 0) & known & ~inside  # goes on from the batch before
            fill = pa.array([value] * len(keys), values.type)
            filled = pc.if_else(pa.array(inside), values, pc.if_else(pa.array(before), fill, pa.scalar(None, values.type)))
            has = inside | before
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), part, np.int32)), pa.array(number + at), batch.column("key"), batch.column("side"), batch.column("left"), filled, pa.array(has)], schema=schema)
            present, value, known, number = keys[-1], filled[-1].as_py(), bool(has[-1]), number + len(keys)

    return run


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, value: str, alias: str | None = None) -> DataFrame:
    """``left`` with ``value`` of the last row of ``right`` with its key at or before its time (null if there is none).

    Of rows of ``right`` at one time the greatest value counts. Rows with a null key or time get null, and those of
    ``right`` take no part; repeated rows of ``left`` stay.
    """
    spark, alias = left.sparkSession, alias or value
    ship_package(spark)
    kind = right.schema[value].dataType
    own = F.struct(*(F.col(f"`{c}`") for c in left.columns))
    usable = F.col(key).isNotNull() & F.col(time).isNotNull()
    events = right.where(usable).groupBy(key, time).agg(F.max(value).alias("value")).select(F.col(key).alias("key"), F.col(time).alias("time"), F.lit(0).alias("side"), "value", F.lit(None).cast(left.select(own.alias("o")).schema["o"].dataType).alias("left"))
    asked = left.where(usable).select(F.col(key).alias("key"), F.col(time).alias("time"), F.lit(1).alias("side"), F.lit(None).cast(kind).alias("value"), own.alias("left"))
    # Equal rows may be parted anywhere: a number of their own lets ranges cut between them.
    both = events.unionByName(asked).withColumn("own", F.monotonically_increasing_id())
    order = ["key", "time", "side", "own"]
    dealt = both.repartitionByRange(*order).sortWithinPartitions(*order).drop("own")
    schema = StructType([*StructType.fromDDL("part int, number long").fields, dealt.schema["key"], dealt.schema["side"], dealt.schema["left"], StructField("value", kind), *StructType.fromDDL("has boolean").fields])
    local = materialize(dealt.mapInArrow(_forward(to_arrow_schema(schema)), schema), "asof")
    lines = local.groupBy("part").agg(F.min("key").alias("first"), F.max_by(F.struct("key", "value", "has"), "number").alias("last")).orderBy("part").collect()  # one a task
    carried, before = [], None
    for line in lines:
        goes_on = before is not None and before[0] == line["first"] and before[2]
        if goes_on:
            carried.append((line["part"], before[0], before[1]))
        own_end = tuple(line["last"])
        before = (own_end[0], before[1], True) if goes_on and own_end[0] == line["first"] and not own_end[2] else own_end
    carry = spark.createDataFrame(carried, StructType([local.schema["part"], StructField("key", local.schema["key"].dataType), StructField("carried", kind)]))
    found = local.where("side = 1").join(F.broadcast(carry), ["part", "key"], "left")  # a row a task at most
    whole = found.select("left.*", F.when(F.col("has"), F.col("value")).otherwise(F.col("carried")).alias(alias))
    return whole.unionByName(left.where(~usable).withColumn(alias, F.lit(None).cast(kind)))
