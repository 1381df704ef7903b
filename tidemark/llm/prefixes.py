"""Positions and prefix digests of ordered rows by key, whatever one key's share of the rows.

Rows are range-partitioned by key and order, so that a long key spreads over many
tasks. A prefix's digest is four polynomials of its rows' digests modulo a prime:
what a task has of a key is continued from the task before by a product and a sum.
Each task leaves one line on its last key; these lines, one a task, are put together
on the driver, and give what to add to the first key of each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize, ship_package

#: The prime, and a base for each of the lanes (from a rule).
PRIME, LANES = (1 << 31) - 1, 4
BASES = [int.from_bytes(hashlib.sha256(f"lane {i}".encode()).digest()[:4], "big") % (PRIME - 1000) + 500 for i in range(LANES)]

_ROW = [pa.field("part", pa.int32()), pa.field("key", pa.int64()), pa.field("position", pa.int64()), pa.field("n_bytes", pa.int64())]
#: Digests of the rows before (q) and with this one (p).
DIGESTS = [f"{side}{i}" for side in "pq" for i in range(LANES)]
SCHEMA = pa.schema([*_ROW, *(pa.field(d, pa.int64()) for d in DIGESTS)])


def _powers(n: int) -> np.ndarray:
    """base ** 0, 1, ... n of each lane."""
    out = np.ones((n + 1, LANES), np.int64)
    have, bases = 1, np.array(BASES, np.int64)
    while have <= n:  # doubled: base ** (have + i) = base ** have * base ** i
        more = min(have, n + 1 - have)
        step = np.array([pow(int(b), have, PRIME) for b in bases], np.int64)
        out[have : have + more] = out[:more] * step % PRIME
        have += more
    return out


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows (key, digest, n_bytes): positions and prefix digests, as if each task's first key began there."""
    part, last, count, state = TaskContext.get().partitionId(), None, 0, np.zeros(LANES, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key").to_numpy()
        lanes = np.frombuffer(b"".join(batch.column("digest").to_pylist()), ">u8").reshape(-1, LANES)
        values = (lanes % np.uint64(PRIME)).astype(np.int64)
        begin = np.flatnonzero(np.append(keys[0] != last, keys[1:] != keys[:-1]))
        new = np.zeros(len(keys), np.int64)
        new[begin] = begin
        first = np.maximum.accumulate(new)  # where the row's key begins in this batch
        goes_on = keys[0] == last
        until = begin[0] if len(begin) else len(keys)
        position = np.arange(len(keys)) - first + 1
        terms = values * _powers(int(position.max()))[position] % PRIME
        total = np.concatenate([np.zeros((1, LANES), np.int64), np.cumsum(terms, axis=0)])
        prefix = (np.concatenate([total[1:], total[:-1]], axis=1) - np.tile(total[first], 2)) % PRIME
        if goes_on:
            shift = np.array([pow(b, count, PRIME) for b in BASES] * 2, np.int64)
            prefix[:until] = (np.tile(state, 2) + prefix[:until] * shift) % PRIME
            position[:until] += count
        last, count, state = keys[-1], int(position[-1]), prefix[-1, :LANES]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), part, np.int32)), batch.column("key"), pa.array(position), batch.column("n_bytes"), *(pa.array(column.copy()) for column in prefix.T)], schema=SCHEMA)


def _carries(lines: list) -> dict[int, tuple[int, int, list[int]]]:
    """For each task whose first key goes on from before: that key, and its rows and digests until then."""
    out, before = {}, None  # before: key, rows, digests
    for line in sorted(lines, key=lambda r: r["part"]):
        own = (line["last_key"], line["last"]["position"], [line["last"][f"p{i}"] for i in range(LANES)])
        if before and before[0] == line["first_key"]:
            out[line["part"]] = before
            if line["first_key"] == own[0]:
                own = (own[0], before[1] + own[1], [(c + pow(b, before[1], PRIME) * p) % PRIME for b, c, p in zip(BASES, before[2], own[2], strict=True)])
        before = own
    return out


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """key, position (from 1), n_bytes, and as ``DIGESTS`` the key's rows with this one and before it, of rows (key, digest, n_bytes and what ``order`` names)."""
    spark = rows.sparkSession
    ship_package(spark)
    # Equal rows may be parted anywhere: a number of their own lets ranges cut between them.
    apart = rows.withColumn("own", F.monotonically_increasing_id())
    dealt = apart.repartitionByRange("key", *order, "own").sortWithinPartitions("key", *order, "own").select("key", "digest", "n_bytes")
    ddl = "part int, key long, position long, n_bytes long, " + ", ".join(f"{d} long" for d in DIGESTS)
    local = materialize(dealt.mapInArrow(_number, ddl), "numbered")
    state = F.struct("position", *(f"p{i}" for i in range(LANES)))
    lines = local.groupBy("part").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.max_by(state, F.struct("key", "position")).alias("last")).collect()  # one a task
    carries = _carries(lines)
    if not carries:
        return local.drop("part")
    made = [(part, key, n, *digests, *(pow(b, n, PRIME) for b in BASES)) for part, (key, n, digests) in carries.items()]
    names = ["part", "key", "rows", *(f"c{i}" for i in range(LANES)), *(f"s{i}" for i in range(LANES))]
    carry = spark.createDataFrame(made, ", ".join(f"{n} {'int' if n == 'part' else 'long'}" for n in names))
    joined = local.join(F.broadcast(carry), ["part", "key"], "left")  # a row a task at most
    goes_on = F.col("rows").isNotNull()
    whole = [F.when(goes_on, (F.col(f"c{d[1]}") + F.col(f"s{d[1]}") * F.col(d)) % PRIME).otherwise(F.col(d)).alias(d) for d in DIGESTS]
    return joined.select("key", (F.col("position") + F.coalesce("rows", F.lit(0))).alias("position"), "n_bytes", *whole)
