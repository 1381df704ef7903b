"""Bitmaps of ids: which rows may have an id that a table holds, told without dealing out the rows.

A bitmap has a fixed number of bits and goes to every task, 8 MB at most. An id sets the
bit of its hash. A row whose bit isn't set is told for certain; of the others some may
have another id with the same hash, the more of them the more ids there are, so an
exact join of what is left follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text_batches import column

BITS = 1 << 26


def bitmap(ids: DataFrame, name: str) -> DataFrame:
    """(part, bits) of a table with one column of ids."""
    place = (F.pmod(F.xxhash64(column(ids.columns[0]).cast("long")), F.lit(BITS)) + 1).alias("place")
    placed = ids.select(place).select(F.bitmap_bucket_number("place").alias("part"), F.bitmap_bit_position("place").alias("at"))
    return placed.groupBy("part").agg(F.bitmap_construct_agg("at").alias(name))


def having(rows: DataFrame, key: str, **ids: DataFrame) -> DataFrame:
    """Each row as a struct, ``row``, and a flag for each table of ids: false if it doesn't hold the row's id, else true, and true for some others.

    The flag of a row without an id is false.
    """
    place = F.pmod(F.xxhash64(column(key).cast("long")), F.lit(BITS)) + 1
    found = rows.select(F.struct(*map(column, rows.columns)).alias("row"), F.when(column(key).isNotNull(), F.bitmap_bucket_number(place)).alias("part"), F.bitmap_bit_position(place).alias("at"))
    for name, table in ids.items():
        found = found.join(F.broadcast(bitmap(table, name)), "part", "left")
    byte = "cast(conv(hex(substring({0}, cast(at div 8 as int) + 1, 1)), 16, 10) as int)"
    flags = [F.expr(f"coalesce((shiftright({byte.format(name)}, cast(at % 8 as int)) & 1) = 1, false)").alias(name) for name in ids]
    return found.select("row", *flags)
