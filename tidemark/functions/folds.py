"""Folds over a symbol's bars in order: recursions that windows can't express.

Bars are dealt by symbol and sorted by Spark (one shuffle, spilling as it must); each
task then passes over its rows once, with the state of the present symbol as all that
is held. The cost is linear in the bars, and a symbol's history need not fit in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.session import materialize, ship_package

#: Takes a bar (its time, then the columns asked for) and gives what the fold makes of it.
Step = Callable[[tuple], tuple]


def fold_bars(bars: DataFrame, columns: list[str], make_step: Callable[[], Step], made: str, key: str = "symbol", order: str = "bar_ts", carried: tuple[str, ...] = (), dealt: bool = False) -> DataFrame:
    """``key``, ``order``, ``columns`` and what a step makes (``made``, a schema) of each bar; a new step begins each symbol.

    ``carried`` columns go along without being seen by a step. ``dealt`` bars are partitioned by ``key`` already.
    """
    ship_package(bars.sparkSession)
    chosen, seen = bars.select(key, order, *columns, *carried), 2 + len(columns)
    given = (chosen if dealt else chosen.repartition(key)).sortWithinPartitions(key, order)
    schema = StructType([*given.schema.fields, *StructType.fromDDL(made).fields])
    types = to_arrow_schema(StructType.fromDDL(made)).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present, step = None, None
        for batch in batches:
            out = []
            for symbol, *bar in zip(*(c.to_pylist() for c in batch.columns[:seen]), strict=True):
                if step is None or symbol != present:
                    present, step = symbol, make_step()
                out.append(step(tuple(bar)))
            if out:
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, zip(*out, strict=True), types)], names=schema.names)

    # Written once: many relations read it.
    return materialize(given.mapInArrow(run, schema), "fold")
