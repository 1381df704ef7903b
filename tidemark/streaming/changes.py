"""Regime changes of a stream of scans, with a value of state for each symbol that expires.

A run's scan replaces the one before whole: a symbol that a run doesn't have is
forgotten, so its regime two runs later is no change. The state is the regime and the
run it is of; a row is a change only if the state is of the run just before. The value
also has a time to live, so that symbols that never come back leave the store.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The process that sets a stream's state up imports no shipped packages: what it needs goes along whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHANGE = "symbol string, run long, prev_regime_id int, regime_id int"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: What a query started on ``regime_changes`` needs: a store with several values a key, and no batches without data (times to live would ask for them for ever).
CONF = {PROVIDER: ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


class RegimeChanges(StatefulProcessor):
    """Takes rows (symbol, run, regime_id) of a symbol and gives its changes (``CHANGE``)."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "run long, regime_id int", self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        known = self.last.get() if self.last.exists() else None
        out = []
        batch = pd.concat(list(rows)).dropna(subset=["run", "regime_id"]).sort_values("run", kind="stable").drop_duplicates("run")
        for run, regime in zip(batch["run"].astype(int), batch["regime_id"].astype(int), strict=True):
            if known and run <= known[0]:
                continue  # a run that has been seen
            if known and known[0] == run - 1 and known[1] != regime:
                out.append((key[0], run, known[1], regime))
            known = (run, regime)
        if known:
            self.last.update(known)
        yield pd.DataFrame(out, columns=["symbol", "run", "prev_regime_id", "regime_id"])

    def close(self) -> None:
        pass


def regime_changes(scans: DataFrame, keep_days: int = 7) -> DataFrame:
    """Changes of a stream of scans (symbol, run, regime_id); runs are numbered without gaps and come in order.

    The query that is started on it needs the settings ``CONF``. A symbol's state is dropped when no run
    has had it for ``keep_days``.
    """
    keyed = scans.select("symbol", "run", "regime_id").groupBy("symbol")
    return keyed.transformWithStateInPandas(RegimeChanges(keep_days * 86_400_000), CHANGE, "Append", "ProcessingTime")
