"""All registered queries of the library's own operators."""

from __future__ import annotations

import tidemark.sources.fixtures  # noqa: F401
import tidemark.operators.windows  # noqa: F401
import tidemark.operators.strategies  # noqa: F401
import tidemark.operators.screening  # noqa: F401
import tidemark.sources.bars  # noqa: F401
import tidemark.operators.options  # noqa: F401
import tidemark.operators.journal  # noqa: F401
import tidemark.operators.backtest  # noqa: F401
import tidemark.operators.hmm  # noqa: F401
import tidemark.operators.table_functions  # noqa: F401
import tidemark.sources.snapshots  # noqa: F401
import tidemark.streaming.queries  # noqa: F401
from tidemark.plans.catalog import oracle_sql, queries, run

__all__ = ["oracle_sql", "queries", "run"]
