"""Named relations: each is SQL over other named relations and tables.

A relation's text stays within what Spark SQL and DuckDB share, so the same
definition runs on Spark and, as one statement, as the oracle. Where Spark has its
own way (folds over a symbol's bars), a relation has a builder on DataFrames and a
separate oracle text.

Every relation can also be given from outside: ``run(spark, "signal_v1", bars=my_bars)``
computes on the caller's bars instead of those made from the test tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import materialize, read_table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@dataclass(frozen=True)
class Relation:
    sql: str
    build: Callable[..., DataFrame] | None = None
    #: Names that its text reads from, and those that it defines itself.
    named: tuple[str, ...] = field(default=())
    own: frozenset[str] = frozenset()
    #: Written to the shared folder and read back on Spark: for what several others build on.
    stored: bool = False
    #: What its text reads but its builder goes around: where one of these is given, the text counts.
    around: frozenset[str] = frozenset()

    @property
    def uses(self) -> tuple[str, ...]:
        """The relations and tables that its text reads from, whichever module was imported first."""
        return tuple(w for w in self.named if w in RELATIONS or (w in TABLES and w not in self.own))


RELATIONS: dict[str, Relation] = {}
QUERIES: list[str] = []


def relation(name: str, sql: str, build: Callable[..., DataFrame] | None = None, stored: bool = False, around: tuple[str, ...] = ()) -> None:
    """Define a relation; what it uses is read off its text."""
    words = dict.fromkeys(re.findall(r"\b(?:from|join)\s+([a-z_][a-z0-9_]*)", sql.lower()))
    own = frozenset(re.findall(r"\b([a-z_][a-z0-9_]*)(?:\([a-z0-9_, ]*\))?\s+as\s+\(\s*select", sql.lower()))
    RELATIONS[name] = Relation(sql.strip(), build, tuple(words), own, stored, frozenset(around))


def query(name: str, sql: str, build: Callable[..., DataFrame] | None = None, around: tuple[str, ...] = ()) -> None:
    """Define a relation that is registered as a query."""
    relation(name, sql, build, around=around)
    QUERIES.append(name)


def _order(name: str, given: set[str], spark: bool, seen: dict[str, None], top: bool = False) -> None:
    """The relations that ``name`` rests on, each after what it uses."""
    if name in TABLES or name in seen or name in given:
        return
    r = RELATIONS[name]
    if not (spark and (r.build or r.stored) and not top):
        for used in r.uses:
            _order(used, given, spark, seen)
    seen[name] = None


def oracle(name: str) -> str:
    """One DuckDB statement for a query."""
    seen: dict[str, None] = {}
    _order(name, set(), False, seen)
    parts = [f"{n} as ({RELATIONS[n].sql})" for n in seen if n != name]
    body = RELATIONS[name].sql
    return (f"with recursive {', '.join(parts)} " if parts else "") + f"select * from ({body}) as result"


def run(spark: SparkSession, name: str, sf_dir: str | None = None, _made: dict[str, DataFrame] | None = None, **given: DataFrame) -> DataFrame:
    """The relation ``name`` on Spark, from the tables of ``sf_dir`` or from relations given by name."""
    if name in given:
        return given[name]
    if name in TABLES:
        if sf_dir is None:
            raise ValueError(f"{name} is neither given nor in a folder of tables")
        return read_table(spark, sf_dir, name)
    made = {} if _made is None else _made
    r = RELATIONS[name]
    if name in made:
        return made[name]
    if r.build and not r.around & given.keys():
        made[name] = r.build(lambda used: run(spark, used, sf_dir, made, **given))
        return made[name]
    seen: dict[str, None] = {}
    _order(name, set(given), True, seen, top=True)
    inputs: dict[str, DataFrame] = {}
    parts = []
    for n in seen:
        if n != name and (RELATIONS[n].build or RELATIONS[n].stored):
            inputs[n] = run(spark, n, sf_dir, made, **given)
        elif n != name:
            parts.append(n)
    for n in {u for m in seen if m == name or not (RELATIONS[m].build or RELATIONS[m].stored) for u in RELATIONS[m].uses}:
        if n in given or n in TABLES:
            inputs[n] = run(spark, n, sf_dir, made, **given)
    plain = lambda sql: sql.replace("{", "{{").replace("}", "}}")
    ctes = [f"{n} as (select * from {{{n}}})" for n in inputs] + [f"{n} as ({plain(RELATIONS[n].sql)})" for n in parts]
    text = (f"with {', '.join(ctes)} " if ctes else "") + f"select * from ({plain(r.sql)}) as result"
    result = spark.sql(text, **inputs) if inputs else spark.sql(text.replace("{{", "{").replace("}}", "}"))
    if r.stored:
        made[name] = result = materialize(result, name)
    return result


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def of(name: str) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: run(spark, name, sf_dir)

    return {name: of(name) for name in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: oracle(name) for name in QUERIES if RELATIONS[name].sql}
