"""How operators in Python walk over texts: Arrow batches in, Arrow batches out.

Columns that an operator only passes on go by their places, so that no name they
have can clash with the operator's own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from tidemark.session import ship_package

#: Rows and characters that one output batch gathers at most before it goes out (a single longer text makes a batch of its own).
BATCH_ROWS, BATCH_CHARS = 2_000, 2_000_000


def column(name: str) -> Column:
    """The column of that very name, whatever signs it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_slices(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of ``batch`` of bounded size with their texts; a null text counts as empty."""
    texts = batch.column(text)
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    begin, size = 0, 0
    for i, n in enumerate(lengths):
        if i > begin and (i - begin >= BATCH_ROWS or size + n > BATCH_CHARS):
            yield batch.slice(begin, i - begin), [t or "" for t in texts.slice(begin, i - begin).to_pylist()]
            begin, size = i, 0
        size += n
    if begin < len(lengths):
        yield batch.slice(begin), [t or "" for t in texts.slice(begin).to_pylist()]


def give_back() -> None:
    """Return freed memory to the machine at a task's end: Spark keeps the worker, and the executor's next tasks share its memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def map_batches(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], docs: DataFrame, keep: tuple[str, ...], text: str, made: pa.Schema) -> DataFrame:
    """Columns ``keep``, then those of ``made``, by ``mapInArrow``; a kept column with the name of a made one is left out.

    ``run`` gets the kept columns as c0, c1, ... and the text as t, and yields c0, c1, ... and the made columns.
    """
    ship_package(docs.sparkSession)
    keep = tuple(c for c in keep if c not in made.names)
    given = docs.select(*(column(c).alias(f"c{i}") for i, c in enumerate(keep)), column(text).alias("t"))
    schema = StructType([*given.schema.fields[:-1], *from_arrow_schema(pa.schema([(f"m{i}", f.type) for i, f in enumerate(made)])).fields])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=schema.names)
        give_back()

    return given.mapInArrow(named, schema).toDF(*keep, *made.names)


def map_texts(fn: Callable[[list[str]], dict[str, list]], docs: DataFrame, keep: tuple[str, ...], text: str, made: pa.Schema) -> DataFrame:
    """Columns ``keep`` as they are, then those that ``fn`` makes from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "t"):
                found = fn(texts)
                columns = [*part.columns[:-1], *(pa.array(found[f.name], f.type) for f in made)]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names[:-1], *made.names])

    return map_batches(run, docs, keep, text, made)
