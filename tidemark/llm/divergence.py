"""Source divergence audit: how far the sources of a language are apart in their terms.

* *Duplicate texts collapse.* Rows are told apart by language and SHA-256 of the text.
  A task first puts equal texts of a bounded stretch of its rows together, with the
  number of times each source has them; then texts are dealt by language and digest,
  and what remains of equal ones meets in order. So a text that a third of all rows
  hold arrives once a stretch, and each distinct text is cut into terms once.
* Its term counts, times a source's copies, are the source's counts; its copies are
  what it adds to a term's document frequency. Both are summed by Spark, first in tasks.
* A term that enough documents of a language hold is kept, as one row with the counts
  of the sources that have it (at most a number for each source).
* *Pairs* are evaluated term by term on those rows: tasks hold blocks of at most
  ``BLOCK`` x ``BLOCK`` sources, fill in the share of a source without the term, and
  sum absolute differences; a block's terms are dealt over ``BUCKETS`` groups.

The only thing that is held by every task is each source's number of terms: as many
rows as there are groups, where the result has the square of that for each language.

All arithmetic is in integers. Results in special cases: null text, lang or source
count as empty; a group whose texts have no terms, or a language that keeps none, has
pairs of value 0 (or by its smoothed shares) and no term rows; a language's only source
has no pair rows; repeated rows count as often as they occur; ties go to the smaller
item in UTF-8; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.terms import summed, terms_of
from tidemark.llm.text_batches import column, give_back
from tidemark.session import materialize, ship_package

LEAST_DOCS, MOST_TERMS, SCALE, SMOOTH = 30, 50, 1_000_000_000, 5
#: Text that a task gathers before it puts equal ones together, text cut into terms at a time, (source, term) counts worked out at a time.
GATHER_BYTES, CUT_BYTES, MOST_COUNTS = 16_000_000, 12_000_000, 4_000_000
#: Sources in a block of pairs, groups that a block's terms are dealt over, differences worked out at a time.
BLOCK, BUCKETS, MOST_CELLS = 512, 64, 4_000_000

#: Texts travel packed, as their bytes are most of what is dealt.
COPIES = "lang string, digest binary, packed binary, n_bytes long, sources array<string>, copies array<long>"
COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (lang, source, digest, text): one for each distinct text of a stretch, with its sources and their copies."""

    def together(rows: pa.Table) -> pa.RecordBatch:
        found: dict[tuple, tuple[int, Counter]] = {}
        for i, (lang, source, digest) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("lang", "source", "digest")), strict=True)):
            found.setdefault((lang, digest), (i, Counter()))[1][source] += 1
        first = rows.take(pa.array([i for i, _ in found.values()], pa.int64())).combine_chunks()
        texts = first.column("text").cast(pa.binary()).to_pylist()
        made = [
            pa.array([pa.compress(t, codec="zstd", asbytes=True) for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([list(c) for _, c in found.values()], pa.list_(pa.string())), pa.array([list(c.values()) for _, c in found.values()], pa.list_(pa.int64())),
        ]
        kept = [first.column(c).combine_chunks() for c in ("lang", "digest")]
        return pa.RecordBatch.from_arrays([*(k.chunk(0) if isinstance(k, pa.ChunkedArray) else k for k in kept), *made], names=["lang", "digest", "packed", "n_bytes", "sources", "copies"])

    gathered, size = [], 0
    for batch in batches:
        total, begin = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while begin < batch.num_rows:
            room = (total[begin - 1] if begin else 0) + GATHER_BYTES - size
            end = max(begin + 1, int(np.searchsorted(total, room, side="right")))
            gathered.append(batch.slice(begin, end - begin))
            size += int(total[end - 1] - (total[begin - 1] if begin else 0))
            begin = end
            if size >= GATHER_BYTES or begin < batch.num_rows:
                yield together(pa.Table.from_batches(gathered))
                gathered, size = [], 0
    if gathered:
        yield together(pa.Table.from_batches(gathered))
    give_back()


def _counts(texts: pa.Array, langs: list[str], copies: list[Counter]) -> Iterator[pa.RecordBatch]:
    """Counts and document frequencies by language, source and term of distinct texts and their copies."""
    terms, codes, owner = terms_of(texts)
    if not len(codes):
        return
    width = len(terms)
    terms = terms.view(pa.string())
    keys, times = summed(owner * width + codes, np.ones(len(codes), np.int64))
    owner, codes = keys // width, keys % width
    groups: dict[tuple[str, str], int] = {}
    numbers = [[groups.setdefault((lang, source), len(groups)) for source in c] for lang, c in zip(langs, copies, strict=True)]
    n_sources = np.fromiter(map(len, numbers), np.int64, len(numbers))
    flat_group = np.fromiter((g for row in numbers for g in row), np.int64, int(n_sources.sum()))
    flat_times = np.fromiter((t for c in copies for t in c.values()), np.int64, len(flat_group))
    first = np.cumsum(n_sources) - n_sources
    names = [pa.array([g[i] for g in groups], pa.string()) for i in (0, 1)]
    ends, begin = np.cumsum(n_sources[owner]), 0
    while begin < len(owner):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + MOST_COUNTS, side="right")))
        each = n_sources[owner[begin:end]]
        place = np.repeat(first[owner[begin:end]] - np.cumsum(each) + each, each) + np.arange(int(each.sum()))
        key, n, docs = summed(flat_group[place] * width + np.repeat(codes[begin:end], each), flat_times[place] * np.repeat(times[begin:end], each), flat_times[place])
        group = pa.array(key // width)
        yield pa.RecordBatch.from_arrays([names[0].take(group), names[1].take(group), terms.take(pa.array(key % width)), pa.array(n), pa.array(docs)], schema=COUNTS)
        begin = end


def _tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows as ``COPIES`` by language and digest: counts by language, source and term, each distinct text cut once."""
    last, langs, copies, parts, size = None, [], [], [], 0

    def counted(until: int) -> Iterator[pa.RecordBatch]:
        nonlocal langs, copies, parts, size
        texts = pa.concat_arrays(parts)
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < until:
            end = min(until, max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + CUT_BYTES, side="right"))))
            yield from _counts(texts.slice(begin, end - begin), langs[begin:end], copies[begin:end])
            begin = end
        langs, copies, parts, size = langs[until:], copies[until:], [texts.slice(until)] if until < len(texts) else [], 0

    for batch in batches:
        new = []
        for i, (lang, digest, sources, times) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lang", "digest", "sources", "copies")), strict=True)):
            if (lang, digest) != last:
                last = (lang, digest)
                langs.append(lang)
                copies.append(Counter())
                new.append(i)
            for source, n in zip(sources, times, strict=True):
                copies[-1][source] += n
        if new:
            packed, sizes = batch.column("packed"), batch.column("n_bytes")
            texts = [pa.decompress(packed[i].as_py(), sizes[i].as_py(), codec="zstd", asbytes=True) for i in new]
            parts.append(pa.array(texts, pa.binary()).view(pa.string()))
            size += sum(map(len, texts))
        if size >= CUT_BYTES and len(langs) > 1:
            yield from counted(len(langs) - 1)  # the last text may have more copies to come
    if parts:
        yield from counted(len(langs))
    give_back()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with the term)."""
    ship_package(docs.sparkSession)
    plain = docs.select(*(F.coalesce(column(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    named = plain.select("lang", "source", F.unhex(F.sha2("text", 256)).alias("digest"), "text")
    copies = named.mapInArrow(_collapse, COPIES).repartition("lang", "digest").sortWithinPartitions("lang", "digest")
    counts = copies.mapInArrow(_tokenize, "lang string, source string, term string, n long, docs long")
    return counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term, total and cells (source, n) of each term that enough documents of its language hold."""
    of_term = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("cells"))
    return of_term.where(F.col("docs") >= least_docs).drop("docs")


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (n + SMOOTH * v)), exact beyond 64 bits."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(count + SMOOTH), wide(n + SMOOTH * v))


def shares(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The same of arrays; ``whole`` is n + SMOOTH * v."""
    if counts.max(initial=0) + SMOOTH < np.iinfo(np.int64).max // SCALE:
        return 1 + SCALE * (counts + SMOOTH) // whole
    return (1 + SCALE * (counts.astype(object) + SMOOTH) // whole.astype(object)).astype(np.int64)


def _pairs(langs: dict[str, tuple[list[str], np.ndarray]]):
    """Of rows (lang, i, j, cells) by language and blocks: sums of differences of the blocks' pairs. ``langs``: sources and their n + SMOOTH * v."""

    def block(lang: str, i: int, j: int, lists: list[pa.Array]) -> np.ndarray:
        names, whole = langs[lang]
        number = {s: k for k, s in enumerate(names)}
        sides = [slice(b * BLOCK, min(len(names), (b + 1) * BLOCK)) for b in (i, j)]
        total = np.zeros(tuple(s.stop - s.start for s in sides), np.int64)
        for cells in lists:
            sizes, flat = cells.value_lengths().to_numpy(zero_copy_only=False), cells.flatten()
            sources = flat.field("source").dictionary_encode()
            at = np.array([number[s] for s in sources.dictionary.to_pylist()], np.int64)[sources.indices.to_numpy()]
            value = shares(flat.field("n").to_numpy(), whole[at])
            row = np.repeat(np.arange(len(sizes)), sizes)
            step = max(1, MOST_CELLS // max(1, total.size))
            for begin in range(0, len(sizes), step):
                rows = min(step, len(sizes) - begin)
                both = []
                for s in sides:
                    table = np.tile(shares(np.zeros(s.stop - s.start, np.int64), whole[s]), (rows, 1))
                    mine = (row >= begin) & (row < begin + rows) & (at >= s.start) & (at < s.stop)
                    table[row[mine] - begin, at[mine] - s.start] = value[mine]
                    both.append(table)
                total += np.abs(both[0][:, :, None] - both[1][:, None, :]).sum(axis=0)
        return total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present, total = None, None

        def out() -> Iterator[pa.RecordBatch]:
            lang, i, j = present
            names, (a, b) = langs[lang][0], np.indices(total.shape)
            a, b, value = (a + i * BLOCK).ravel(), (b + j * BLOCK).ravel(), total.ravel()
            a, b, value = a[a != b], b[a != b], value[a != b]
            ways = [(a, b)] if i == j else [(a, b), (b, a)]
            for x, y in ways:
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(x), pa.string()), "source": pa.array([names[k] for k in x.tolist()], pa.string()), "item": pa.array([names[k] for k in y.tolist()], pa.string()), "value": pa.array(value)})

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("lang", "i", "j")), strict=True))
            edges = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if keys[a] != present:
                    if present:
                        yield from out()
                    present, total = keys[a], 0
                total = total + block(*present, [batch.column("cells").slice(a, b - a)])
        if present:
            yield from out()
        give_back()

    return run


def divergence(spark: SparkSession, docs: DataFrame, least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    terms = materialize(kept_terms(term_counts(docs), least_docs), "terms")
    of_lang = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    of_group = terms.select("lang", F.inline("cells")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    occurring = docs.select(*(F.coalesce(column(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    groups = materialize(occurring.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").select("lang", "source", zero("n"), zero("v"), zero("n_lang")), "groups")

    # As many rows as groups, where the result has their square for each language.
    langs: dict[str, tuple[list[str], list[int]]] = {}
    for g in groups.where("v > 0").orderBy("lang", "source").collect():
        names, whole = langs.setdefault(g["lang"], ([], []))
        names.append(g["source"])
        whole.append(g["n"] + SMOOTH * g["v"])
    blocks = [(lang, i, j) for lang, (names, _) in langs.items() for j in range(-(-len(names) // BLOCK)) for i in range(j + 1)]
    of_block = terms.join(spark.createDataFrame(blocks, "lang string, i int, j int"), "lang").withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)))
    dealt = of_block.select("lang", "i", "j", "bucket", "cells").repartition("lang", "i", "j", "bucket").sortWithinPartitions("lang", "i", "j")
    ready = {lang: (names, np.array(whole, np.int64)) for lang, (names, whole) in langs.items()}
    sums = dealt.select("lang", "i", "j", "cells").mapInArrow(_pairs(ready), "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    without = groups.where("v = 0").select("lang", "source")
    nothing = without.join(without.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = sums.unionByName(nothing).withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))

    cells = terms.select("lang", "term", "total", F.inline("cells")).join(groups.withColumnRenamed("n", "whole"), ["lang", "source"])
    above = cells.select("lang", "source", F.col("term").alias("item"), (share(F.col("n"), F.col("whole"), F.col("v")) - share(F.col("total"), F.col("n_lang"), F.col("v"))).alias("value")).where("value > 0")
    top = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most_terms).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(columns).unionByName(top.select(columns))
