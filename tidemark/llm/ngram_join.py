"""N-gram Jaccard join of documents, exact, by a prefix-tree join.

A document's set is its distinct 5-word shingles, each as a 64-bit hash. Two
documents link when 100 * |A n B| >= 75 * |A u B|; the result is each document's
component of links. The stages:

1. *Sets.* Documents with equal sets are one class from here on, so a group of
   copies costs what one document does. A class is known by a hash of its set.
2. *Which sets can link at all.* An overlap is at least 3/4 of either set, so a
   set can only link when 3/4 of its shingles occur in another set. Tasks first
   settle what repeats within themselves and send each shingle once, as a 32-bit
   remainder in a bucket of shingles, with the number of its set in the task; a
   bucket's task says how many shingles of each set occur elsewhere, and the answers
   meet by the sending task. Two shingles with one remainder only make a set stay.
3. *Near copies.* Sets with the same least hash, under either of two permutations, are
   joined over a trie (``trie_join``); most links lie within such a group. A large group
   is dealt in chunks, each with the group's least set.
4. *What is left.* Stage 2 again, for components instead of sets: a component of which
   too few shingles occur in another has no link that is missing. Passages that many
   documents share end here.
5. *Blocks.* What is left is linked to the least set with which it shares one of the
   ``n - ceil(3 n / 4) + 1`` first shingles in a global order, rare ones first; linked
   sets have one in common, so they end in one component of these edges, a block. Blocks
   are joined over tries. A large block falls into the groups of sets that share such a
   shingle, if that sends fewer shingles than all pairs of its chunks.
6. *Components* of all links, then of the documents.

No stage emits pairs of documents: edges are at most one a set (stages 3 and 5) or one a
set and shingle (blocks). A 64-bit hash stands for a shingle and for a set.

Results in special cases: a text without words (or null) has an empty set, links
with nothing and is its own component; repeated rows are one class; a row with a
null ``doc_id`` takes no part and gets a null component; an empty table gives no
rows; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.id_bitmaps import having
from tidemark.llm.text_batches import column, give_back, text_slices
from tidemark.llm.trie_join import block_links
from tidemark.session import materialize, ship_package

WORDS = 5
#: Characters of text for each bucket of shingles; shingles that a task settles at a time; shingles in a chunk of a block.
BUCKET_CHARS, SETTLE_SHINGLES, CHUNK_SHINGLES = 16_000_000, 1_500_000, 400_000
#: Distinct words whose hashes a worker remembers.
MEMO_WORDS = 400_000

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit over the whole word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: One for each permutation of the shingles.
_SALTS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a number of words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMO_WORDS:
            self[word] = h
        return h


def shingle_set(text: str, hashes: WordHashes, k: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's k-word shingles (of all its words, if fewer)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: only A-Z changes, only ASCII white space splits
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    total = np.full(n, min(len(h), k), np.uint64)
    for j in range(min(len(h), k)):
        total += h[j : j + n] * _MULTIPLIERS[j % 5]
        total = (total << np.uint64(7)) | (total >> np.uint64(57))
    return np.unique(_mixed(total))


def set_hash(grams: np.ndarray) -> int:
    import xxhash

    return int(np.array(xxhash.xxh3_64_intdigest(grams.tobytes()), np.uint64).view(np.int64))


#: What a task sends of a number of sets that it settles together: a row for each bucket (its shingles by owner), and one that passes through for the owners.
SENT = pa.schema([
    ("flush", pa.int64()), ("bucket", pa.int32()), ("places", pa.binary()), ("sizes", pa.binary()), ("names", pa.binary()), ("grams", pa.binary()),
    ("doc_ids", pa.list_(pa.int64())), ("fps", pa.binary()), ("counts", pa.binary()), ("hits", pa.binary()),
])
SENT_SQL = "flush long, bucket int, places binary, sizes binary, names binary, grams binary, doc_ids array<long>, fps binary, counts binary, hits binary"
#: What comes back: of each bucket how many shingles of each owner others have too, and the owners' row.
BACK = ("flush", "places", "hits", "doc_ids", "fps", "counts")
BACK_SQL = "flush long, places binary, hits binary, doc_ids array<long>, fps binary, counts binary"
#: Owners that a task settles at a time at most; their places, from 1 on, take two bytes. The place 0 means no owner.
MOST_OWNERS, NOBODY = 50_000, 0


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on in as many bytes each as the largest takes; the first byte says how many."""
    most = int(numbers.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _row(**values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in SENT], schema=SENT)


def _unsettled(n_owners: int, sets: list[tuple[int, np.ndarray]], buckets: int, flush: int, names: np.ndarray | None = None) -> tuple[np.ndarray, list[pa.RecordBatch]]:
    """Of sets (place among the owners, shingles): how many shingles of each owner another one here has too, and rows with the rest.

    A shingle that several owners here have is sent once, without an owner. ``names`` are given where an owner may
    come in other tasks too: what it sends from there is then known as its own, and hashes are sent whole.
    """
    if not sets:
        return np.zeros(n_owners, np.int64), []
    place = np.repeat(np.array([p for p, _ in sets], np.int64), [len(s) for _, s in sets])
    grams = np.concatenate([s for _, s in sets])
    order = np.lexsort((place, grams))
    grams, place = grams[order], place[order]
    distinct = np.concatenate([[True], (grams[1:] != grams[:-1]) | (place[1:] != place[:-1])])
    grams, place = grams[distinct], place[distinct]
    new = np.concatenate([[True], grams[1:] != grams[:-1]])
    alone = new & np.concatenate([new[1:], [True]])
    hits = np.bincount(place[~alone], minlength=n_owners)
    sent = np.where(alone, place + 1, NOBODY)[new]
    grams = grams[new]
    to = (grams >> np.uint64(32)) % np.uint64(buckets)
    order = np.lexsort((sent, to))
    grams, sent, to = grams[order], sent[order], to[order]
    edges = np.searchsorted(to, np.arange(buckets + 1, dtype=np.uint64))
    rows = []
    for b in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
        own, sizes = np.unique(sent[edges[b] : edges[b + 1]], return_counts=True)
        known = None if names is None else names[np.maximum(own - 1, 0)].astype("<i8").tobytes()
        low = grams[edges[b] : edges[b + 1]]
        if names is None:
            low = (low & np.uint64(0xFFFFFFFF)).astype("<u4")
        rows.append(_row(flush=flush, bucket=b, places=_packed(np.diff(own, prepend=0)), sizes=_packed(sizes), names=known, grams=low.tobytes()))
    return hits, rows


def _owner_row(flush: int, buckets: int, doc_ids: list, fps: np.ndarray, counts: list[int], hits: np.ndarray) -> pa.RecordBatch:
    # It only passes through a bucket.
    return _row(flush=flush, bucket=int(_mixed(np.array([flush], np.uint64))[0] % np.uint64(buckets)), doc_ids=doc_ids, fps=fps.astype("<i8").tobytes(), counts=np.array(counts, "<i8").tobytes(), hits=hits.astype("<i8").tobytes())


def _first_flush() -> int:
    """The first of this task's numbers."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return (context.partitionId() if context else 0) << 32


def _profile(buckets: int):
    """What is known of documents and, for each bucket, the shingles of sets (``SENT``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, flush = WordHashes(), set(), _first_flush()
        doc_ids: list[int | None] = []
        fps: list[int] = []
        counts: list[int] = []
        sets: list[tuple[int, np.ndarray]] = []
        gathered = 0

        def settled() -> Iterator[pa.RecordBatch]:
            hits, rows = _unsettled(len(fps), sets, buckets, flush)
            yield from rows
            yield _owner_row(flush, buckets, doc_ids, np.array(fps, np.int64), counts, hits)

        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                    grams = shingle_set(text, hashes)
                    fp = set_hash(grams)
                    if len(grams) and doc_id is not None and fp not in seen:
                        seen.add(fp)
                        sets.append((len(fps), grams))
                        gathered += len(grams)
                    doc_ids.append(doc_id)
                    fps.append(fp)
                    counts.append(len(grams))
                    if gathered >= SETTLE_SHINGLES or len(fps) >= MOST_OWNERS:
                        yield from settled()
                        doc_ids, fps, counts, sets, gathered, flush = [], [], [], [], 0, flush + 1
        if fps:
            yield from settled()
        hashes.clear()
        doc_ids, fps, counts, sets = [], [], [], []
        give_back()

    return run


def _profile_components(buckets: int):
    """As ``_profile``, with components (component, n, grams) as the owners; n is the size of a component's smallest set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flush = _first_flush()
        place: dict[int, int] = {}
        least: list[int] = []
        sets: list[tuple[int, np.ndarray]] = []
        gathered = 0

        def settled() -> Iterator[pa.RecordBatch]:
            owners = np.array(list(place), np.int64)
            hits, rows = _unsettled(len(owners), sets, buckets, flush, owners)
            yield from rows
            yield _owner_row(flush, buckets, [None] * len(owners), owners, least, hits)

        for batch in batches:
            for component, n, data in zip(*(batch.column(c).to_pylist() for c in ("component", "n", "grams")), strict=True):
                i = place.setdefault(component, len(place))
                if i == len(least):
                    least.append(n)
                least[i] = min(least[i], n)
                sets.append((i, np.frombuffer(data, "<u8")))
                gathered += n
                if gathered >= SETTLE_SHINGLES or len(place) >= MOST_OWNERS:
                    yield from settled()
                    place, least, sets, gathered, flush = {}, [], [], 0, flush + 1
        if sets:
            yield from settled()
        place, least, sets = {}, [], []
        give_back()

    return run


def _settle(table: pa.Table) -> pa.Table:
    """Of one bucket: for each task's owners how many of their shingles here others have too; the owners' rows as they are."""
    is_owner = pc.is_valid(table.column("fps"))
    passing = table.filter(is_owner).select([c for c in BACK if c != "places"])
    passing = passing.add_column(1, "places", pa.nulls(passing.num_rows, pa.binary()))
    rows = table.filter(pc.invert(is_owner))
    grams, places, sources, names = [], [], [], []
    for i, (place, sizes, name, low) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("places", "sizes", "names", "grams")), strict=True)):
        sizes = _unpacked(sizes)
        places.append(np.repeat(np.cumsum(_unpacked(place)), sizes))
        grams.append(np.frombuffer(low, f"<u{len(low) // len(places[-1])}"))
        sources.append(np.full(len(grams[-1]), i, np.int32))
        names.append(np.repeat(np.frombuffer(name, "<i8"), sizes) if name is not None else i * (1 << 16) + places[-1])
    if not grams:
        return passing.select(BACK)
    grams, places, sources, names = (np.concatenate(x) for x in (grams, places, sources, names))
    owned = places != NOBODY
    order = np.lexsort((sources, names, owned, grams))
    grams, places, sources, names, owned = grams[order], places[order], sources[order], names[order], owned[order]
    # What one owner sent from several tasks is one shingle of it: that of the first. Without an owner, it repeats anyhow.
    begins = np.concatenate([[True], (grams[1:] != grams[:-1]) | (names[1:] != names[:-1]) | (owned[1:] != owned[:-1])])
    distinct = ~owned | (sources == sources[np.maximum.accumulate(np.where(begins, np.arange(len(begins)), 0))])
    grams, places, sources, owned = grams[distinct], places[distinct], sources[distinct], owned[distinct]
    new = np.concatenate([[True], grams[1:] != grams[:-1]])
    # A shingle without an owner repeats within its task: whoever else has it has it repeated.
    repeated = ~(new & np.concatenate([new[1:], [True]])) & owned
    keys, hits = np.unique(sources[repeated].astype(np.int64) << 16 | places[repeated], return_counts=True)
    source, place, flushes = keys >> 16, keys & 0xFFFF, rows.column("flush").to_numpy()
    edges = [0, *(np.flatnonzero(source[1:] != source[:-1]) + 1).tolist(), len(source)] if len(source) else [0]
    cuts = list(zip(edges, edges[1:], strict=False))
    none = pa.nulls(len(cuts), pa.binary())
    back = [pa.array([flushes[source[a]] for a, _ in cuts], pa.int64()), pa.array([_packed(np.diff(place[a:b], prepend=0)) for a, b in cuts], pa.binary()), pa.array([_packed(hits[a:b]) for a, b in cuts], pa.binary()), pa.nulls(len(cuts), pa.list_(pa.int64())), none, none]
    return pa.concat_tables([passing.select(BACK), pa.table(back, names=list(BACK))], promote_options="permissive")


def _add_up(table: pa.Table) -> pa.Table:
    """(doc_id, fp, n, hits) of the owners that a task settled together."""
    owner = table.filter(pc.is_valid(table.column("fps")))
    hits = np.frombuffer(owner.column("hits")[0].as_py(), "<i8").copy()
    others = table.filter(pc.is_valid(table.column("places")))
    for places, found in zip(others.column("places").to_pylist(), others.column("hits").to_pylist(), strict=True):
        hits[np.cumsum(_unpacked(places)) - 1] += _unpacked(found)
    return pa.table({"doc_id": owner.column("doc_ids").combine_chunks().flatten(), "fp": np.frombuffer(owner.column("fps")[0].as_py(), "<i8"), "n": np.frombuffer(owner.column("counts")[0].as_py(), "<i8"), "hits": hits})


def _hits(sent: DataFrame) -> DataFrame:
    """(doc_id, fp, n, hits): for each owner a task has seen, how many of its shingles other owners have."""
    back = sent.groupBy("bucket").applyInArrow(_settle, BACK_SQL)
    return back.groupBy("flush").applyInArrow(_add_up, "doc_id long, fp long, n long, hits long")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """fp, n, two least hashes and the shingles of each text's set."""
    hashes = WordHashes()
    for batch in batches:
        for _, texts in text_slices(batch, "text"):
            sets = [s for s in (shingle_set(t, hashes) for t in texts) if len(s)]
            keys = [[int(_mixed(s ^ salt).min().view(np.int64)) for s in sets] for salt in _SALTS]
            columns = [pa.array([set_hash(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(k, pa.int64()) for k in keys), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["fp", "n", "key_a", "key_b", "grams"])
    hashes.clear()
    give_back()


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, fp) for the shingles of each set."""
    for batch in batches:
        if batch.num_rows:
            grams = np.frombuffer(b"".join(batch.column("grams").to_pylist()), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(np.repeat(batch.column("fp").to_numpy(), batch.column("n").to_numpy()))], names=["gram", "fp"])


def _prefixes(sets: DataFrame) -> DataFrame:
    """(gram, fp) for the first shingles of each set, of those that other sets have too: linked sets share one.

    Shingles in few sets come first. Those of one set alone come before all others and only take up places.
    """
    grams = sets.select("fp", "n", "grams").mapInArrow(_grams, "gram long, fp long")
    shared = grams.groupBy("gram").agg(F.count("*").alias("sets")).where("sets > 1")
    own = Window.partitionBy("fp")
    placed = grams.join(shared, "gram").select("gram", "fp", F.count("*").over(own).alias("shared"), F.row_number().over(own.orderBy("sets", "gram")).alias("place"))
    return placed.join(sets.select("fp", "n").hint("merge"), "fp").where("place <= shared - (3 * n + 3) div 4 + 1").select("gram", "fp")


def _join_group(table: pa.Table) -> pa.Table:
    """Links of the blocks of one group."""
    table = table.combine_chunks().sort_by([("block", "ascending"), ("fp", "ascending")])
    blocks = table.column("block").to_numpy()
    fps = table.column("fp").to_numpy()
    comps = table.column("component").to_pylist()
    data = table.column("grams").to_pylist()
    u, v = [], []
    edges = np.concatenate([[0], np.flatnonzero(blocks[1:] != blocks[:-1]) + 1, [len(blocks)]]) if len(blocks) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        rows = [i for i in range(a, b) if i == a or fps[i] != fps[i - 1]]
        if len(rows) < 2:
            continue
        for i, j in block_links([np.frombuffer(data[r], "<u8") for r in rows], [comps[r] for r in rows]):
            u.append(fps[rows[i]])
            v.append(fps[rows[j]])
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _places(members: DataFrame, groups: int) -> tuple[DataFrame, DataFrame]:
    """Where the sets of ``members`` (block, fp, n, component) are joined, and the blocks that take several chunks.

    Small blocks share a group; the least set of a large block goes to each of its chunks.
    """
    sizes = members.groupBy("block").agg(F.sum("n").alias("total"), F.min("fp").alias("leader"), F.count("*").alias("sets")).where("sets > 1")
    sizes = sizes.select("block", "leader", F.ceil(F.col("total") / CHUNK_SHINGLES).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    places = members.join(sizes, "block").select(
        "block", "fp", "component",
        F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("block"), F.lit(groups))).otherwise(F.col("block")).alias("part"),
        F.explode(F.when(F.col("chunks") == 1, F.array(F.lit(-1))).when(F.col("fp") == F.col("leader"), every).otherwise(F.array(own))).alias("chunk"),
    )
    return places, sizes.where("chunks > 1").select("block", "chunks")


LINK = "u long, v long"


def _near_links(sets: DataFrame, groups: int) -> DataFrame:
    """Links within the groups of sets that have a least hash in common."""
    keyed = sets.select(F.explode(F.array(F.col("key_a"), F.col("key_b"))).alias("block"), "fp", "n", F.col("fp").alias("component")).distinct()
    places, _ = _places(keyed, groups)
    return materialize(places.join(sets.select("fp", "grams").hint("merge"), "fp").groupBy("part", "chunk").applyInArrow(_join_group, LINK), "links")


def _block_links(sets: DataFrame, members: DataFrame, groups: int) -> DataFrame:
    """Links that join, within each block of ``members`` (block, fp, n, component), all ``sets`` (fp, grams) that similarity connects."""
    places, large = _places(members, groups)
    links = materialize(places.join(sets.hint("merge"), "fp").groupBy("part", "chunk").applyInArrow(_join_group, LINK), "links")
    if large.isEmpty():
        return links
    known = links.union(members.select(F.col("fp").alias("u"), F.col("component").alias("v")))
    found = connected_components(known).withColumnRenamed("component", "joined")
    parted = members.join(large, "block").join(found, F.col("fp") == F.col("vertex"), "left")
    parted = parted.select("block", "fp", "chunks", F.coalesce("joined", "component").alias("component"))
    open_blocks = parted.groupBy("block").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("block")
    chunk, every = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"), F.sequence(F.lit(0), F.col("chunks") - 1)
    parted = materialize(parted.join(open_blocks, "block"), "open")
    pairs = parted.select("block", "fp", "component", chunk.alias("chunk"), F.explode(every).alias("other"))
    pairs = pairs.select("block", "fp", "component", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"))
    likely = having(sets, "fp", open=parted.select("fp")).where("open").select("row.*")
    more = pairs.join(likely.hint("merge"), "fp").groupBy("block", "low", "high").applyInArrow(_join_group, LINK)
    return links.union(materialize(more, "links"))


def _left_over(sets: DataFrame, links: DataFrame, buckets: int) -> DataFrame:
    """fp, n, grams, component of the sets, once each, whose component may have links to another."""
    found = connected_components(links).hint("merge")
    component = F.coalesce("component", "fp").alias("component")
    known = sets.select("fp", "n", "grams").join(found, F.col("fp") == F.col("vertex"), "left").select(component, "n", "grams")
    settled = materialize(_hits(known.mapInArrow(_profile_components(buckets), SENT_SQL)), "settled")
    able = settled.groupBy("fp").agg(F.min("n").alias("least"), F.sum("hits").alias("hits")).where("4 * hits >= 3 * least").select(F.col("fp").alias("component"))
    # Only what stays is dealt out once more, and by its own hash alone.
    named = sets.select("fp").join(found, F.col("fp") == F.col("vertex"), "left").select("fp", component)
    named = materialize(named.join(materialize(able, "able").hint("merge"), "component", "left_semi").distinct(), "named")
    likely = having(sets.select("fp", "n", "grams"), "fp", named=named.select("fp")).where("named").select("row.*")
    return materialize(likely.join(named.hint("merge"), "fp").dropDuplicates(["fp"]), "rest")


def _blocks(rest: DataFrame) -> DataFrame:
    """(block, fp, n, component) of sets (fp, n, grams, component): sets of two components that link have a block in common.

    A block of several chunks gives way to the groups of its sets that share a shingle of their prefixes, if these send less.
    Shingles of the same sets make one group.
    """
    prefixes = materialize(_prefixes(rest), "prefixes")
    alike = prefixes.groupBy("gram").agg(F.min("fp").alias("u"), F.max("fp").alias("last"), F.count("*").alias("sets"), F.sum(F.pmod(F.xxhash64("fp"), F.lit(1 << 31))).alias("all"))
    alike = alike.where("u < last").select("gram", "u", F.xxhash64("u", "last", "sets", "all").alias("part"))
    groups = materialize(prefixes.join(alike, "gram").select("part", "u", "fp").distinct(), "groups")
    blocks = connected_components(groups.select("u", F.col("fp").alias("v"))).withColumnRenamed("component", "block")
    members = materialize(rest.select("fp", "n", "component").join(blocks, F.col("fp") == F.col("vertex")).select("block", "fp", "n", "component"), "members")
    sent = F.sum("n") * F.ceil(F.sum("n") / CHUNK_SHINGLES)
    large = members.groupBy("block").agg(sent.alias("whole"), F.sum("n").alias("total")).where(F.col("total") > CHUNK_SHINGLES)
    if large.isEmpty():
        return members
    parts = members.join(large.select("block"), "block").join(groups.select("part", "fp"), "fp")
    # A group within one component has no link that is missing.
    each = parts.groupBy("block", "part").agg(sent.alias("sent"), F.min("component").alias("a"), F.max("component").alias("b")).where("a < b")
    each = materialize(each.select("block", "part", "sent"), "parts")
    split = large.join(each.groupBy("block").agg(F.sum("sent").alias("apart")), "block", "left").where(F.coalesce("apart", F.lit(0)) < F.col("whole"))
    split = materialize(split.select("block"), "split")
    apart = parts.join(split, "block", "left_semi").join(each.select("part"), "part", "left_semi").select(F.col("part").alias("block"), "fp", "n", "component")
    return materialize(members.join(split, "block", "left_anti").union(apart), "members")


def _chosen(docs: DataFrame, able: DataFrame) -> DataFrame:
    """The sets (``_sets``) of the documents whose doc_id is in ``able``."""
    likely = having(docs.select("doc_id", "text"), "doc_id", able=able).where("able").select("row.*")  # only their texts are dealt out
    return likely.join(able, "doc_id", "left_semi").select("text").mapInArrow(_sets, "fp long, n long, key_a long, key_b long, grams binary")


def linked_sets(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, n) of every document, and (vertex, component) of the sets that have links."""
    ship_package(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(chars / BUCKET_CHARS))
    profile = materialize(_hits(docs.mapInArrow(_profile(buckets), SENT_SQL)), "profile")
    each = profile.select("doc_id", "fp", "n")
    # Of copies in several tasks each has the others' shingles as hits: such sets stay, once.
    classes = profile.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("hits").alias("hits"))
    able = materialize(classes.where("n > 0 and 4 * hits >= 3 * n and doc_id is not null").select("doc_id"), "chosen")
    sets = materialize(_chosen(docs, able), "sets")
    near = _near_links(sets, buckets)
    rest = _left_over(sets, near, buckets)
    links = near.union(_block_links(rest.select("fp", "grams"), _blocks(rest), buckets))
    return each, connected_components(links)


def ngram_components(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    each, found = linked_sets(spark, docs)
    least = each.where("n > 0 and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    named = least.join(found, F.col("fp") == F.col("vertex"), "left").withColumn("component", F.coalesce("component", "fp"))
    roots = named.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("copies").alias("members"))
    # Most documents are alone; only classes of components with company are looked up.
    company = named.select("fp", "component").join(roots.where("members > 1"), "component").select("fp", "component_id")
    out = each.join(company, "fp", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents without those that link to one with a smaller doc_id, directly or through others.

    Rows that repeat a doc_id count as one document. Rows with a null doc_id stay.
    """
    found = materialize(ngram_components(spark, docs), "components")
    own = [column(c) for c in docs.columns]
    dropped = materialize(found.where("component_id <> doc_id").select("doc_id").distinct(), "dropped")
    # Bitmaps tell nearly all; only the texts of the others are dealt out. An id that stays has rows that name itself alone.
    told = having(docs, "doc_id", dropped=dropped, own=found.where("component_id = doc_id").select("doc_id"))
    sure, unsure = told.where("not dropped").select("row.*"), told.where("dropped and own").select("row.*")
    kept = sure.union(unsure.join(dropped, "doc_id", "left_anti").select(*own))
    repeats = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeats.isEmpty():
        return kept
    again = kept.join(repeats, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(repeats, "doc_id", "left_anti").select(*own).unionByName(again.select(*own))
