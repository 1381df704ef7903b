"""The trie of conversations' prefixes: what prompts share, and what caching that would save.

1. *Digests.* Turns are numbered and each prefix gets a digest (``prefixes``), on narrow
   rows without texts, so that even a conversation with a third of all turns is spread.
   Rebuilt conversations take their first turns from another one: digests are moved by
   arithmetic, and only those few turns are copied.
2. *Ends.* Conversations that end with the same digest are copies. Their ids are joined
   in pieces, in order, and a task hashes the pieces as they pass; one copy stands for all.
3. *Tails.* Below a node that only one conversation reaches, all is a chain: these rows
   are results as they are. What is left of a sequence is its shared beginning and the
   turn after it, one row a sequence.
4. *Shards.* The sequences are range-partitioned and sorted, which makes any subtree a
   stretch. A task encodes each shard of at most about ``SHARD_NODES`` nodes as balanced
   parentheses, with the least excess of each block in a tree: ``findclose`` gives each
   node's subtree, rank counts its leaf pairs ``()``, and differences of cumulative sums
   give members and savings.
5. *Spines.* Only a shard's first and last path can go on in other shards. Those nodes
   leave with what their subtrees hold beside the spines; equal ones merge by digest,
   and sums along the paths, each spine node counted on one path, complete them.

Node digests have 124 bits. Results in special cases: rows with a null conv_id take no
part; a null turn comes first, equal turns go by the SHA-256 of role and text, repeated
rows are turns of their own; null role or text count as empty; a conversation that ends
up without turns ends at the root; an empty table gives no rows, not even the root;
other columns play no part. A sequence's shared beginning is one row: what must fit into
memory is a shard, or the longest beginning that two conversations share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.prefixes import BASES, LANES, PRIME, numbered
from tidemark.llm.text_batches import column, give_back
from tidemark.session import materialize, ship_package

#: Nodes in a shard (a single longer sequence makes one of its own), places in a block of excesses, characters of ids hashed as a piece.
SHARD_NODES, BLOCK, PIECE = 500_000, 64, 500_000
#: Conversations c to c + FAMILY - 1 share the first of them; at most HEADS - 1 turns are taken from it.
FAMILY, HEADS = 5, 9
NOTHING = hashlib.sha256(b"").hexdigest()


class Parentheses:
    """Balanced parentheses with range min-max blocks over the excess."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(np.where(bits, 1, -1))
        padded = np.full(-(-len(bits) // BLOCK) * BLOCK, np.iinfo(np.int64).max)
        padded[: len(bits)] = self.excess
        least = padded.reshape(-1, BLOCK).min(axis=1)
        self.levels = [least]  # least excess of blocks, of pairs of blocks, and so on
        while len(least) > 1:
            least = np.minimum(least[0::2], np.append(least[1::2], np.iinfo(np.int64).max)[: len(least[0::2])])
            self.levels.append(least)
        self.pairs = np.concatenate([[0], np.cumsum(bits[:-1] & ~bits[1:]), [0]])  # leaf pairs that begin before a place
        self.pairs[-1] = self.pairs[-2]

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """Where each opening parenthesis is closed: the first place after it with one less than its excess."""
        wanted, place = self.excess[opens] - 1, opens + 1
        active = np.arange(len(opens))
        while len(active):  # within the block
            active = active[(self.excess[place[active]] > wanted[active])]
            place[active] += 1
            active = active[place[active] % BLOCK > 0]
        left = np.flatnonzero(self.excess[np.minimum(place, len(self.excess) - 1)] > wanted)
        if not len(left):
            return place
        node, level, want = place[left] // BLOCK, np.zeros(len(left), np.int64), wanted[left]
        sizes = np.array([len(x) for x in self.levels])
        flat, start = np.concatenate(self.levels), np.cumsum(sizes) - sizes
        value = lambda: np.where(node < sizes[level], flat[np.minimum(start[level] + node, len(flat) - 1)], np.iinfo(np.int64).max)
        up = value() > want
        while up.any():  # to the next group of blocks, the larger the farther
            odd = up & (node % 2 == 1)
            even = up & ~odd
            node[odd], level[odd] = (node[odd] + 1) // 2, level[odd] + 1
            node[even] += 1
            up = value() > want
        while (level > 0).any():  # down to its first block that has the excess
            down = level > 0
            level[down] -= 1
            node[down] *= 2
            node[down & (value() > want)] += 1
        place[left] = node * BLOCK
        while len(left):
            left = left[self.excess[place[left]] > wanted[left]]
            place[left] += 1
        return place

    def leaves(self, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
        return self.pairs[closes] - self.pairs[opens]


NODE = "kind int, path long, depth long, a long, b long, pa long, pb long, conv_id long, parent_conv_id long, n_convs long, n_children long, more long, n_leaves long, saved_tokens long, n_bytes long, ends_sha256 string"
#: Kinds of rows: whole results, results whose parent is on a spine, and a spine's nodes.
WHOLE, BELOW_SPINE, SPINE = 0, 1, 2


def encode(sequences: pa.Table, shard: int) -> pa.RecordBatch:
    """The nodes of one shard. ``sequences``, sorted and distinct: steps (a, b, n_bytes), conv_id, n_ends, length, sha."""
    steps = sequences.column("steps").combine_chunks()
    lens, flat = steps.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), steps.flatten()
    a, b, size = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("a", "b", "n_bytes"))
    conv, n_ends, length = (sequences.column(c).to_numpy() for c in ("conv_id", "n_ends", "length"))
    n, first = len(lens), np.cumsum(lens) - lens
    # A step's digest covers all before it, so steps that are equal to those of the sequence before make the common beginning.
    row = np.repeat(np.arange(n), lens)
    step = np.arange(len(a)) - first[row]
    twin = np.where((row > 0) & (step < lens[row - 1]), first[row - 1] + step, 0)
    same = (row > 0) & (step < lens[row - 1]) & (a == a[twin]) & (b == b[twin]) if len(a) else np.empty(0, bool)
    common = np.bincount(row[same], minlength=n)
    fresh = step >= common[row]
    lens_before = np.append(0, lens[:-1])
    runs = np.column_stack([lens_before - common, lens - common]).ravel()
    tree = Parentheses(np.concatenate([[True], np.repeat(np.tile([False, True], n), runs), np.zeros(lens[-1] + 1, bool)]))
    opens = np.flatnonzero(tree.bits)
    closes = tree.find_close(opens)
    depth, until = tree.excess[opens] - 1, np.arange(len(opens)) + (closes - opens + 1) // 2
    a, b, size = (np.append(0, x[fresh]) for x in (a, b, size))
    # A node's parent: the last node before it that is one less deep.
    by_depth, width = np.lexsort((np.arange(len(depth)), depth)), len(depth) + 1
    ordered = depth[by_depth] * width + by_depth
    parent = by_depth[np.maximum(np.searchsorted(ordered, (depth - 1) * width + np.arange(len(depth)), side="right") - 1, 0)]
    end = np.cumsum(np.bincount(row[fresh], minlength=n)) if len(row) else np.zeros(n, np.int64)  # the sequence's last node is always new
    below = lambda x: (s := np.append(0, np.cumsum(x)))[until] - s[:-1]
    ends = np.zeros(len(depth), np.int64)
    ends[end] = n_ends
    n_convs = below(ends)
    member = np.full(len(depth), np.iinfo(np.int64).max)
    member[end] = conv
    edges = np.append(np.flatnonzero(np.diff(depth[by_depth], prepend=-1)), len(depth))
    for begin, stop in zip(edges[-2:0:-1], edges[:1:-1], strict=True):  # from the deepest up
        level = by_depth[begin:stop]
        np.minimum.at(member, parent[level], member[level])
    more = np.zeros(len(depth), np.int64)
    more[end] = length > lens
    text = np.full(len(depth), None, object)
    text[end] = np.where(length > lens, None, np.array(sequences.column("sha").to_pylist(), object))

    # The first path and the last: they alone may go on in other shards.
    paths = [np.arange(lens[0] + 1), [len(depth) - 1]]
    while paths[1][-1]:
        paths[1].append(int(parent[paths[1][-1]]))
    paths[1] = np.array(paths[1][::-1])
    spine = np.zeros(len(depth), bool)
    spine[paths[0]] = spine[paths[1]] = True
    leaf = tree.bits[opens] & ~tree.bits[opens + 1]
    spine_leaves = below((leaf & spine).astype(np.int64))
    kids = np.bincount(parent[1:][~spine[1:]], minlength=len(depth))
    saved = below(np.where(spine, 0, (n_convs - 1) * size))
    leaves = tree.leaves(opens, closes) - spine_leaves

    inner = np.flatnonzero(~spine)
    only_last = paths[1][~np.isin(paths[1], paths[0])]
    stem = paths[1][np.isin(paths[1], paths[0])]  # on both paths, its sums count on the first
    at = np.concatenate([inner, paths[0], only_last, stem])
    kind = np.repeat([WHOLE, SPINE], [len(inner), len(at) - len(inner)])
    kind[: len(inner)][spine[parent[inner]]] = BELOW_SPINE
    path = np.repeat([-1, 2 * shard, 2 * shard + 1], [len(inner), len(paths[0]), len(only_last) + len(stem)])
    counts = np.arange(len(at)) < len(at) - len(stem)
    return pa.RecordBatch.from_pydict({
        "kind": pa.array(kind, pa.int32()), "path": pa.array(path), "depth": pa.array(depth[at]), "a": pa.array(a[at]), "b": pa.array(b[at]), "pa": pa.array(a[parent[at]]), "pb": pa.array(b[parent[at]]),
        "conv_id": pa.array(member[at]), "parent_conv_id": pa.array(member[parent[at]]), "n_convs": pa.array(n_convs[at] * counts), "n_children": pa.array((kids + np.where(spine, 0, more))[at] * counts),
        "more": pa.array(more[at] * counts), "n_leaves": pa.array(leaves[at] * counts), "saved_tokens": pa.array(saved[at] * counts), "n_bytes": pa.array(size[at]), "ends_sha256": pa.array(text[at].tolist(), pa.string()),
    })


def _shards(shard_nodes: int):
    """Of sorted sequences: the nodes of shards of about ``shard_nodes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size, shard = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            total, begin = np.cumsum(batch.column("steps").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) + 1), 0
            while begin < batch.num_rows:
                before = total[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(total, before + shard_nodes - size, side="right")))
                waiting.append(batch.slice(begin, end - begin))
                size, begin = size + int(total[end - 1] - before), end
                if size >= shard_nodes or begin < batch.num_rows:
                    yield encode(pa.Table.from_batches(waiting), shard)
                    waiting, size, shard = [], 0, shard + 1
        if waiting:
            yield encode(pa.Table.from_batches(waiting), shard)
        give_back()

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (length, a, b, conv_id) in order: runs of ids of one end, joined."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = [batch.column(c).to_numpy() for c in ("length", "a", "b")]
        new = np.append(True, np.any([e[1:] != e[:-1] for e in ends], axis=0))
        begins, ids = np.flatnonzero(new), batch.column("conv_id").to_pylist()
        stops = np.append(begins[1:], len(ids))
        begins, stops = (np.array(x) for x in zip(*((i, min(i + PIECE // 20, stop)) for start, stop in zip(begins.tolist(), stops.tolist(), strict=True) for i in range(start, stop, PIECE // 20)), strict=True))
        made = [*(pa.array(e[begins]) for e in ends), pa.array([ids[i] for i in begins.tolist()], pa.int64()), pa.array(stops - begins), pa.array([",".join(map(str, ids[i:j])) for i, j in zip(begins.tolist(), stops.tolist(), strict=True)])]
        yield pa.RecordBatch.from_arrays(made, names=["length", "a", "b", "conv_id", "n", "piece"])


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pieces by end and in order: the least id, the number of ids and their digest."""
    present, state = None, None
    names = ["length", "a", "b", "conv_id", "n_ends", "sha"]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 5 + [pa.string()], strict=True)], names=names)

    for batch in batches:
        done = []
        for length, a, b, conv, n, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (length, a, b) != present:
                if present:
                    done.append((*present, state[0], state[1], state[2].hexdigest()))
                present, state = (length, a, b), [conv, 0, hashlib.sha256()]
            elif state[1]:
                state[2].update(b",")
            state[1] += n
            state[2].update(piece.encode())
        if done:
            yield out(done)
    if present:
        yield out([(*present, state[0], state[1], state[2].hexdigest())])


def _packed(lane) -> list[Column]:
    """A digest's two halves from its lanes."""
    return [lane(0) * F.lit(1 << 31) + lane(1), lane(2) * F.lit(1 << 31) + lane(3)]


def rebuilt(spark: SparkSession, conversations: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Each conversation's end (conv_id, length, a, b, and what rebuilding took), and its numbered turns.

    Conversation c begins with the first crc32(c) % ``heads`` turns of c - c % ``family``, then its own turns after as many.
    """
    empty = lambda c: F.coalesce(column(c).cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    turns = conversations.select(F.col("conv_id").cast("long").alias("key"), F.col("turn").alias("turn"), empty("role").alias("role"), empty("text").alias("text")).where("key is not null")
    rows = numbered(turns.select("key", "turn", digest.alias("digest"), F.octet_length("text").cast("long").alias("n_bytes")), [F.col("turn"), F.col("digest")])
    ps = [f"p{i}" for i in range(LANES)]
    head = F.when(F.col("position") < heads, F.struct("position", "n_bytes", *ps))
    of_conv = materialize(rows.groupBy("key").agg(F.max("position").alias("n"), F.sort_array(F.collect_list(head)).alias("first"), F.max_by(F.struct(*ps), "position").alias("last")), "heads")
    base = of_conv.select(F.col("key").alias("base"), F.col("first").alias("base_first"))
    both = of_conv.withColumns({"base": F.col("key") - F.col("key") % family, "h": F.crc32(F.col("key").cast("string").cast("binary")) % heads}).join(base, "base", "left")
    both = both.withColumn("k", F.least("h", F.coalesce(F.size("base_first"), F.lit(0))).cast("long"))
    both = both.withColumn("copied", F.when(F.col("k") > 0, F.slice("base_first", F.lit(1), F.col("k").cast("int"))))
    zero = F.lit(0).cast("long")
    lane_at = lambda array, count, i: F.coalesce(F.get(array, (count - 1).cast("int"))[f"p{i}"], zero)
    lanes = {f"at{i}": lane_at(F.col("copied"), F.col("k"), i) for i in range(LANES)} | {f"own{i}": lane_at(F.col("first"), F.least("h", "n"), i) for i in range(LANES)}
    lanes |= {f"inv{i}": F.get(F.array(*(F.lit(pow(b, -d, PRIME)) for d in range(heads))), (F.col("h") - F.col("k")).cast("int")) for i, b in enumerate(BASES)}
    both = both.withColumns(lanes)
    end = _packed(lambda i: F.when(F.col("n") > F.col("h"), moved(i, F.col("last")[f"p{i}"])).otherwise(F.col(f"at{i}")))
    made = ["h", "k", "copied", *(f"{x}{i}" for x in ("at", "own", "inv") for i in range(LANES))]
    return both.select(F.col("key").alias("conv_id"), (F.col("k") + F.greatest(zero, F.col("n") - F.col("h"))).alias("length"), end[0].alias("a"), end[1].alias("b"), *made), rows


def moved(i: int, digest: Column) -> Column:
    """A digest's lane after the turns before it have been put in place of the conversation's own."""
    return (F.col(f"at{i}") + (digest - F.col(f"own{i}") + PRIME) % PRIME * F.col(f"inv{i}") % PRIME) % PRIME


def _steps(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """conv_id, depth, digest (a, b), its parent's (pa, pb), n_bytes, n_ends and length of each turn of the rebuilt conversations."""
    keep = ["conv_id", "n_ends", "length"]
    zero = F.lit(0).cast("long")
    copies = convs.select(*keep, "copied", F.posexplode("copied").alias("i", "t"))
    lanes = lambda at: lambda i: F.coalesce(at[f"p{i}"], zero)
    here, before = _packed(lanes(F.col("t"))), _packed(lanes(F.get("copied", F.col("i") - 1)))
    taken = copies.select(*keep, F.col("t.position").alias("depth"), here[0].alias("a"), here[1].alias("b"), before[0].alias("pa"), before[1].alias("pb"), F.col("t.n_bytes").alias("n_bytes"))
    own = rows.join(convs.withColumnRenamed("conv_id", "key").drop("copied", "a", "b"), "key").where("position > h")
    here, before = _packed(lambda i: moved(i, F.col(f"p{i}"))), _packed(lambda i: moved(i, F.col(f"q{i}")))
    kept = own.select(F.col("key").alias("conv_id"), "n_ends", "length", (F.col("position") - F.col("h") + F.col("k")).alias("depth"), here[0].alias("a"), here[1].alias("b"), before[0].alias("pa"), before[1].alias("pb"), "n_bytes")
    return taken.unionByName(kept)


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _merged(nodes: DataFrame) -> DataFrame:
    """The spines' nodes, equal ones as one, with all of their subtrees."""
    entries = nodes.where(F.col("kind") == SPINE)
    key = ["depth", "a", "b"]
    sums = ("n_convs", "n_children", "more", "n_leaves", "saved_tokens")
    one = entries.groupBy(*key).agg(*(F.sum(c).alias(c) for c in sums), F.min("conv_id").alias("conv_id"), *(F.max(c).alias(c) for c in ("pa", "pb", "n_bytes", "ends_sha256")), F.min("path").alias("home"))
    children = one.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("spine_children"))
    one = one.join(children, key, "left").withColumn("n_children", F.col("n_children") + F.coalesce("spine_children", F.lit(0)))
    one = materialize(one.withColumns({"own_leaf": (F.col("n_children") == 0).cast("long"), "own_saved": (F.col("n_convs") - 1) * F.col("n_bytes")}), "spines")
    # Each spine node counts on one path, for itself and all above it.
    below = Window.partitionBy("path").orderBy(F.desc("depth"))
    home = F.col("path") == F.col("home")
    along = entries.select("path", *key).join(one.select(*key, "home", "own_leaf", "own_saved"), key)
    along = along.select(*key, *(F.sum(F.when(home, F.col(c)).otherwise(0)).over(below).alias(c) for c in ("own_leaf", "own_saved")))
    inside = along.groupBy(*key).agg(F.sum("own_leaf").alias("spine_leaves"), F.sum("own_saved").alias("spine_saved"))
    whole = one.join(inside, key).withColumns({"n_leaves": F.col("n_leaves") + F.col("spine_leaves"), "saved_tokens": F.col("saved_tokens") + F.col("spine_saved"), "n_children": F.col("n_children") + F.col("more")})
    return materialize(whole.select(*key, "pa", "pb", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"), "merged")


def prefix_trie(spark: SparkSession, conversations: DataFrame, family: int = FAMILY, heads: int = HEADS, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """The nodes of the trie of rebuilt conversations, columns ``RESULT``."""
    ship_package(spark)
    convs, rows = rebuilt(spark, conversations, family, heads)
    convs = materialize(convs, "conversations")
    order = ["length", "a", "b", "conv_id"]
    pieces = convs.select(order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, "length long, a long, b long, conv_id long, n long, piece string")
    ends = pieces.repartition("length", "a", "b").sortWithinPartitions(*order).mapInArrow(_hash, "length long, a long, b long, conv_id long, n_ends long, sha string")
    ends = materialize(ends, "ends")
    steps = materialize(_steps(convs.join(ends.select("conv_id", "n_ends"), "conv_id"), rows), "steps")
    shared = steps.groupBy("depth", "a", "b").agg(F.sum("n_ends").alias("n")).where("n > 1")
    above = shared.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), "n")
    told = materialize(steps.join(above, ["depth", "pa", "pb"], "left").withColumn("tail", (F.col("depth") > 1) & F.col("n").isNull()), "told")
    last = F.col("depth") == F.col("length")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    tails = told.where("tail").select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), F.when(last, none).otherwise(one).alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).alias("ends_sha256"))

    beginnings = told.where("not tail").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "a", "b", "n_bytes"))).alias("steps"))
    sequences = ends.select("conv_id", "n_ends", "length", "sha").join(beginnings, "conv_id", "left").withColumn("steps", F.coalesce("steps", F.array().cast("array<struct<depth:bigint,a:bigint,b:bigint,n_bytes:bigint>>")))
    sorted_ = sequences.repartitionByRange("steps").sortWithinPartitions("steps")
    nodes = materialize(sorted_.mapInArrow(_shards(shard_nodes), NODE), "nodes")
    spines = _merged(nodes)
    parents = spines.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("merged_conv_id"))
    within = nodes.where(F.col("kind") == WHOLE).select(RESULT)
    under = nodes.where(F.col("kind") == BELOW_SPINE).join(parents, ["depth", "pa", "pb"]).withColumn("parent_conv_id", F.col("merged_conv_id")).select(RESULT)
    on = spines.join(parents, ["depth", "pa", "pb"], "left").withColumn("parent_conv_id", F.col("merged_conv_id")).select(RESULT)
    every = within.unionByName(under).unionByName(on).unionByName(tails)
    return every.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
