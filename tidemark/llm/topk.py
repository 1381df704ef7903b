"""Exact top-k search by inner product: dual-tree search over cover trees.

Vectors are dealt into cells by their nearest pivot (a bounded number of them, drawn
by a hash), large cells into blocks by where they lie along the cell's main direction;
only vectors that lie at the same place are parted by a hash. A task takes one block of
data, builds its cover tree, and lets the queries stream past, a tree for each batch of
them. A cover tree's node is a point and the radius that covers all points below it.
Its children are found by farthest-first traversal: the centre, then ever the point
farthest from all so far, ``FAN`` of them; the radius within which they then cover all
points is also what they are apart at least. So each level has the covering and the
separation of a cover tree, at the base that the data give. Both trees are walked
together: with q, r the nodes' points and a, b their radii, no inner product below a
pair of nodes exceeds ``<q, r> + |q| b + |r| a + a b``, and the pair is pruned when that
is less than the worst k-th score of the queries below the query node. At a pair of
leaves each query is held against its own k-th score before the pair is scored exactly,
in integers.

Queries visit their own block first. With the k-th score found there they go only to
blocks whose ball and slab could hold a better one, so what is shuffled is copies of
the queries, and each vector twice. A window keeps the k best of each query.

Components are floor(1024 * x). Scores are exact: integers throughout where they
could leave the range in which doubles are.

Results in special cases: vectors that are null or hold null or non-finite components
take no part, nor do rows with a null vec_id; a shorter vector counts as filled with
zeros, so an empty one scores 0; every row but the query's own is a candidate, also
one that repeats the query's vec_id or vector, and a repeated query row is answered
as often as it occurs; ties go to the smaller vec_id; fewer than k candidates give
fewer rows; an empty table gives none; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import materialize, ship_package

SCALE = 1024
#: Vectors in a block of data (about), queries in a batch, pivots at most, vectors drawn for each cell's main direction, tasks at most.
DATA_BLOCK, QUERY_BATCH, MOST_PIVOTS, MOST_DRAWN, MOST_TASKS = 16_384, 1024, 1024, 8192, 10_000
#: Points in a leaf at most (unless all are equal), children of a node at most.
LEAF, FAN = 32, 16
NONE = np.iinfo(np.int64).min


class CoverTree:
    """Nodes as arrays: a centre, a covering radius and either children or the points of a leaf."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.centers: list[int] = []
        self.radii: list[float] = []
        self.children: list[np.ndarray] = []
        self.members: list[np.ndarray] = []
        self._build(0, np.arange(len(points)), np.linalg.norm(points - points[0], axis=1))
        self.center, self.radius = points[self.centers], np.array(self.radii)
        self.norm = np.linalg.norm(self.center, axis=1)

    def _build(self, center: int, index: np.ndarray, distances: np.ndarray) -> int:
        """The node of ``index``, whose centre is a point and whose distances to it are given."""
        node, radius = len(self.radii), float(distances.max())
        self.centers.append(center)
        self.radii.append(radius)
        self.children.append(np.empty(0, np.int64))
        self.members.append(index)
        if len(index) <= LEAF or radius == 0:
            return node
        owner, nearest, centers, own = np.zeros(len(index), np.int64), distances.copy(), [center], self.points[index]
        while len(centers) < FAN and nearest.max() > 0:
            far = int(nearest.argmax())
            apart = np.linalg.norm(own - own[far], axis=1)
            closer = apart < nearest
            owner[closer], nearest[closer] = len(centers), apart[closer]
            centers.append(int(index[far]))
        below = [owner == number for number in range(len(centers))]
        self.children[node] = np.array([self._build(point, index[b], nearest[b]) for point, b in zip(centers, below, strict=True) if b.any()])
        return node


class Best:
    """The k best (score, id) of each query so far, and its least score that matters."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k = k
        self.scores = np.full((len(floor), k), NONE, np.int64)
        self.ids = np.full((len(floor), k), np.iinfo(np.int64).max, np.int64)
        self.worst = floor.astype(np.int64)

    def offer(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of ``queries`` (rows) against ``ids`` (columns); the least score stands for no candidate."""
        hopeful = ((scores >= self.worst[queries][:, None]) & (scores > NONE)).any(axis=1)
        if not hopeful.any():
            return
        queries, scores = queries[hopeful], scores[hopeful]
        all_scores = np.concatenate([self.scores[queries], scores], axis=1)
        all_ids = np.concatenate([self.ids[queries], np.where(scores > NONE, ids, np.iinfo(np.int64).max)], axis=1)
        if all_scores.shape[1] > 4 * self.k:  # only what reaches the k-th score needs to be in order
            kth = ~np.partition(~all_scores, self.k - 1, axis=1)[:, self.k - 1 : self.k]
            wide = int((all_scores >= kth).sum(axis=1).max())
            part = np.argsort(~all_scores, axis=1, kind="stable")[:, :wide]
            all_scores, all_ids = np.take_along_axis(all_scores, part, axis=1), np.take_along_axis(all_ids, part, axis=1)
        order = np.lexsort((all_ids, ~all_scores), axis=1)[:, : self.k]
        self.scores[queries] = np.take_along_axis(all_scores, order, axis=1)
        self.ids[queries] = np.take_along_axis(all_ids, order, axis=1)
        self.worst[queries] = np.maximum(self.worst[queries], self.scores[queries, -1])


def _exact(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers."""
    most = max(np.abs(queries).max(initial=0), 1).item() * max(np.abs(data).max(initial=0), 1).item() * max(queries.shape[1], 1)
    if most < 2**52:
        return (queries.astype(np.float64) @ data.T.astype(np.float64)).astype(np.int64)
    return queries @ data.T


def _bound(inner: np.ndarray, norm_q, a, norm_r, b) -> np.ndarray:
    """The greatest inner product around two points with radii a and b, with room for the rounding of doubles."""
    reach = norm_q * b + norm_r * a + a * b
    return inner + reach + 1e-9 * (norm_q * norm_r + reach) + 1


class Block:
    """A block of data and its cover tree."""

    def __init__(self, data: np.ndarray, rows: np.ndarray, ids: np.ndarray):
        self.data, self.rows, self.ids = data, rows, ids
        self.tree = CoverTree(data.astype(np.float64))

    def search(self, queries: np.ndarray, query_rows: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
        """Scores and ids of each query's k best here that reach its floor; how many pairs of nodes were visited and pruned, and how many scores worked out."""
        best, points = Best(floor, k), queries.astype(np.float64)
        q_tree, r_tree = CoverTree(points), self.tree
        norms, told = np.linalg.norm(points, axis=1), {"visited": 0, "pruned": 0, "scored": 0}
        stack = [(0, 0, math.inf)]
        while stack:
            q, r, most = stack.pop()
            below_q, below_r, own = q_tree.children[q], r_tree.children[r], q_tree.members[q]
            told["visited"] += 1
            if most < best.worst[own].min():
                told["pruned"] += 1
                continue
            if not len(below_q) and not len(below_r):
                own = own[_bound(points[own] @ r_tree.center[r], norms[own], 0.0, r_tree.norm[r], r_tree.radius[r]) >= best.worst[own]]
                if len(own):
                    columns = r_tree.members[r]
                    scores = _exact(queries[own], self.data[columns])
                    scores[query_rows[own][:, None] == self.rows[columns]] = NONE
                    best.offer(own, scores, self.ids[columns])
                    told["scored"] += scores.size
                continue
            if len(below_r) and (not len(below_q) or r_tree.radius[r] >= q_tree.radius[q]):
                pairs = [(q, c) for c in below_r.tolist()]
                bounds = _bound(r_tree.center[below_r] @ q_tree.center[q], q_tree.norm[q], q_tree.radius[q], r_tree.norm[below_r], r_tree.radius[below_r])
            else:
                pairs = [(c, r) for c in below_q.tolist()]
                bounds = _bound(q_tree.center[below_q] @ r_tree.center[r], q_tree.norm[below_q], q_tree.radius[below_q], r_tree.norm[r], r_tree.radius[r])
            stack += [(*pairs[i], bounds[i]) for i in np.argsort(bounds)]  # the most hopeful comes off first
        return best.scores, best.ids, told


def quantized(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and the components floor(1024 * x) of every row that takes part."""
    usable = F.forall(F.col(embedding), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    taken = vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & usable)
    return taken.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(embedding, lambda x: F.floor(SCALE * x.cast("double")).cast("long")).alias("parts"))


def _matrix(parts: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as rows, filled with zeros."""
    sizes, values = parts.value_lengths().to_numpy(zero_copy_only=False), parts.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return values.reshape(len(parts), width)
    out = np.zeros((len(parts), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


ROW = "row long, vec_id long, parts array<long>"


def _with_columns(batch: pa.RecordBatch, **more: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *more.values()], names=[*batch.schema.names, *more])


class Cells:
    """Pivots, and of each cell a direction along which large ones are split. Bounded: at most ``MOST_PIVOTS`` of each."""

    def __init__(self, drawn: np.ndarray, n_pivots: int):
        self.pivots = drawn[:n_pivots]
        self.half_squares = (self.pivots * self.pivots).sum(axis=1) / 2
        self.directions = np.zeros_like(self.pivots)
        cell, _ = self.nearest(drawn)
        for c in range(len(self.pivots)):
            off = drawn[cell == c] - self.pivots[c]
            if len(off) > 1 and np.abs(off).max() > 0:
                self.directions[c] = np.linalg.svd(off - off.mean(axis=0), full_matrices=False)[2][0]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each point its cell and where it lies along the cell's direction, from the pivot."""
        cell = (points @ self.pivots.T - self.half_squares).argmax(axis=1)
        return cell, ((points - self.pivots[cell]) * self.directions[cell]).sum(axis=1)


def _deal(cells: Cells):
    """Each row with its cell, its distance from the pivot and its place along the direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _matrix(batch.column("parts"), cells.pivots.shape[1]).astype(np.float64)
            cell, along = cells.nearest(points)
            yield _with_columns(batch, cell=pa.array(cell, pa.int32()), distance=pa.array(np.linalg.norm(points - cells.pivots[cell], axis=1)), along=pa.array(along))

    return run


def _split(cuts: list[np.ndarray], first: np.ndarray):
    """Each row's block: between the cuts of its cell, by its place; rows that lie on several equal cuts are dealt by their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, along, row = (batch.column(c).to_numpy() for c in ("cell", "along", "row"))
            block = first[cell].copy()
            for c in np.unique(cell):
                if len(cuts[c]):
                    at = np.flatnonzero(cell == c)
                    low, high = (np.searchsorted(cuts[c], along[at], side=s) for s in ("left", "right"))
                    block[at] += low + (row[at] * 2_654_435_761 >> 8) % (high - low + 1)
            yield _with_columns(batch, block=pa.array(block, pa.int32()))

    return run


def _invite(cells: Cells, cell: np.ndarray, radius: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Each query (with its own block) for every other block that could hold a score that matters.

    A block's vectors are within ``radius`` of its cell's pivot, and between ``low`` and ``high`` along the cell's direction.
    """
    pivots, directions = cells.pivots[cell], cells.directions[cell]
    norms = np.linalg.norm(pivots, axis=1)
    slack = 1e-6 * (1 + radius + np.abs(low) + np.abs(high))
    low, high = low - slack, high + slack
    nearest = np.where((low <= 0) & (high >= 0), 0.0, np.minimum(np.abs(low), np.abs(high)))
    across = np.sqrt(np.maximum(radius * radius - nearest * nearest, 0)) + slack

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, QUERY_BATCH):
                batch = whole.slice(start, QUERY_BATCH)
                points, floor = _matrix(batch.column("parts"), pivots.shape[1]).astype(np.float64), batch.column("floor").to_numpy()
                inner, q = points @ pivots.T, np.linalg.norm(points, axis=1)[:, None]
                ball = _bound(inner, q, 0.0, norms, radius)
                lean = points @ directions.T
                slab = inner + np.maximum(lean * low, lean * high) + np.sqrt(np.maximum(q * q - lean * lean, 0)) * across
                slab += 1e-9 * (q * norms + q * (radius + slack)) + 1
                query, block = np.nonzero((np.minimum(ball, slab) >= floor[:, None]) & (radius >= 0))
                query, block = query[block != (own := batch.column("block").to_numpy())[query]], block[block != own[query]]
                for begin in range(0, len(query), 10_000):
                    part = batch.select(["row", "vec_id", "parts", "floor"]).take(pa.array(query[begin : begin + 10_000]))
                    yield _with_columns(part, block=pa.array(block[begin : begin + 10_000], pa.int32()))

    return run


def _visit(k: int, width: int):
    """Of rows by block, data first: the k best of each query in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, gathered, waiting, block = None, [], [], None

        def answer() -> Iterator[pa.RecordBatch]:
            nonlocal gathered, waiting, block
            if waiting:
                if block is None:
                    data = pa.Table.from_batches(gathered).combine_chunks()
                    block, gathered = Block(*(_matrix(data.column("parts").chunk(0), width), data.column("row").to_numpy(), data.column("vec_id").to_numpy())), []
                asked = pa.Table.from_batches(waiting).combine_chunks()
                rows, ids = asked.column("row").to_numpy(), asked.column("vec_id").to_numpy()
                scores, found, _ = block.search(_matrix(asked.column("parts").chunk(0), width), rows, asked.column("floor").to_numpy(), k)
                real = scores > NONE
                made = {"row": np.repeat(rows, k)[real.ravel()], "query_id": np.repeat(ids, k)[real.ravel()], "vec_id": found[real], "score": scores[real]}
                yield pa.RecordBatch.from_pydict({n: pa.array(v, pa.int64()) for n, v in made.items()})
                waiting = []

        for batch in batches:
            blocks, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero((blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), len(blocks)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if blocks[a] != at:
                    yield from answer()
                    at, gathered, block = blocks[a], [], None
                if kinds[a] == 0:
                    gathered.append(batch.slice(a, b - a))
                    continue
                for begin in range(a, b, QUERY_BATCH):
                    waiting.append(batch.slice(begin, min(b, begin + QUERY_BATCH) - begin))
                    if sum(w.num_rows for w in waiting) >= QUERY_BATCH:
                        yield from answer()
        yield from answer()

    return run


def top_k(spark: SparkSession, vectors: DataFrame, k: int = 10, query_every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every row whose vec_id is divisible by ``query_every``."""
    ship_package(spark)
    every = quantized(vectors)
    n, width = every.agg(F.count("*"), F.max(F.size("parts"))).first()
    width = max(1, width or 0)
    n_pivots = min(MOST_PIVOTS, max(1, -(-n // DATA_BLOCK)))
    drawn = every.orderBy(F.xxhash64("vec_id", "parts")).limit(max(n_pivots, min(MOST_DRAWN, 16 * n_pivots))).select("parts").toArrow()
    cells = Cells(_matrix(drawn.column("parts").combine_chunks(), width).astype(np.float64) if n else np.zeros((1, width)), n_pivots)
    # A row's number is fixed by writing it.
    dealt = every.select(F.monotonically_increasing_id().alias("row"), "vec_id", "parts").mapInArrow(_deal(cells), f"{ROW}, cell int, distance double, along double")
    dealt = materialize(dealt, "dealt")
    sizes = {r["cell"]: r["count"] for r in dealt.groupBy("cell").count().collect()}  # at most MOST_PIVOTS
    splits = np.array([max(1, -(-sizes.get(c, 0) // DATA_BLOCK)) for c in range(len(cells.pivots))])
    most, wide = int(splits.max()), [c for c in sizes if splits[c] > 1]
    found = dealt.where(F.col("cell").isin(wide)).groupBy("cell").agg(F.percentile_approx("along", F.array(*(F.lit(i / most) for i in range(1, most))), 10_000)) if wide else None
    tenths = {r[0]: np.array(r[1]) for r in found.collect()} if wide else {}
    cuts = [np.sort(tenths[c])[np.unique(np.linspace(0, most - 2, splits[c] - 1).round().astype(int))] if c in tenths else np.empty(0) for c in range(len(splits))]
    first = np.cumsum([len(c) + 1 for c in cuts]) - [len(c) + 1 for c in cuts]
    n_blocks = int(first[-1] + len(cuts[-1]) + 1)
    blocks = materialize(dealt.mapInArrow(_split(cuts, first), f"{ROW}, cell int, distance double, along double, block int"), "blocks")
    of, radius, low, high = np.zeros(n_blocks, np.int64), np.full(n_blocks, -1.0), np.zeros(n_blocks), np.zeros(n_blocks)
    for r in blocks.groupBy("block").agg(F.first("cell"), F.max("distance"), F.min("along"), F.max("along")).collect():  # a row a block
        of[r[0]], radius[r[0]], low[r[0]], high[r[0]] = r[1:]
    data = blocks.select("row", "vec_id", "parts", F.lit(NONE).alias("floor"), "block")
    own = data.where(F.col("vec_id") % query_every == 0)

    def visit(queries: DataFrame) -> DataFrame:
        both = data.withColumn("kind", F.lit(0)).unionByName(queries.withColumn("kind", F.lit(1)))
        tasks = int(min(MOST_TASKS, max(1, 2 * n_blocks)))
        return both.repartition(tasks, "block").sortWithinPartitions("block", "kind").mapInArrow(_visit(k, width), "row long, query_id long, vec_id long, score long")

    near = materialize(visit(own), "near")
    kth = near.groupBy("row").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    floors = own.drop("floor").join(kth, "row", "left").withColumn("floor", F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(NONE)))
    invited = floors.select("row", "vec_id", "parts", "floor", "block").mapInArrow(_invite(cells, of, radius, low, high), f"{ROW}, floor long, block int")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = near.unionByName(visit(invited)).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
