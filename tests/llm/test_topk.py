"""Top-k search against brute force, on odd rows, and what it prunes."""

import numpy as np
import pytest

from tidemark.llm import topk


def brute_force(data: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    return [sorted((-int(s), int(i)) for r, (s, i) in enumerate(zip(data @ q, ids, strict=True)) if r != o)[:k] for q, o in zip(queries, own, strict=True)]


@pytest.mark.parametrize("spread", [0, 40])
def test_a_block_is_searched_exactly(spread):
    rng = np.random.default_rng(4)
    centers = rng.integers(-1000, 1000, (20, 8)) if spread else np.zeros((1, 8), int)
    data = centers[rng.integers(0, len(centers), 3_000)] + rng.integers(-50, 50, (3_000, 8))
    data[100:140] = data[0]
    ids, own = rng.permutation(3_000) // 2, np.arange(0, 3_000, 25)
    block = topk.Block(data, np.arange(3_000), ids)
    for floor in (topk.NONE, 0):
        scores, found, told = block.search(data[own], own, np.full(len(own), floor), 10)
        for want, s, i in zip(brute_force(data, ids, data[own], own, 10), scores, found, strict=True):
            assert [(-int(a), int(b)) for a, b in zip(s, i, strict=True) if a > max(topk.NONE, floor - 1)] == [w for w in want if -w[0] >= floor]
    assert told["visited"] > 1
    if spread:
        assert told["pruned"] > 0 and told["scored"] < 0.2 * len(own) * len(data)


def test_a_cover_tree_covers_and_is_apart():
    rng = np.random.default_rng(5)
    tree = topk.CoverTree(np.repeat(rng.normal(size=(40, 3)) * 100, 30, axis=0) + rng.normal(size=(1_200, 3)))
    assert sum(len(c) > 0 for c in tree.children) > 1
    for node, children in enumerate(tree.children):
        points = tree.points[tree.members[node]]
        assert np.linalg.norm(points - tree.points[tree.centers[node]], axis=1).max() <= tree.radii[node] + 1e-9
        if not len(children):
            assert len(points) <= topk.LEAF or tree.radii[node] == 0
            continue
        centers = tree.points[[tree.centers[c] for c in children]]
        apart = np.linalg.norm(centers[:, None] - centers[None], axis=2)[~np.eye(len(children), dtype=bool)]
        assert max(tree.radii[c] for c in children) <= apart.min() + 1e-9
        assert sorted(np.concatenate([tree.members[c] for c in children])) == sorted(tree.members[node])


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_the_trees_of_the_real_table(spark, sf):
    """More than one level, leaves of bounded size, and a walk over pairs that finds what brute force finds."""
    rows = topk.quantized(spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")).collect()
    data, ids = np.array([r.parts for r in rows]), np.array([r.vec_id for r in rows])
    block = topk.Block(data, np.arange(len(data)), ids)
    leaves = [len(m) for m, c in zip(block.tree.members, block.tree.children, strict=True) if not len(c)]
    assert len(block.tree.radii) > len(data) / topk.LEAF and max(leaves) <= topk.LEAF
    own = np.flatnonzero(ids % 100 == 0)
    scores, found, told = block.search(data[own], own, np.full(len(own), topk.NONE), 10)
    assert [[(-int(a), int(b)) for a, b in zip(s, i, strict=True)] for s, i in zip(scores, found, strict=True)] == brute_force(data, ids, data[own], own, 10)
    print(sf, len(data), "vectors,", len(block.tree.radii), "nodes,", told, "of", len(own) * len(data), "scores")
    assert told["visited"] > len(leaves)


def found(spark, rows, **more):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' as parts", "1 as row", "2 as block")
    return sorted(tuple(r) for r in topk.top_k(spark, table, **more).collect())


def test_every_row_counts(spark):
    assert found(spark, []) == []
    rows = [(0, [1.0, 0.0]), (5, [1.0, 0.0]), (5, [2.0, 0.0]), (7, []), (None, [9.0, 9.0]), (8, None), (9, [1.0, None]), (10, [float("nan"), 1.0]), (11, [float("inf"), 1.0])]
    one = 1024 * 1024
    assert found(spark, rows) == [(0, 1, 5, 2 * one), (0, 2, 5, one), (0, 3, 7, 0)]
    # A repeated query row is answered twice, and each is a candidate of the other.
    assert found(spark, [(0, [1.0]), (0, [1.0]), (3, [0.5])]) == sorted(2 * [(0, 1, 0, one), (0, 2, 3, one // 2)])


@pytest.mark.parametrize("most_pivots", [3, 1024])
def test_blocks_and_pivots_are_exact(spark, monkeypatch, most_pivots):
    monkeypatch.setattr(topk, "DATA_BLOCK", 64)
    monkeypatch.setattr(topk, "MOST_PIVOTS", most_pivots)
    monkeypatch.setattr(topk, "QUERY_BATCH", 3)
    rng = np.random.default_rng(6)
    data = (rng.normal(size=(12, 4)) * 5)[rng.integers(0, 12, 900)] + rng.normal(size=(900, 4)) / 4
    data[300:600] = data[300]  # a vector that a third of the rows have
    parts = np.floor(1024 * data).astype(np.int64)
    ids = np.arange(900)
    got = found(spark, [(i, v.tolist()) for i, v in enumerate(data)], query_every=20)
    want = [(int(q), rank, i, -s) for q, best in zip(ids[::20], brute_force(parts, ids, parts[::20], ids[::20], 10), strict=True) for rank, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)
