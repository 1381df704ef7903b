"""Self-join of n-gram sets by Jaccard similarity over a trie.

The sets of a block are written in one global order of n-grams, frequent ones
first, and stored in a trie with compressed paths, so that sets share the nodes
of what they have in common. A set that looks for partners walks the trie once
for all of them: the overlap counted on a node holds for every set below it. A
subtree is left out when even the most n-grams that remain below it, or that
remain of the walking set, can't reach the overlap its smallest set would need.

Only components are wanted, so a subtree whose sets are all in the walker's
component already is left out too. A group of near copies thus costs about one
walk along one path for each of its sets, not one for each pair.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np

#: Sets link when 100 * overlap >= 75 * union, that is 7 * overlap >= 3 * (sum of sizes).
OVERLAP, SIZES = 7, 3


def linked(overlap: int, size_a: int, size_b: int) -> bool:
    return OVERLAP * overlap >= SIZES * (size_a + size_b)


class Forest:
    """Disjoint sets."""

    def __init__(self, parents: list[int]):
        self.parent = parents

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def union(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.parent[max(i, j)] = min(i, j)
        return True


class Node:
    __slots__ = ("run", "children", "here", "longest", "smallest", "member")

    def __init__(self, run: list[int], longest: int, smallest: int, member: int | None):
        self.run = run
        self.children: dict[int, Node] = {}
        self.here: list[int] = []  # sets that end at this node
        self.longest = longest  # most n-grams on a path from this node's first on
        self.smallest = smallest  # size of the smallest set below
        self.member = member  # a set below, if all below are in one component; else None


class Trie:
    def __init__(self, forest: Forest, sizes: list[int]):
        self.forest, self.sizes = forest, sizes
        self.root = Node([], 0, 1 << 60, None)

    def insert(self, index: int, grams: list[int]) -> None:
        size, find = self.sizes[index], self.forest.find
        mine = find(index)
        node, at = self.root, 0
        while True:
            node.longest = max(node.longest, len(grams) - at + len(node.run))
            node.smallest = min(node.smallest, size)
            if node.member is not None and find(node.member) != mine:
                node.member = None
            if at == len(grams):
                node.here.append(index)
                return
            child = node.children.get(grams[at])
            if child is None:
                child = Node(grams[at:], len(grams) - at, size, index)
                child.here.append(index)
                node.children[grams[at]] = child
                return
            same, run = 0, child.run
            limit = min(len(run), len(grams) - at)
            while same < limit and run[same] == grams[at + same]:
                same += 1
            if same < len(run):
                upper = Node(run[:same], child.longest, child.smallest, child.member)
                child.run = run[same:]
                child.longest -= same
                upper.children[child.run[0]] = child
                node.children[grams[at]] = upper
                child = upper
            node, at = child, at + same

    def link(self, index: int, grams: list[int]) -> list[tuple[int, int]]:
        """Find partners of a set in other components and join their components."""
        forest, sizes, size = self.forest, self.sizes, self.sizes[index]
        find, mine = forest.find, set(grams)
        links: list[tuple[int, int]] = []
        stack = [(self.root, 0)]
        while stack:
            node, overlap = stack.pop()
            if node.member is not None and find(node.member) == find(index):
                continue
            if node.run:
                remaining = len(grams) - bisect_left(grams, node.run[0])
                if OVERLAP * (overlap + min(node.longest, remaining)) < SIZES * (size + node.smallest):
                    continue
                overlap += sum(1 for g in node.run if g in mine)
            for other in node.here:
                if linked(overlap, size, sizes[other]) and forest.union(index, other):
                    links.append((index, other))
            if node.member is None and node is not self.root:
                below = [*node.here, *(c.member for c in node.children.values())]
                if None not in below and len({find(b) for b in below}) == 1:
                    node.member = below[0]
                    if find(node.member) == find(index):
                        continue
            later = []
            for first, child in node.children.items():
                (stack if first not in mine else later).append((child, overlap))
            stack += later  # what shares the next n-gram is walked first
        return links


def block_links(sets: list[np.ndarray], components: list[int] | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that join all sets of a block which similarity connects.

    ``components``: numbers that say which sets are known to be connected.
    """
    n = len(sets)
    first: dict[int, int] = {}
    forest = Forest([first.setdefault(c, i) for i, c in enumerate(components)] if components else list(range(n)))
    grams, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(grams), np.int64)
    rank[np.lexsort((grams, -counts))] = np.arange(len(grams))
    shared = int((counts > 1).sum())  # n-grams of one set alone add to no overlap
    ranks = rank[place]
    sizes = [len(s) for s in sets]
    trie, links, at = Trie(forest, sizes), [], 0
    for index, size in enumerate(sizes):
        own = np.sort(ranks[at : at + size])
        ordered = own[: np.searchsorted(own, shared)].tolist()
        at += size
        if 4 * len(ordered) < 3 * size:
            continue  # an overlap is at least 3/4 of either size
        links += trie.link(index, ordered)
        trie.insert(index, ordered)
    return links
