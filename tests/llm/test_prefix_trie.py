"""The prefix trie: parentheses, shards and spines against plain versions, digests across tasks, and odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import prefix_trie, prefixes


def plain(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    # Equal turns go by the digest of role and text.
    key = lambda t: (t[0], t[1], hashlib.sha256(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).digest())
    turns = {c: [t[2:] for t in sorted(ts, key=key)] for c, ts in turns.items()}
    nodes, ends = defaultdict(set), defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(turns.get(c - c % 5, [])[:h] + own[h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            nodes[path[:d]].add(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in nodes:
        if path:
            kids[path[:-1]] += 1
    for path, members in nodes.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not kids[path]
            saved[path[:d]] += (len(members) - 1) * len(path[-1][1].encode()) if path else 0
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p], digest(p)) for p, m in nodes.items())


def found(spark, rows, **more):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as depth", "2 as key", "3 as a", "4 as n", "5 as position", "6 as kind", "7 as `x.y`")
    got = prefix_trie.prefix_trie(spark, table.repartition(4), **more).select(prefix_trie.RESULT).collect()
    return sorted(tuple(-1 if v is None else v for v in r) for r in got)


@pytest.mark.parametrize("shard_nodes", [1, 7, 500_000])
def test_against_the_plain_version(spark, shard_nodes):
    rng = random.Random(shard_nodes)
    rows = []
    for c in range(120):
        for turn in range(rng.choice([0, 1, 2, 5, 9, 14])):
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", None]), rng.choice(["é", "hello", None, "", "long " * 50])))
    rows += [r for r in rows if r[0] == 5] + [(200, t, "user", f"same {t}") for t in range(12)] + [(None, 1, "user", "x")]
    rows += [(c, t, "user", f"same {t}") for c in range(205, 300, 5) for t in range(12)]  # copies
    assert found(spark, rows, shard_nodes=shard_nodes) == plain(rows)


def test_odd_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "x")]) == []
    rows = [(3, None, None, None), (3, None, None, None), (8, 1, "user", "y" * 300_000), (9, 1, "user", "y" * 300_000)]
    assert found(spark, rows) == plain(rows)


def test_a_hot_conversation_and_a_hot_first_turn(spark):
    rows = [(0, t, "user", f"turn {t}") for t in range(700)] + [(c, t, "user", f"turn {t}" if t < 3 else f"{c} {t}") for c in range(1, 150) for t in range(5)]
    assert found(spark, rows, shard_nodes=100) == plain(rows)


def test_prefixes_go_on_in_the_next_task(spark):
    """One key's rows over many tasks get the digests that one task gives them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(k, i, hashlib.sha256(f"{k} {i}".encode()).digest(), 1) for k, n in ((1, 3), (2, 5_000), (3, 4)) for i in range(n)]
        table = spark.createDataFrame(rows, "key long, i long, digest binary, n_bytes long")
        got = prefixes.numbered(table, [table.i]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, state = set(), {}
    for k, i, digest, _ in rows:
        before = state.get(k, [0] * 4)
        lanes = [int.from_bytes(digest[8 * j : 8 * j + 8], "big") for j in range(4)]
        state[k] = [(p + x % prefixes.PRIME * pow(b, i + 1, prefixes.PRIME)) % prefixes.PRIME for p, x, b in zip(before, lanes, prefixes.BASES, strict=True)]
        want.add((k, i + 1, *state[k], *before))
    assert {(r.key, r.position, *(r[d] for d in prefixes.DIGESTS)) for r in got} == want


def test_parentheses():
    rng = np.random.default_rng(7)
    for n in (1, 2, 63, 64, 65, 5_000):
        bits, depth = [], 0
        for left in range(2 * n, 0, -1):
            up = depth == 0 or (depth < left and rng.random() < 0.55)
            bits.append(up)
            depth += 1 if up else -1
        tree = prefix_trie.Parentheses(np.array(bits))
        stack, close, leaves = [], {}, {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                close[stack.pop()] = i
        opens = np.array(sorted(close))
        assert tree.find_close(opens).tolist() == [close[o] for o in opens.tolist()]
        leaves = [sum(bits[i] and not bits[i + 1] for i in range(o, close[o])) for o in opens.tolist()[:200]]
        assert tree.leaves(opens, tree.find_close(opens)).tolist()[:200] == leaves
    deep = np.repeat([True, False], 100_000)
    assert prefix_trie.Parentheses(deep).find_close(np.arange(3)).tolist() == [199_999, 199_998, 199_997]
