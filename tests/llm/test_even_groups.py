"""The near-duplicate join's exchange of shingles: groups of bounded size, and hits as brute force counts them."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import ngram_join


def batches(rows):
    return iter([pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows])})])


def through(sent: list[pa.RecordBatch]) -> dict:
    table = pa.Table.from_batches(sent)
    back = pa.concat_tables([ngram_join._settle(table.filter(pa.compute.equal(table.column("bucket"), b))) for b in pa.compute.unique(table.column("bucket")).to_pylist()], promote_options="permissive")
    found = [ngram_join._add_up(back.filter(pa.compute.equal(back.column("flush"), f))) for f in pa.compute.unique(back.column("flush")).to_pylist()]
    return pa.concat_tables(found).to_pylist()


@pytest.mark.parametrize(("ids", "text"), [(range(120_000), "one two three four five six"), ([None] * 120_000, ""), ([7] * 120_000, "")])
def test_repeated_rows_are_few_rows(ids, text):
    sent = list(ngram_join._profile(16)(batches([(i, text) for i in ids])))
    owners = [b for b in sent if b.column("fps")[0].is_valid]
    assert len(owners) == 3 and max(len(b.column("doc_ids")[0]) for b in owners) == ngram_join.MOST_OWNERS and len(sent) <= 3 + 16


def test_hits_are_brute_force(monkeypatch):
    monkeypatch.setattr(ngram_join, "SETTLE_SHINGLES", 60)
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice("abc") for _ in range(rnd.randint(1, 9)))) for i in range(200)]
    made = iter(range(0, 1 << 40, 1 << 32))
    monkeypatch.setattr(ngram_join, "_first_flush", lambda: next(made))
    sent = [b for part in (rows[:90], rows[90:]) for b in ngram_join._profile(7)(batches(part))]
    found = {r["doc_id"]: r for r in through(sent)}
    sets = [set(ngram_join.shingle_set(t, ngram_join.WordHashes()).tolist()) for _, t in rows]
    for i, own in enumerate(sets):
        others = set().union(*(s for s in sets if s != own))
        copies = any(s == own for j, s in enumerate(sets) if j != i)
        first = next(j for j, s in enumerate(sets) if s == own)
        assert found[i]["n"] == len(own)
        if not copies:
            assert found[i]["hits"] == len(own & others)
        elif first == i:  # a copy in another task counts as another set
            assert len(own & others) <= found[i]["hits"] <= len(own)


@pytest.mark.parametrize("spread", [True, False])  # or most shingles have a remainder in common
def test_components_know_their_own_shingles(monkeypatch, spread):
    monkeypatch.setattr(ngram_join, "SETTLE_SHINGLES", 20)
    rnd = np.random.default_rng(4)
    owners = rnd.integers(0, 12, 80)
    sets = [np.unique(rnd.integers(0, 400, rnd.integers(1, 9)).astype("<u8") << np.uint64(31)) for _ in owners]
    sets = [np.sort(ngram_join._mixed(s)) for s in sets] if spread else sets
    batch = pa.RecordBatch.from_pydict({"component": owners, "n": [len(s) for s in sets], "grams": pa.array([s.tobytes() for s in sets], pa.binary())})
    total = {}
    for r in through(list(ngram_join._profile_components(5)(iter([batch])))):
        total[r["fp"]] = total.get(r["fp"], 0) + r["hits"]
    grams = {o: set(np.concatenate([s for s, p in zip(sets, owners, strict=True) if p == o]).tolist()) for o in set(owners.tolist())}
    for o, own in grams.items():
        others = set().union(*(g for p, g in grams.items() if p != o))
        assert total[o] >= len(own & others)
        assert not spread or own & others or total[o] == 0
