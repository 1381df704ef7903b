"""The near-duplicate join sends no set to all parts of a large block, no text that its result doesn't need, and leaves no shuffle files."""

import glob
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ngram_join
from tidemark.llm.id_bitmaps import having
from tidemark.session import CLEAN_UP, materialize, shared_folder


def near_misses(n: int, common: int, seed: int) -> list[str]:
    """Pairs of texts a little too different, each with a passage that all texts have, and some links."""
    rnd, texts = random.Random(seed), []
    passage = [f"c{i}" for i in range(common)]
    for i in range(n):
        words = [f"w{i}_{j}" for j in range(60)]
        other = words[: 48 if i % 4 else 58] + [f"x{i}_{j}" for j in range(12 if i % 4 else 2)]
        texts += [" ".join([*passage, *words]), " ".join([*passage, *other])]
    rnd.shuffle(texts)
    return texts


def components(texts: list[str]) -> list[int]:
    sets = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    least = list(range(len(texts)))
    by_gram: dict = {}
    for i, s in enumerate(sets):
        for g in s:
            by_gram.setdefault(g, []).append(i)
    for members in by_gram.values():
        for i in members[1:]:
            a, b = sets[members[0]], sets[i]
            if len(members) == 2 and 100 * len(a & b) >= 75 * len(a | b):
                least[i] = least[members[0]]
    return least


def test_a_large_block_is_not_all_pairs_of_chunks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK_SHINGLES", 500)
    sets = [np.unique(np.concatenate([np.arange(10), 1000 * (i // 2) + np.arange(100, 130), 1_000_000 + 1000 * i + np.arange(2), [5_000_000 + i // 3]])) for i in range(200)]
    rest = spark.createDataFrame([(i, len(s), bytearray(s.astype("<u8").tobytes()), i) for i, s in enumerate(sets)], "fp long, n long, grams binary, component long")
    members = ngram_join._blocks(rest).collect()
    total = sum(map(len, sets))
    blocks: dict = {}
    for r in members:
        blocks.setdefault(r.block, []).append(r.fp)
    sent = sum(sum(len(sets[i]) for i in fps) * -(-sum(len(sets[i]) for i in fps) // 500) for fps in blocks.values())
    assert sent <= 6 * total  # all pairs of chunks: 18 times
    for i in range(200):
        for j in range(i):
            if 7 * len(np.intersect1d(sets[i], sets[j])) >= 3 * (len(sets[i]) + len(sets[j])):
                assert any(i in fps and j in fps for fps in blocks.values())


@pytest.mark.parametrize("chunk", [150, 2_000, 400_000])
def test_blocks_lose_no_link(spark, monkeypatch, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK_SHINGLES", chunk)
    # Near copies mostly meet by their least hashes; here none do, so that the blocks find every link.
    monkeypatch.setattr(ngram_join, "_near_links", lambda sets, groups: spark.createDataFrame([], ngram_join.LINK))
    texts = near_misses(60, 12, 5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(spark, docs).collect()}
    want = components(texts)
    assert [got[i] for i in range(len(texts))] == want and 10 < len(texts) - len(set(want)) < 100


def test_prefixes_take_rare_shingles_first(spark):
    # 1 is in all sets, 10 and up in two, 100 and up in one. Of eight shingles, three come first.
    sets = {1: [1, 10, 11, 12, 13, 14, 15, 16], 2: [1, 10, 11, 12, 13, 14, 15, 16], 3: [1, 100, 101, 102, 103, 104, 105, 106], 4: [1, 2, 20, 21, 22, 23, 24, 200], 5: [1, 2, 20, 21, 22, 23, 24, 201]}
    rest = spark.createDataFrame([(fp, len(s), bytearray(np.array(s, "<u8").tobytes())) for fp, s in sets.items()], "fp long, n long, grams binary")
    found = {}
    for r in ngram_join._prefixes(rest).collect():
        found.setdefault(r.fp, []).append(r.gram)
    assert {fp: sorted(g) for fp, g in found.items()} == {1: [10, 11, 12], 2: [10, 11, 12], 4: [2, 20], 5: [2, 20]}


def test_bitmaps_miss_no_id(spark):
    rows = spark.range(-500, 5_000).select(F.when(F.col("id") != 7, F.col("id")).alias("doc_id"), F.lit("x").alias("able"), F.col("id").alias("row"))
    told = having(rows, "doc_id", able=spark.range(-100, 4_000, 3), none=spark.range(0)).selectExpr("row.doc_id as id", "row.able as text", "able", "none").collect()
    want = set(range(-100, 4_000, 3))
    assert len(told) == 5_500 and not any(r.none for r in told) and {r.text for r in told} == {"x"}
    assert want <= {r.id for r in told if r.able} and sum(r.able for r in told) < len(want) + 20
    assert [r.able for r in told if r.id is None] == [False]


def test_a_written_table_leaves_no_shuffle_files(spark):
    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
    files = lambda: set(glob.glob(f"{folder}/*/shuffle_*"))
    before, was = files(), spark.conf.get(CLEAN_UP)
    assert shared_folder(spark)
    made = materialize(spark.range(20_000).repartition(5, "id").groupBy(F.col("id") % 100).count(), "made")
    for _ in range(50):
        if not files() - before:
            break
        __import__("time").sleep(0.1)
    assert made.count() == 100 and spark.conf.get(CLEAN_UP) == was
    assert not [f for f in files() - before if f.endswith(".data")][1:]  # but what the count above has written


def test_dropped_texts_with_any_columns(spark):
    texts = near_misses(20, 3, 6)
    rows = [(i, t, "a", i, None) for i, t in enumerate([*texts, *texts[:7]])] + [(None, texts[0], "a", 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own string, dropped long, row int")
    kept = ngram_join.one_of_each(spark, docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text, r.dropped) for r in kept.collect())
    want = components(texts)
    assert got == sorted([(False, i, t, i) for i, t in enumerate(texts) if want[i] == i] + [(True, 0, texts[0], 0)])
