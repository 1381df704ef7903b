"""The source divergence audit against a plain version, copies and odd rows, and many sources."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tidemark.llm import divergence


def plain(rows, least=30, most=50):
    docs = [(a or "", b or "", regex.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))) for a, b, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t in df if df[t] >= least)
        counts = defaultdict(Counter)
        for _, source, terms in own:
            counts[source].update(t for t in terms if t in set(kept))
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        for s in counts:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s)
            terms = sorted((-(p[s][t] - q[t]), t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t])[:most]
            out += [(lang, s, part, item, -v, rank) for part, found in (("pair", pairs), ("term", terms)) for rank, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


def found(spark, rows, **more):
    table = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 as term", "2 as n", "3 as item", "4 as cells", "5 as v", "6 as digest")
    return sorted(tuple(r) for r in divergence.divergence(spark, table.repartition(5), **more).select("lang", "source", "part", "item", "value", "rank").collect())


def test_against_the_plain_version(spark):
    rng = random.Random(5)
    words = ["the", "The", "né", "Né", "a1b", "x_y", "œuf", "日本", "zz", "q"] + [f"w{c}{d}" for c in "abcdef" for d in "abc"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(60)]
    rows = [(rng.choice(["en", "en", "fr", None, ""]), rng.choice(["a", "b", "é", None, "Z"]), rng.choice([*texts, None, "", texts[0]])) for _ in range(500)]
    rows += [("en", f"s{i % 7}", texts[0]) for i in range(300)] + [("xx", "alone", "nothing kept"), ("yy", "p", "one"), ("yy", "q", None)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows, least_docs=3, most_terms=2) == plain(rows, 3, 2)
    assert found(spark, []) == []


def test_very_long_texts_and_copies(spark):
    long = "alpha beta " * 150_000
    rows = [("en", "a", long)] * 3 + [("en", "b", long.upper())] + [("en", "b", "beta")] * 40
    assert found(spark, rows, least_docs=2) == plain(rows, 2)


def test_a_text_goes_out_once_a_stretch(spark):
    """Copies that a third of all rows hold meet in the task before they are dealt."""
    docs = spark.range(9_000, numPartitions=3).select(F.lit("en").alias("lang"), (F.col("id") % 4).cast("string").alias("source"), F.when(F.col("id") % 3 == 0, F.lit("a " * 500)).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    named = docs.select("lang", "source", F.unhex(F.sha2("text", 256)).alias("digest"), "text")
    rows = named.mapInArrow(divergence._collapse, divergence.COPIES).where("n_bytes = 1000")
    got = rows.collect()
    assert len(got) == 3 and sum(sum(r.copies) for r in got) == 3_000


@pytest.mark.parametrize("count", [7, 4_000_000_000_000])
def test_shares_are_exact(spark, count):
    n, v = 3 * count + 11, 17
    want = 1 + 10**9 * (count + 5) // (n + 5 * v)
    assert divergence.shares(np.array([count]), np.array([n + 5 * v])).tolist() == [want]
    assert spark.range(1).select(divergence.share(F.lit(count), F.lit(n), F.lit(v))).first()[0] == want


def test_blocks_of_sources(spark):
    """More sources than a block has: pairs across blocks, both ways."""
    rng = random.Random(9)
    rows = [("en", f"s{i:04d}", " ".join(rng.choices(["ab", "cd", "ef", "gh"], k=4))) for i in range(divergence.BLOCK + 20)]
    got = [r for r in found(spark, rows, least_docs=2) if r[2] == "pair"]
    assert len(got) == len(rows) * (len(rows) - 1)
    some = {r[1] for r in rows[::97]}
    assert [r for r in got if r[1] in some] == [r for r in plain(rows, 2) if r[2] == "pair" and r[1] in some]
