"""Stages of the pipeline against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import mixing, ngram_join


def test_one_of_each_is_brute_force(spark):
    rnd, rows = random.Random(8), []
    for i in range(120):
        words = rnd.choice(rows)[1].split() if rows and rnd.random() < 0.6 else [f"w{rnd.randrange(500)}" for _ in range(rnd.randint(3, 60))]
        for _ in range(rnd.choice([0, 0, 1, 3])):
            words[rnd.randrange(len(words))] = f"w{rnd.randrange(500)}"
        rows.append((i, " ".join(words)))
    sets = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for w in (t.split() for _, t in rows)]
    least = list(range(len(rows)))
    for _ in rows:  # until nothing changes, at most
        for i in range(len(rows)):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    least[i] = least[j] = min(least[i], least[j])
    want = {i for i in range(len(rows)) if least[i] == i}
    docs = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string")
    got = [r.doc_id for r in ngram_join.one_of_each(spark, docs).collect()]
    assert 10 < len(want) < 110 and Counter(got) == Counter([*want, None])


def test_mix_and_take_are_brute_force(spark):
    rnd = random.Random(9)
    kinds = [(1, 0, [f"clean{i}" for i in range(30)])] * 14 + [(0, 0, ["spam", "#*$%", "buy!!", "now!!", "&|<>"])] * 5 + [(1, 1, ["nasty", "vile", *[f"clean{i}" for i in range(30)]])]
    docs, labels = [], []
    for i in range(3_000):
        quality, toxic, words = rnd.choice(kinds)
        docs.append((i, " ".join([*rnd.choices(words, k=20), *(["nasty", "vile"] if toxic else [])])))
        labels.append((i, quality, toxic))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    mixed, model = mixing.mix(docs, labels)
    found = mixed.toPandas()
    posterior, tokens = np.array(found.posterior.tolist()), found.n_tokens.to_numpy()
    present = tokens @ posterior
    weights = np.array([mixing.TARGETS.get(d, 0.0) for d in model.domains])
    main = weights.argmax()
    target = weights * present[main] / weights[main]
    assert (found.rate * tokens) @ posterior == pytest.approx(target, abs=0.01 * present[main])
    # Drawn totals are within four standard errors of the draw.
    fraction = (found.rate % 1).to_numpy()
    error = np.sqrt((fraction * (1 - fraction)) @ (tokens[:, None] * posterior) ** 2)
    assert (np.abs((found.copies * tokens) @ posterior - (found.rate * tokens) @ posterior) <= 4 * error + 1e-6 * present[main]).all()
    assert ((found.copies - found.rate).abs() <= 1).all()
    taken = Counter(r.doc_id for r in mixing.take(docs, labels).collect())
    assert taken == Counter({d: c for d, c in zip(found.doc_id, found.copies, strict=True) if c})
