"""A quality classifier without labels.

Heuristic labellers vote on each document: junk, good, or nothing. They overlap
and err, each in its own way. Expectation-maximisation works out, from how their
votes agree, what each class votes how often (Dawid and Skene), and with that the
posterior of junk for each pattern of votes. The posteriors are the labels on
which a linear scorer over hashed features is trained; it judges every document.

* Votes are Spark expressions. The patterns are counted over all documents; their
  number is at most 3 to the number of labellers, whatever the input's size.
* The scorer trains on a sample of at most about ``TRAIN_DOCS`` distinct texts drawn
  by their hash, so that no text or id that repeats can fill it: a few parts, by hash
  as well, fit the weights on their own rows and the weights are averaged, in rounds.
* All documents are scored, in one pass without a shuffle.

Results in special cases: a text without words (or null) is rejected with score 0;
repeated rows score alike; a null ``doc_id`` stays null; a table in which no
labeller votes keeps what has words; an empty table gives no rows; other columns
play no part.
"""

from __future__ import annotations

import functools
import math
import operator
import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import signals
from tidemark.llm.text_batches import column, map_texts
from tidemark.session import materialize, ship_package

JUNK, NONE, GOOD = -1, 0, 1
#: Documents in the training sample (about), hash slots of the scorer, rounds, passes a round, step.
TRAIN_DOCS, SLOTS, ROUNDS, PASSES, STEP = 20_000, 1 << 12, 3, 4, 0.5
#: Parts of the sample on which weights are fitted apart, and rounds of expectation-maximisation.
PARTS, EM_ROUNDS = 4, 100


def _vote(junk: Column, good: Column) -> Column:
    return F.when(junk, JUNK).when(good, GOOD).otherwise(NONE)


def labellers(text: Column, own: Column) -> dict[str, Column]:
    """The votes on a text, given its words."""
    n = F.size(own)
    per_word = lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0))
    symbols = per_word(signals.n_chars_of(text, "#*$%&|<>~^"))
    marks = per_word(signals.n_chars_of(text, "!?"))
    letters = F.length(F.coalesce(text, F.lit("")))
    capitals = F.coalesce(F.try_divide(signals.n_chars_of(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), letters), F.lit(0.0))
    distinct = per_word(F.size(F.array_distinct(own)))
    echoes = per_word(F.size(F.filter(own, lambda w, i: w == F.get(own, i - 1))))
    stops = per_word(F.size(F.filter(own, lambda w: w.isin(signals.STOP_WORDS))))
    lines = signals.lines_with_words(text)
    repeated = F.coalesce(F.try_divide(signals.n_dup_lines(lines), F.size(lines)), F.lit(0.0))
    length = per_word(signals.n_chars_of(text, "") + letters)
    return {
        "symbols": _vote(symbols > 0.25, symbols < 0.05),
        "marks": _vote(marks > 0.5, marks < 0.1),
        "capitals": _vote((n >= 5) & (capitals > 0.3), capitals < 0.08),
        "variety": _vote((n >= 30) & (distinct < 0.45), (n >= 30) & (distinct > 0.6)),
        "echoes": _vote((n >= 10) & (echoes > 0.15), (n >= 10) & (echoes < 0.05)),
        "stop_words": _vote((n >= 30) & (stops < 0.05), (n >= 30) & (stops.between(0.1, 0.5))),
        "lines": _vote(repeated > 0.4, (repeated == 0) & (F.size(lines) > 1)),
        "length": _vote((n >= 30) & ((length < 4.0) | (length > 9.0)), length.between(5.0, 7.0)),
    }


def votes(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns ``keep`` and ``votes``, a string with a character (-, 0, +) for each labeller."""
    kept = F.struct(*map(column, keep)) if keep else F.lit(None)
    split = docs.select(kept.alias("kept"), F.col("text").alias("text"), signals.words(F.col("text")).alias("words"))
    each = labellers(F.col("text"), F.col("words"))
    sign = lambda v: F.when(v == JUNK, "-").when(v == GOOD, "+").otherwise("0")
    return split.select(*(F.col("kept")[c].alias(c) for c in keep), F.concat(*(sign(v) for v in each.values())).alias("votes"), F.size("words").alias("n_words"))


def fit_accuracies(patterns: dict[str, int]) -> tuple[np.ndarray, float]:
    """How often each labeller votes what on either class, and the share of junk.

    The table has axes labeller, class (junk, good) and vote (-, +), among the votes that are cast: to abstain says
    nothing on the class. One call a corpus, over the distinct patterns.
    """
    keys = list(patterns)
    weights = np.array([patterns[k] for k in keys], float)
    votes_of = np.array([["-0+".index(c) for c in k] for k in keys])
    one_hot = np.eye(3)[votes_of][:, :, [0, 2]]  # pattern, labeller, vote
    n_junk, n_good = (votes_of == 0).sum(axis=1), (votes_of == 2).sum(axis=1)
    junk = np.clip((n_junk + 0.1) / (n_junk + 0.35 * n_good + 0.2), 0.02, 0.98)
    table, share = np.empty((votes_of.shape[1], 2, 2)), 0.5
    for _ in range(EM_ROUNDS):
        for c, belief in enumerate((junk, 1 - junk)):
            table[:, c] = np.einsum("p,plv->lv", weights * belief, one_hot) + 0.5
        table /= table.sum(axis=2, keepdims=True)
        share = float(np.clip((weights * junk).sum() / weights.sum(), 1e-4, 1 - 1e-4))
        junk = posterior(keys, table, share)
    return table, share


def posterior(keys: list[str], table: np.ndarray, share: float) -> np.ndarray:
    """The probability of junk given each pattern of votes."""
    logs = np.log(table)
    out = []
    for key in keys:
        cast = [(i, "-+".index(c)) for i, c in enumerate(key) if c != "0"]
        odds = math.log(share / (1 - share)) + sum(logs[i, 0, v] - logs[i, 1, v] for i, v in cast)
        out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    return np.array(out)


_RUNS = ((re.compile(r"[a-zà-öø-ÿ]+"), "a"), (re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"[0-9]+"), "0"), (re.compile(r"(.)\1+"), r"\1"))


#: Characters from which a word counts by the signs it is made of, and signs of its shape at a time.
LONG_WORD, GRAM = 41, 4


def _shape(word: str) -> str:
    for run, sign in _RUNS:
        word = run.sub(sign, word)
    return word


class Shapes(dict):
    """Slots of shapes of words (in UTF-8): runs of letters, capitals and digits as one sign each; -1 for a long word."""

    def __missing__(self, word: bytes) -> int:
        text = word.decode("utf-8", "surrogatepass")
        if len(text) >= LONG_WORD:
            return -1
        slot = _slot_of_shape(_shape(text))
        if len(self) < 400_000 and len(word) <= 16:
            self[word] = slot
        return slot


def _slot_of_shape(shape: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest("shape " + shape) % SLOTS


def _with_long_words(own: list[bytes], slots: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Slots and counts with those of the long words, and their sum.

    A long word counts as the words of its length would, dealt over all runs of ``GRAM`` signs of its whole shape;
    these share their slots with short words of that shape. Linear in the word's length.
    """
    totals = np.zeros(SLOTS)
    totals[slots[1:]] = counts[1:]
    for data in own:
        if len(data) >= LONG_WORD and len(word := data.decode("utf-8", "surrogatepass")) >= LONG_WORD:
            shape = _shape(word)
            grams = Counter(map("".join, zip(*(shape[i:] for i in range(min(GRAM, len(shape)))), strict=False)))
            each = len(word) / (LONG_WORD - 1) / grams.total()
            for gram, count in grams.items():
                totals[_slot_of_shape(gram)] += each * count
    slots = np.flatnonzero(totals)
    return slots, totals[slots], float(totals.sum())


@functools.cache
def _slot(name: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(name) % SLOTS


def _steps(name: str, share: float) -> list[int]:
    """A slot for each tenth that ``share`` reaches, so that near shares have most slots in common."""
    return [_slot(f"{name} {tenth}") for tenth in range(1, min(10, int(share * 10)) + 1)]


def features(text: str, shapes: Shapes) -> tuple[list[int], list[float]]:
    """Slots and values of a text: shares of word shapes, and in tenths those of words met before, words like the one before, and stop words."""
    own = text.encode("utf-8", "surrogatepass").split()  # of bytes: the same white space as the votes have
    if not own:
        return [], []
    n = len(own)
    slots, counts = np.unique(np.fromiter(map(shapes.__getitem__, own), np.int64, n), return_counts=True)
    units = n
    if slots[0] < 0:
        slots, counts, units = _with_long_words(own, slots, counts)
    same = sum(map(operator.eq, own, own[1:])) / n
    stop = sum(map(_STOP.__contains__, own)) / n
    size = "short" if n < 30 else "long"
    extra = [_slot("bias " + size), *_steps("met before " + size, 1 - len(set(own)) / n), *_steps("same", same), *_steps("stop " + size, stop)]
    return [*slots.tolist(), *extra], [*np.sqrt(counts / units).tolist(), *[0.5] * len(extra)]


_STOP = frozenset(w.encode() for w in signals.STOP_WORDS)


def _featurize(texts: list[str]) -> dict[str, list]:
    shapes = Shapes()
    made = [features(t, shapes) for t in texts]
    return {"slots": [m[0] for m in made], "values": [m[1] for m in made]}


def _fit_part(weights: np.ndarray):
    """Weights after a few passes of stochastic gradient steps over a part's rows, in the order of their hashes."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        b = part.sort_values("hash")
        rows = [(np.array(s, np.int64), np.array(v), w, t) for s, v, w, t in zip(b["slots"], b["values"], b["weight"], b["target"], strict=True)]
        own, squares = weights.copy(), np.full(SLOTS, 1e-2)
        for _ in range(PASSES):
            for slots, values, weight, target in rows:
                z = float(np.dot(own[slots], values))
                slope = weight * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - target) * values
                squares[slots] += slope * slope
                own[slots] -= STEP * slope / np.sqrt(squares[slots])
        return pd.DataFrame({"rows": [len(rows)], "weights": [own.tolist()]})

    return run


class QualityModel:
    """The trained scorer, with the labellers' table for inspection."""

    def __init__(self, weights: np.ndarray, table: np.ndarray | None, share: float):
        self.weights, self.table, self.share = weights, table, share

    def score(self, docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
        """Columns ``keep``, the probability ``score`` that a document is good, and ``kept``."""
        weights = self.weights

        def run(texts: list[str]) -> dict[str, list]:
            shapes = _shapes()
            scores = []
            for text in texts:
                slots, values = features(text, shapes)
                z = float(np.dot(weights[slots], values)) if slots else 30.0
                scores.append(1 / (1 + math.exp(max(-30.0, min(30.0, z)))) if slots else 0.0)
            return {"score": scores, "kept": [s >= 0.5 for s in scores]}

        return map_texts(run, docs, keep, "text", pa.schema([("score", pa.float64()), ("kept", pa.bool_())]))


_worker_shapes: list[Shapes] = []


def _shapes() -> Shapes:
    """One memo a worker."""
    if not _worker_shapes:
        _worker_shapes.append(Shapes())
    return _worker_shapes[0]


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> QualityModel:
    """Train the scorer on the texts of ``docs``; ``train_docs`` bounds the sample, about."""
    ship_package(docs.sparkSession)
    counted = votes(docs).where("n_words > 0").groupBy("votes").count().collect()
    patterns = {r["votes"]: r["count"] for r in counted}
    if not patterns:
        return QualityModel(np.zeros(SLOTS), None, 0.0)
    table, share = fit_accuracies(patterns)
    total, grain = sum(patterns.values()), 1 << 30
    drawn = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(grain)) < F.lit(int(grain * min(1.0, train_docs / total)))).distinct()
    voted = votes(drawn, ("text",)).where("n_words > 0")
    keys = ["".join(p) for p in product("-0+", repeat=table.shape[0])]
    known = dict(zip(keys, posterior(keys, table, share).tolist(), strict=True))
    target = F.element_at(F.from_json(F.lit(pd.Series(known).to_json(double_precision=6)), "map<string,double>"), F.col("votes"))
    schema = pa.schema([("slots", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
    rows = map_texts(_featurize, voted.select(target.alias("target"), F.xxhash64("text").alias("hash"), "text"), ("target", "hash"), "text", schema)
    # Either class has half of the weight.
    weight = F.when(F.col("target") >= 0.5, 0.5 / max(share, 0.02)).otherwise(0.5 / max(1 - share, 0.02))
    sample = materialize(rows.withColumns({"weight": F.least(weight, F.lit(10.0)), "part": F.pmod("hash", F.lit(PARTS))}), "training")
    weights = np.zeros(SLOTS)
    for _ in range(ROUNDS):
        fitted = sample.groupBy("part").applyInPandas(_fit_part(weights), "rows long, weights array<double>").collect()
        if not fitted:
            break
        fitted.sort(key=lambda f: (f["rows"], f["weights"]))
        weights = np.average([f["weights"] for f in fitted], axis=0, weights=[f["rows"] for f in fitted])
    return QualityModel(weights, table, share)
