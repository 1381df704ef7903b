"""Mixing a corpus to target weights of domains that a labelled table defines.

A table of labels says for some documents which domain they belong to (a domain
is a combination of label values). A naive Bayes classifier over telling words,
language and signs of the text is fitted on a bounded sample of labelled
documents and gives every document a posterior over domains: soft membership. The
rates at which documents are taken are then fitted: nonnegative, with the
expected tokens of each domain, ``sum(rate * tokens * posterior)``, as close to
the targets as they can be in least squares.

The fit is projected gradient descent from rate 1. In the metric of document
tokens a step moves a document's rate by ``posterior . y`` for one vector ``y`` of
a number per domain, and the best such step solves a system of that size, whose
matrix ``sum(tokens * posterior posterior')`` one aggregation gives. Rates that
would go negative stop at 0. Each iteration is one aggregation over a small table
(tokens and posterior); rates are an expression of the steps so far and are never
stored. A document's rate becomes a whole number of copies by a hash of its id, up
with the probability of its fraction: drawn totals are right in expectation, with a
variance of ``sum(f (1 - f) (tokens * posterior)^2)`` over the fractions f.

Everything on documents is DataFrame functions; the driver sees vectors and
matrices of one number per domain (or pair of domains) only.

Results in special cases: a null or empty text has no tokens, rate 1 and belongs
to the domains by their shares; documents that repeat are rated alike; a null
``doc_id`` hashes like any value; a domain that has less than its share gets rates
above 1 and its documents come more than once (``most`` caps rates; there is no cap
by default); a target domain without documents is left out; without labelled
documents all are one domain and every rate is 1; an empty table gives no rows;
other columns play no part and may have any names.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import signals
from tidemark.llm.text_batches import column
from tidemark.session import materialize

#: Labelled documents in the sample (about); telling words a label; least documents and least share of a value's documents with one; least gap in log-rates.
SAMPLE_DOCS, TELLING_WORDS, LEAST_WITH, LEAST_SHARE, LEAST_GAP = 6_000, 100, 5, 0.05, 3.0
#: Iterations of projected gradient descent at most, and the relative residual at which it ends.
MOST_STEPS, TOLERANCE = 20, 1e-4

#: Target weights by domain, "quality/toxic" of the labels; other domains get none.
TARGETS = {"1/0": 0.96, "1/1": 0.03, "0/0": 0.01}

BITS = 1 << 30


def _signs(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Columns ``keep`` in a struct, the number of words, the distinct words, and signs of the text as small whole numbers.

    Each is worked out once, in a projection of its own, as the model refers to it many times.
    """
    kept = F.struct(*map(column, keep)) if keep else F.lit(None)
    split = docs.select(kept.alias("kept"), F.col("text").alias("text"), signals.words(F.col("text")).alias("words"))
    counted = split.select("kept", "text", F.size("words").alias("n"), F.array_distinct("words").alias("distinct"))
    share = lambda x: F.least(F.lit(4), F.floor(F.coalesce(F.try_divide(x * 5, F.col("n")), F.lit(0.0)))).cast("int")
    text = F.col("text")
    values = (share(signals.n_chars_of(text, "#*$%&|<>")), share(signals.n_chars_of(text, "!?")), share(F.size("distinct")))
    return counted.select("kept", "n", "distinct", *(v.alias(name) for v, name in zip(values, SIGNS, strict=True)))


#: Symbols and marks a word, and share of distinct words, in fifths.
SIGNS = ("symbols", "marks", "variety")


def _tokens_of(distinct: Column) -> Column:
    """Distinct words in lower case without marks at their ends."""
    return F.transform(distinct, lambda w: F.lower(F.btrim(w, F.lit(".,;:!?\"'()"))))


class LabelModel:
    """Naive Bayes of one label column: log-probabilities by its values."""

    def __init__(self, values: list[str], base: np.ndarray, words: dict[str, np.ndarray], bins: dict[tuple[str, int], np.ndarray]):
        self.values, self.base, self.words, self.bins = values, base, words, bins

    def posterior(self, found: Column) -> Column:
        """An array with a probability for each value, over ``_signs``; ``found`` are the text's distinct telling words."""
        vector = lambda v: F.array(*(F.lit(float(x)) for x in v))
        add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
        nothing, score = vector(np.zeros(len(self.values))), vector(self.base)
        if self.words:
            table = F.create_map(*(c for w, v in self.words.items() for c in (F.lit(w), vector(v))))
            score = F.aggregate(found, score, lambda acc, w: add(acc, F.coalesce(F.try_element_at(table, w), nothing)))
        for name in SIGNS:
            known = F.array(*(vector(self.bins[name, b]) for b in range(5)))
            score = add(score, F.when(F.col("n") > 0, F.get(known, F.col(name))).otherwise(nothing))
        raised = lambda s: F.transform(s, lambda x: F.exp(x - F.array_max(s)))
        normal = lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))
        return signals.let(signals.let(score, raised), normal)


class DomainModel:
    """Domains are combinations of the label columns' values, taken as independent given the text."""

    def __init__(self, models: list[LabelModel]):
        self.models = models
        self.domains = ["/".join(v) for v in product(*(m.values for m in models))] if models else ["all"]

    def posterior(self) -> Column:
        """An array with a probability for each domain, over ``_signs``."""
        if not self.models:
            return F.array(F.lit(1.0))
        telling = sorted({w for m in self.models for w in m.words})
        found = F.array_intersect(_tokens_of(F.col("distinct")), F.array(*map(F.lit, telling))) if telling else F.array().cast("array<string>")
        each = signals.let(found, lambda f: F.array(*(m.posterior(f) for m in self.models)))
        picks = list(product(*(range(len(m.values)) for m in self.models)))
        product_of = lambda e, pick: reduce(lambda a, b: a * b, (F.get(F.get(e, F.lit(i)), F.lit(k)) for i, k in enumerate(pick)))
        return signals.let(each, lambda e: F.array(*(product_of(e, pick) for pick in picks)))


def _fit_label(sample: DataFrame, column: str) -> LabelModel:
    totals = {r[column]: r["count"] for r in sample.groupBy(column).count().collect()}
    values = sorted(totals)
    total = np.array([totals[v] for v in values], float)
    # Words that one value has in a fair share of its documents and another hardly ever. A bounded list.
    counts = sample.select(column, F.explode("words").alias("word")).where("length(word) between 1 and 40").groupBy("word").pivot(column, values).count().na.fill(0)
    seen = [F.col(f"`{v}`") for v in values]
    logs = F.array(*(F.log((c + 0.5) / (n + 1.0)) for c, n in zip(seen, total, strict=True)))
    # Not for the most frequent value: what it has everywhere, documents of another language lack too.
    rarer = [(c, n) for c, n in zip(seen, total, strict=True) if n < total.max()]
    common = reduce(lambda a, b: a | b, ((c >= LEAST_WITH) & (c >= LEAST_SHARE * n) & (F.log((c + 0.5) / (n + 1.0)) == F.array_max(logs)) for c, n in rarer), F.lit(False))
    often = counts.where(common & (F.array_max(logs) - F.array_min(logs) >= LEAST_GAP))
    telling = often.orderBy(F.desc(sum(seen)), "word").limit(TELLING_WORDS).collect()
    base, words = np.log((total + 1) / (total + 1).sum()), {}
    for r in telling:
        p = (np.array([r[v] for v in values]) + 0.5) / (total + 1)
        base += np.log1p(-p)
        words[r["word"]] = np.log(p) - np.log1p(-p)
    by_bin = {}
    for name in SIGNS:
        table = {r[name]: [r[v] for v in values] for r in sample.groupBy(name).pivot(column, values).count().na.fill(0).collect()}
        for b in range(5):
            by_bin[name, b] = np.log((np.array(table.get(b, [0] * len(values))) + 0.2) / (total + 1.2))
    return LabelModel(values, base, words, by_bin)


def fit_domains(docs: DataFrame, labels: DataFrame, columns: tuple[str, ...] = ("quality", "toxic"), sample_docs: int = SAMPLE_DOCS) -> DomainModel:
    """Fit on about ``sample_docs`` labelled documents, drawn by a hash of doc_id."""
    known = labels.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in ("doc_id", *columns))))
    known = known.groupBy("doc_id").agg(F.min(F.struct(*(F.col(c).cast("string").alias(c) for c in columns))).alias("label"))
    n_labels = known.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(BITS)) < F.lit(int(BITS * min(1.0, sample_docs / max(1, n_labels))))
    # A row for each doc_id, so that one that repeats can't fill the sample.
    drawn = docs.where(draw).groupBy("doc_id").agg(F.min("text").alias("text"))
    texts = drawn.join(known.where(draw), "doc_id").select("label.*", "text")
    sample = materialize(_signs(texts, columns).select("kept.*", F.array_distinct(_tokens_of(F.col("distinct"))).alias("words"), *SIGNS), "labelled")
    if sample.isEmpty():
        return DomainModel([])
    return DomainModel([_fit_label(sample, c) for c in columns])


def _rate(steps: list[np.ndarray], most: float | None = None) -> Column:
    """The rate after ``steps``: from 1, each step less ``posterior . y``, never below 0 (nor above ``most``)."""
    size = len(steps[0]) if steps else 0
    if not steps:
        return F.lit(1.0)
    table = F.array(*(F.array(*(F.lit(float(x)) for x in y)) for y in steps))
    dot = lambda y: sum(F.get(F.col("posterior"), F.lit(i)) * F.get(y, F.lit(i)) for i in range(size))
    capped = lambda rate: rate if most is None else F.least(F.lit(float(most)), rate)
    return F.aggregate(table, F.lit(1.0), lambda rate, y: capped(F.greatest(F.lit(0.0), rate - dot(y))))


def fit_rates(members: DataFrame, weights: np.ndarray, most: float | None = None) -> list[np.ndarray]:
    """Steps that bring the expected tokens by domain of ``members`` (n_tokens, posterior) to ``weights`` of a total.

    The total is such that the domain of the largest weight is expected as often as it is there.
    """
    size = len(weights)
    p = [F.get(F.col("posterior"), F.lit(i)) for i in range(size)]
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    first = members.agg(*(F.sum(F.col("n_tokens") * p[i] * p[j]) for i, j in pairs), *(F.sum(F.col("n_tokens") * p[i]) for i in range(size))).first()
    if first[0] is None:
        return []
    matrix = np.zeros((size, size))
    for (i, j), value in zip(pairs, first, strict=False):
        matrix[i, j] = matrix[j, i] = value
    present = np.array(first[len(pairs) :], float)
    wanted = np.where(present > 0, weights, 0.0)
    if not wanted.any():
        return []
    main = int(wanted.argmax())
    target = wanted * present[main] / weights[main]
    steps: list[np.ndarray] = []
    inverse = np.linalg.pinv(matrix + np.eye(size) * 1e-9 * np.trace(matrix))
    best, best_steps = math.inf, steps
    for _ in range(MOST_STEPS):
        rate = _rate(steps, most)
        now = members.agg(*(F.sum(rate * F.col("n_tokens") * p[i]) for i in range(size))).first()
        residual = np.array(now, float) - target
        error = float(np.linalg.norm(residual) / np.linalg.norm(target))
        if error < best * 0.999:
            best, best_steps = error, list(steps)
        elif len(steps) > len(best_steps) + 3:
            break
        if error < TOLERANCE:
            break
        steps.append(inverse @ residual)
    return best_steps


def memberships(docs: DataFrame, model: DomainModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` in a struct ``kept``, n_tokens (words) and posterior of every document."""
    return _signs(docs, keep).select("kept", F.col("n").cast("long").alias("n_tokens"), model.posterior().alias("posterior"))


def copies(rate: Column, doc_id: Column) -> Column:
    """The rate as a whole number: up or down by a hash of the id, right in expectation."""
    return F.floor(rate + F.pmod(F.xxhash64(doc_id, F.lit(17)), F.lit(BITS)) / F.lit(float(BITS))).cast("int")


def _rated(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None, keep: tuple[str, ...], most: float | None) -> tuple[DataFrame, DomainModel]:
    """kept, n_tokens, posterior, rate and copies, and the model. Texts are judged once; the fit reads only tokens and posteriors."""
    targets = TARGETS if targets is None else targets
    model = fit_domains(docs, labels)
    members = materialize(memberships(docs, model, keep), "members")
    steps = fit_rates(members, np.array([targets.get(d, 0.0) for d in model.domains]), most)
    return members.withColumn("rate", _rate(steps, most)).withColumn("copies", copies(F.col("rate"), F.col("kept.doc_id"))), model


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, most: float | None = None) -> tuple[DataFrame, DomainModel]:
    """doc_id, n_tokens, posterior, rate, copies of every document, and the model."""
    rated, model = _rated(docs, labels, targets, ("doc_id",), most)
    return rated.select("kept.doc_id", "n_tokens", "posterior", "rate", "copies"), model


def take(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, most: float | None = None) -> DataFrame:
    """The documents as often as their rates say, with their own columns. No join, and so no shuffle, of the texts."""
    rated, _ = _rated(docs, labels, targets, tuple(docs.columns), most)
    return rated.where("copies > 0").select("kept", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("kept.*")
