"""A toxicity classifier that is held to say the same of every group.

Features of a text are its terms and their beginnings of 4, 5 and 6 characters, each
there or not. Those that are commoner in toxic texts by far (chi-squared) are chosen;
a logistic model over them is fitted to the labels, with a penalty from counterfactual
sentences: in each labelled sentence that names a group, the name is swapped for others
of its kind, and the squared change of the score is penalised. So a group's name, which
may be commoner in toxic texts, can't carry weight of its own, while insults can.

* Labels are learned from a sample of at most about ``TRAIN_DOCS`` labelled documents
  drawn by a hash of their ids, then of their texts, so that no id or text that repeats
  can fill it. The sample's ids are broadcast: that is their bound.
* Features are counted by Spark; at most ``MOST_FEATURES`` are chosen. A few parts of the
  sample, by a hash of the text, fit the weights apart and the weights are averaged.
* All documents are scored, whole, in one pass without a shuffle.

Results in special cases: a null or empty text scores by the share of toxic labels
alone; a null doc_id stays null and isn't held out; labels that are null or of no
document teach nothing, several labels of a document count by their mean; without
labels all scores are 1 / 10; repeated rows score alike; an empty table gives no
rows; other columns play no part.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.terms import TERM, slices, summed, terms_of
from tidemark.llm.text_batches import column, give_back, map_batches
from tidemark.session import materialize, ship_package

#: Documents in the training sample (about), features chosen at most, and of how many toxic texts a feature must be at least.
TRAIN_DOCS, MOST_FEATURES, LEAST_TOXIC = 20_000, 4_096, 3
#: Least chi-squared (fewer than one feature in a hundred thousand by chance), and how many times commoner in toxic texts a feature must be.
LEAST_CHI, LEAST_LIFT = 20.0, 3.0
#: Characters of the beginnings of terms that are features; bytes of text worked on at a time.
BEGINNINGS, CUT_BYTES = (4, 5, 6), 2_000_000
#: Texts in a part that is fitted apart (about), steps of a fit, strength of the penalties on weights and on counterfactual changes, score from which a text is toxic.
PART_DOCS, STEPS, RIDGE, FAIRNESS, TOXIC = 5_000, 400, 0.1, 10.0, 0.3

# Names of groups of people, by kind; a name is swapped for the others of its kind.
GROUPS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("mexican", "chinese", "american", "indian", "russian", "arab", "turkish", "polish"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "athées"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "atheisten"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("cristianos", "musulmanes", "judíos", "ateos"),
)
#: The others of each name's kind.
OTHERS = {name: tuple(n for n in kind if n != name) for kind in GROUPS for name in kind}
_SENTENCE, _TERM = re.compile(r"[^.!?\n]+"), re.compile(TERM)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def named(terms: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Features of terms: their names, one after another, and which term each is of. A beginning ends with a star."""
    terms = terms.view(pa.string())
    lengths = pc.utf8_length(terms).to_numpy(zero_copy_only=False)
    names, of = [terms], [np.arange(len(terms))]
    for k in BEGINNINGS:
        longer = np.flatnonzero(lengths > k)
        names.append(pc.binary_join_element_wise(pc.utf8_slice_codeunits(terms.take(pa.array(longer)), 0, k), "*", ""))
        of.append(longer)
    return pa.concat_arrays(names), np.concatenate(of)


def present(texts: pa.Array, chosen: pa.Array | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The features that occur, and text and feature of each pair that does, once each. With ``chosen``, only these, in that order."""
    terms, codes, owner = terms_of(texts)
    names, of = named(terms)
    if chosen is None:
        encoded = names.dictionary_encode()
        names, number = encoded.dictionary, encoded.indices.to_numpy().astype(np.int64)
    else:
        number = pc.fill_null(pc.index_in(names, value_set=chosen), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        of, number, names = of[number >= 0], number[number >= 0], chosen
    if not len(number) or not len(codes):
        return names, np.empty(0, np.int64), np.empty(0, np.int64)
    # Features by their terms, then a row for each feature of each occurrence of such a term.
    order = np.argsort(of, kind="stable")
    of, number = of[order], number[order]
    n_of = np.bincount(of, minlength=len(terms))
    first = np.cumsum(n_of) - n_of
    counts = n_of[codes]
    at = np.repeat(first[codes] - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
    pairs = np.unique(np.repeat(owner, counts) * len(names) + number[at])
    return names, pairs // len(names), pairs % len(names)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of labelled texts: how many toxic and how many other texts have each feature."""
    for batch in batches:
        for part in slices(batch, "text", CUT_BYTES):
            names, text, feature = present(part.column("text"))
            target = part.column("target").to_numpy()[text]
            key, toxic, clean = summed(feature, target, 1 - target)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(key)), pa.array(toxic), pa.array(clean)], names=["feature", "toxic", "clean"])


def swapped(text: str) -> Iterator[tuple[str, str]]:
    """Each sentence that names a group, and the sentence with that name swapped for another of its kind."""
    lower = text.translate(_LOWER)
    for sentence in _SENTENCE.findall(lower):
        for found in _TERM.finditer(sentence):
            for other in OTHERS.get(found.group(), ()):
                yield sentence, sentence[: found.start()] + other + sentence[found.end() :]


def _training_rows(chosen: list[str]):
    """Of labelled texts: features and values with the label, and with a null label the features that a swap of groups changes."""
    names = pa.array(chosen, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", CUT_BYTES):
                rows = part.num_rows
                _, text, feature = present(part.column("text"), names)
                lists = np.split(feature, np.cumsum(np.bincount(text, minlength=rows))[:-1]) if rows else []
                out = [(h, t, f.tolist(), [1.0] * len(f)) for h, t, f in zip(part.column("hash").to_pylist(), part.column("target").to_pylist(), lists, strict=True)]
                pairs = [(h, *pair) for h, t in zip(part.column("hash").to_pylist(), part.column("text").to_pylist(), strict=True) for pair in dict.fromkeys(swapped(t or ""))]
                for begin in range(0, len(pairs), 10_000):
                    some = pairs[begin : begin + 10_000]
                    _, side, feature = present(pa.array([s for _, *both in some for s in both], pa.string()), names)
                    place, change = summed((side // 2) * len(chosen) + feature, np.where(side % 2 == 0, 1.0, -1.0))
                    place, change = place[change != 0], change[change != 0]
                    edges = np.flatnonzero(np.append(True, place[1:] // len(chosen) != place[:-1] // len(chosen))) if len(place) else []
                    for a, b in zip(edges, [*edges[1:], len(place)], strict=True):
                        out.append((some[place[a] // len(chosen)][0], None, (place[a:b] % len(chosen)).tolist(), change[a:b].tolist()))
                types = (pa.int64(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.float64()))
                columns = zip(*out, strict=True) if out else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["hash", "target", "features", "values"])

    return run


def fit_weights(rows: pd.DataFrame, width: int, bias: float) -> np.ndarray:
    """Weights and, last, the bias: accelerated gradient steps, each weight's by a bound of its curvature."""
    rows = rows.sort_values("hash", kind="stable")
    sizes = rows["features"].map(len).to_numpy(np.int64)
    flat = np.concatenate([*rows["features"], np.empty(0)]).astype(np.int64)
    value, of = np.concatenate([*rows["values"], np.empty(0)]).astype(float), np.repeat(np.arange(len(rows)), sizes)
    labelled = rows["target"].notna().to_numpy()
    target = rows["target"].fillna(0).to_numpy(float)
    reach = np.bincount(of, np.abs(value), minlength=len(rows)) + labelled
    curve = np.where(labelled, 0.25, FAIRNESS) * reach
    scale = np.append(np.bincount(flat, np.abs(value) * curve[of], minlength=width) + RIDGE, (curve * labelled).sum() + 1e-9)
    w = np.append(np.zeros(width), bias)
    ahead, before = w.copy(), w
    for i in range(STEPS):
        z = np.bincount(of, value * ahead[flat], minlength=len(rows)) + ahead[-1] * labelled
        slope = np.where(labelled, 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target, FAIRNESS * z)
        gradient = np.append(np.bincount(flat, value * slope[of], minlength=width) + RIDGE * ahead[:-1], (slope * labelled).sum())
        w = ahead - gradient / scale
        ahead, before = w + i / (i + 3) * (w - before), w
    return w


class ToxicityModel:
    """Chosen features and their weights; ``score`` needs the text alone."""

    def __init__(self, features: list[str], weights: np.ndarray, bias: float):
        self.features, self.weights, self.bias = features, weights, bias

    def score(self, docs: DataFrame, keep: tuple[str, ...], text: str = "text") -> DataFrame:
        """Columns ``keep``, the probability ``score`` that a text is toxic, and ``predicted``."""
        weights, bias, listed = self.weights, self.bias, self.features
        made = pa.schema([("score", pa.float64()), ("predicted", pa.int32())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = pa.array(listed, pa.string())
            for batch in batches:
                for part in slices(batch, "t", CUT_BYTES):
                    _, owner, feature = present(part.column("t"), names)
                    z = bias + np.bincount(owner, weights[feature], minlength=part.num_rows)
                    score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(score), pa.array((score >= TOXIC).astype(np.int32))], names=[*part.schema.names[:-1], *made.names])

        return map_batches(run, docs, keep, text, made)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _drawn(rows: DataFrame, by: Column, n: int, most: int) -> DataFrame:
    grain = 1 << 30
    return rows.where(F.pmod(F.xxhash64(by), F.lit(grain)) < F.lit(int(grain * min(1.0, most / max(n, 1)))))


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> ToxicityModel:
    """Learn from ``labels`` (doc_id, toxic) of documents that aren't held out; ``train_docs`` bounds the sample, about."""
    ship_package(docs.sparkSession)
    told = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg(F.col("toxic").cast("double")).alias("target"))
    ids = _drawn(told, F.col("doc_id"), told.count(), train_docs)
    joined = docs.select("doc_id", F.coalesce(column("text"), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    joined = materialize(joined.select(F.xxhash64("text").alias("hash"), "text", "target"), "labelled")
    sample = materialize(_drawn(joined, F.col("text"), joined.count(), train_docs).groupBy("hash", "text").agg(F.avg("target").alias("target")), "sample")
    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("target"), F.lit(0.0))).first()
    rate = (toxic + 0.1) / (n + 1)
    bias = math.log(rate / (1 - rate)) if rate < 1 else 30.0
    if not 0 < toxic < n:
        return ToxicityModel([], np.zeros(0), bias)
    counts = sample.select("text", "target").mapInArrow(_count, "feature string, toxic double, clean double").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    a, b, n1, n0 = F.col("a"), F.col("b"), F.lit(float(toxic)), F.lit(float(n - toxic))
    chi = F.pow(a * (n0 - b) - b * (n1 - a), F.lit(2.0)) * float(n) / ((a + b) * (n - a - b + 1e-9) * n1 * n0)
    good = counts.where((a >= LEAST_TOXIC) & (a / n1 >= LEAST_LIFT * b / n0)).withColumn("chi", F.round(chi, 6)).where(F.col("chi") >= LEAST_CHI)
    chosen = [r["feature"] for r in good.orderBy(F.desc("chi"), "feature").limit(MOST_FEATURES).select("feature").collect()]
    if not chosen:
        return ToxicityModel([], np.zeros(0), bias)
    rows = sample.mapInArrow(_training_rows(chosen), "hash long, target double, features array<int>, values array<double>")
    width, schema = len(chosen), "rows long, weights array<double>"
    one = lambda part: pd.DataFrame({"rows": [len(part)], "weights": [fit_weights(part, width, bias).tolist()]})
    parts = sorted(tuple(r) for r in rows.withColumn("part", F.pmod("hash", F.lit(-(-n // PART_DOCS)))).groupBy("part").applyInPandas(one, schema).collect())
    weights = np.average([w for _, w in parts], axis=0, weights=[r for r, _ in parts])
    return ToxicityModel(chosen, weights[:-1], float(weights[-1]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = fit(docs, labels).score(docs.select("doc_id", "text"), ("doc_id",))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
