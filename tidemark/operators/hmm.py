"""Gaussian hidden Markov regimes, a model for each symbol (Rabiner, 1989).

Each symbol's model is fitted on its own bars: scaled forward-backward, full covariances
with a floor, a deterministic start by ranks of returns, Viterbi decoding in logs.
States are ranked by mean return, best first. Spark deals bars by symbol; a task stacks
symbols in one array and fits them at once. The recursions over time run for all of
them, and by chunks of time: products of k x k matrices within all chunks at once, then
from chunk to chunk, then the states within all chunks at once. So a fit of T bars takes
about the root of T steps.

A model's row holds all that is needed to apply it: ``score`` filters new bars without a
refit, and ``walk_forward`` labels bars by models that have seen earlier ones only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.plans.catalog import QUERIES, RELATIONS, Relation, run
from tidemark.session import materialize, ship_package
from tidemark.sources.fixtures import REGIMES

STATES, ITERATIONS, TOLERANCE, FLOOR = 7, 100, 1e-4, 1e-3


def log_density(x: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(means)))
    for k, (m, c) in enumerate(zip(means, covs, strict=True)):
        half = np.linalg.cholesky(c)
        z = np.linalg.solve(half, (x - m).T)
        out[:, k] = -0.5 * ((z * z).sum(axis=0) + x.shape[1] * np.log(2 * np.pi)) - np.log(np.diag(half)).sum()
    return out


def forward_backward(log_b: np.ndarray, start: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of states, expected transitions and the log-likelihood."""
    n, k = log_b.shape
    top = log_b.max(axis=1, keepdims=True)
    b = np.exp(log_b - top)
    alpha, beta, scale = np.empty((n, k)), np.ones((n, k)), np.empty(n)
    for t in range(n):
        a = (start if t == 0 else alpha[t - 1] @ trans) * b[t]
        scale[t] = max(a.sum(), 1e-300)
        alpha[t] = a / scale[t]
    for t in range(n - 2, -1, -1):
        beta[t] = trans @ (b[t + 1] * beta[t + 1]) / scale[t + 1]
    gamma = alpha * beta
    gamma /= gamma.sum(axis=1, keepdims=True)
    moves = (alpha[:-1].T @ (b[1:] * beta[1:] / scale[1:, None])) * trans
    return gamma, moves, float(np.log(scale).sum() + top.sum())


def viterbi(log_b: np.ndarray, start: np.ndarray, trans: np.ndarray) -> np.ndarray:
    n, k = log_b.shape
    with np.errstate(divide="ignore"):
        log_a, best = np.log(trans), np.log(start) + log_b[0]
    back = np.zeros((n, k), np.int64)
    for t in range(1, n):
        each = best[:, None] + log_a
        back[t] = each.argmax(axis=0)
        best = each.max(axis=0) + log_b[t]
    path = np.empty(n, np.int64)
    path[-1] = best.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def batch_pass(log_b: np.ndarray, start: np.ndarray, trans: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``forward_backward`` of stacked series (series, time, state), of which ``there`` are bars; the last filtered states too."""
    n, length, k = log_b.shape
    inner = max(1, int(np.ceil(np.sqrt(length))))
    outer = -(-length // inner)
    pad = outer * inner - length
    top = np.where(there, log_b.max(axis=2), 0.0)
    b = np.where(there[:, :, None], np.exp(log_b - top[:, :, None]), 1.0)
    b = np.pad(b, ((0, 0), (0, pad), (0, 0)), constant_values=1.0).reshape(n, outer, inner, k)
    m = np.pad(there, ((0, 0), (0, pad))).reshape(n, outer, inner)
    moved = trans[:, None]
    # Products of the chunks.
    product = np.broadcast_to(np.eye(k), (n, outer, k, k)).copy()
    for j in range(inner):
        step = product @ moved
        if j == 0:
            step[:, 0] = product[:, 0]  # the first bar moves from nowhere
        step *= b[:, :, j, None, :]
        product = np.where(m[:, :, j, None, None], step, product)
        product /= np.maximum(product.max(axis=(2, 3), keepdims=True), 1e-300)
    # From chunk to chunk, both ways.
    enter, leave = np.empty((n, outer, k)), np.ones((n, outer, k))
    enter[:, 0] = start
    for c in range(1, outer):
        e = np.einsum("sk,skl->sl", enter[:, c - 1], product[:, c - 1])
        enter[:, c] = e / np.maximum(e.sum(axis=1, keepdims=True), 1e-300)
    for c in range(outer - 1, 0, -1):
        e = np.einsum("skl,sl->sk", product[:, c], leave[:, c])
        leave[:, c - 1] = e / np.maximum(e.max(axis=1, keepdims=True), 1e-300)
    # Within all chunks.
    alpha, beta, scale = np.empty((n, outer, inner, k)), np.empty((n, outer, inner, k)), np.ones((n, outer, inner))
    a, g = enter, leave
    for j in range(inner):
        step = (a[:, :, None, :] @ moved)[:, :, 0]
        if j == 0:
            step[:, 0] = a[:, 0]
        step = step * b[:, :, j]
        total = np.maximum(step.sum(axis=2), 1e-300)
        scale[:, :, j] = np.where(m[:, :, j], total, 1.0)
        a = np.where(m[:, :, j, None], step / total[:, :, None], a)
        alpha[:, :, j] = a
    for j in range(inner - 1, -1, -1):
        beta[:, :, j] = g
        step = (moved @ (b[:, :, j] * g)[..., None])[..., 0]
        g = np.where(m[:, :, j, None], step / np.maximum(step.max(axis=2, keepdims=True), 1e-300), g)
    flat = lambda x: x.reshape(n, outer * inner, *x.shape[3:])[:, :length]
    alpha, beta, b = flat(alpha), flat(beta), flat(b)
    gamma = alpha * beta
    gamma *= there[:, :, None] / np.maximum(gamma.sum(axis=2, keepdims=True), 1e-300)
    ahead = b[:, 1:] * beta[:, 1:]
    weight = there[:, 1:] / np.maximum(np.einsum("stk,skl,stl->st", alpha[:, :-1], trans, ahead, optimize=True), 1e-300)
    moves = np.einsum("stk,stl->skl", alpha[:, :-1] * weight[:, :, None], ahead, optimize=True) * trans
    return gamma, moves, np.log(flat(scale)).sum(axis=1) + top.sum(axis=1), alpha[:, -1]


def batch_density(x: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    """``log_density`` of stacked series (series, time, feature)."""
    half = np.linalg.cholesky(covs)
    z = np.einsum("skij,stkj->stki", np.linalg.inv(half), x[:, :, None] - means[:, None], optimize=True)
    logs = np.log(np.diagonal(half, axis1=2, axis2=3)).sum(axis=2)
    return -0.5 * ((z * z).sum(axis=3) + x.shape[2] * np.log(2 * np.pi)) - logs[:, None]


def batch_fit(series: list[np.ndarray], states: int = STATES, iterations: int = ITERATIONS) -> list[tuple]:
    """``fit`` of several series at once; one that has settled stays as it is."""
    n, d = len(series), series[0].shape[1]
    x = np.zeros((n, max(map(len, series)), d))
    there = np.zeros(x.shape[:2], bool)
    floor = np.eye(d) * FLOOR
    means, covs = np.empty((n, states, d)), np.empty((n, states, d, d))
    for i, one in enumerate(series):
        x[i, : len(one)], there[i, : len(one)] = one, True
        groups = np.array_split(np.argsort(one[:, 0], kind="stable"), states)
        means[i], covs[i] = [one[g].mean(axis=0) for g in groups], np.cov(one.T, bias=True).reshape(d, d) + floor
    start, trans = np.full((n, states), 1 / states), np.tile(np.full((states, states), 0.1 / states) + np.eye(states) * 0.9, (n, 1, 1))
    history: list[list[float]] = [[] for _ in series]
    live = np.arange(n)
    for _ in range(iterations):
        rows, bars = x[live], there[live]
        gamma, moves, ll, _ = batch_pass(batch_density(rows, means[live], covs[live]), start[live], trans[live], bars)
        for i, value in zip(live, ll.tolist(), strict=True):
            history[i].append(value)
        on = np.array([len(history[i]) < 2 or abs(history[i][-1] - history[i][-2]) >= TOLERANCE for i in live])
        if not on.any():
            break
        live, rows, gamma, moves = live[on], rows[on], gamma[on], moves[on]
        weight = gamma.sum(axis=1) + 1e-10
        start[live] = gamma[:, 0] / gamma[:, 0].sum(axis=1, keepdims=True)
        trans[live] = (moves + 1e-10) / (moves + 1e-10).sum(axis=2, keepdims=True)
        means[live] = np.einsum("stk,std->skd", gamma, rows, optimize=True) / weight[:, :, None]
        off = rows[:, :, None] - means[live][:, None]
        covs[live] = np.einsum("stk,stki,stkj->skij", gamma, off, off, optimize=True) / weight[:, :, None, None] + floor
    return [(start[i], trans[i], means[i], covs[i], history[i]) for i in range(n)]


def fit(x: np.ndarray, states: int = STATES, iterations: int = ITERATIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[float]]:
    """start, transitions, means, covariances and the log-likelihood of each iteration."""
    d, floor = x.shape[1], np.eye(x.shape[1]) * FLOOR
    groups = np.array_split(np.argsort(x[:, 0], kind="stable"), states)
    means = np.array([x[g].mean(axis=0) for g in groups])
    covs = np.array([np.cov(x.T, bias=True).reshape(d, d) + floor for _ in groups])
    start, trans = np.full(states, 1 / states), np.full((states, states), 0.1 / states) + np.eye(states) * 0.9
    history: list[float] = []
    for _ in range(iterations):
        gamma, moves, ll = forward_backward(log_density(x, means, covs), start, trans)
        history.append(ll)
        if len(history) > 1 and abs(history[-1] - history[-2]) < TOLERANCE:
            break
        weight = gamma.sum(axis=0) + 1e-10
        start = gamma[0] / gamma[0].sum()
        trans = (moves + 1e-10) / (moves + 1e-10).sum(axis=1, keepdims=True)
        means = gamma.T @ x / weight[:, None]
        covs = np.array([(gamma[:, k, None] * (x - means[k])).T @ (x - means[k]) / weight[k] + floor for k in range(states)])
    return start, trans, means, covs, history


@dataclass(frozen=True)
class Decoded:
    """A fitted model with its states in order of mean return, and of each bar its regime and that regime's posterior."""

    start: np.ndarray
    transitions: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    history: list[float]
    regimes: np.ndarray
    confidence: np.ndarray
    #: Filtered states after the last bar: where new bars go on from.
    last: np.ndarray


def decode_batch(series: list[np.ndarray], returns: list[np.ndarray], states: int = STATES) -> list[Decoded]:
    out = []
    for x, r, (start, trans, means, covs, history) in zip(series, returns, batch_fit(series, states), strict=True):
        log_b = log_density(x, means, covs)
        path = viterbi(log_b, start, trans)
        gamma, _, _, last = batch_pass(log_b[None], start[None], trans[None], np.ones((1, len(x)), bool))
        mean = np.array([r[path == k].mean() if (path == k).any() else 0.0 for k in range(states)])
        order = np.argsort(-mean, kind="stable")
        out.append(Decoded(start[order], trans[np.ix_(order, order)], means[order], covs[order], history, np.argsort(order)[path], gamma[0][np.arange(len(path)), path], last[0][order]))
    return out


def decode(x: np.ndarray, returns: np.ndarray, states: int = STATES) -> Decoded:
    return decode_batch([x], [returns], states)[0]


def _states(n: int) -> int:
    return max(1, min(STATES, n // 20))


FEATURES = ["returns", "bar_range", "volume_change"]
#: Bars that are stacked and fitted at once (about).
BATCH_BARS = 100_000
PARAMETERS = ("start", "transitions", "means", "covariances", "center", "scale", "last")
MODEL = "symbol string, states int, " + ", ".join(f"{p} array<double>" for p in PARAMETERS) + ", history array<double>, bars array<struct<bar_ts:timestamp_ntz,returns:double,regime_id:int,regime_confidence:double>>"


def _models(types: pa.Schema):
    """Of bars by symbol and time: a row for each symbol, fitted in stacks of symbols with as many states."""

    def fitted(stack: list[tuple[str, pa.Table]]) -> Iterator[pa.RecordBatch]:
        ready: dict[int, list] = {}
        for symbol, table in stack:
            x = np.column_stack([table.column(f).to_numpy() for f in FEATURES])
            center, scale = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
            ready.setdefault(_states(len(x)), []).append((symbol, table, x, center, scale))
        for k, rows in ready.items():
            found = decode_batch([(x - c) / s for _, _, x, c, s in rows], [x[:, 0] for _, _, x, _, _ in rows], k)
            for (symbol, table, x, center, scale), f in zip(rows, found, strict=True):
                times = table.column("bar_ts").combine_chunks()
                bars = pa.StructArray.from_arrays([times.cast(pa.timestamp("us")), pa.array(x[:, 0]), pa.array(f.regimes, pa.int32()), pa.array(f.confidence)], names=["bar_ts", "returns", "regime_id", "regime_confidence"])
                numbers = [f.start, f.transitions, f.means, f.covariances, center, scale, f.last, np.array(f.history)]
                columns = [pa.array([symbol]), pa.array([k], pa.int32()), *(pa.array([v.ravel().tolist()], pa.list_(pa.float64())) for v in numbers), pa.ListArray.from_arrays(pa.array([0, len(bars)], pa.int32()), bars)]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, types.types, strict=True)], names=types.names)

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, pa.Table]] = []
        for symbol, table in runs_of(batches, "symbol"):
            stack.append((symbol, table))
            if sum(t.num_rows for _, t in stack) >= BATCH_BARS:
                yield from fitted(stack)
                stack = []
        yield from fitted(stack)

    return run_task


def runs_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[str, pa.Table]]:
    """The rows of each key, of batches that are sorted by it."""
    present, parts = None, []
    for batch in batches:
        keys = batch.column(key).to_pylist()
        edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)] if keys else []
        for a, b in zip(edges, edges[1:], strict=False):
            if parts and keys[a] != present:
                yield present, pa.Table.from_batches(parts)
                parts = []
            present = keys[a]
            parts.append(batch.slice(a, b - a))
    if parts:
        yield present, pa.Table.from_batches(parts)


def hmm_models(features: DataFrame) -> DataFrame:
    """A row for each symbol: its fitted model and its decoded bars. Written once; the other relations read it."""
    ship_package(features.sparkSession)
    dealt = features.select(F.col("symbol").cast("string").alias("symbol"), "bar_ts", *FEATURES).repartition("symbol").sortWithinPartitions("symbol", "bar_ts")
    return materialize(dealt.mapInArrow(_models(to_arrow_schema(StructType.fromDDL(MODEL))), MODEL), "models")


def _filter(bars: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    """New bars of a symbol, each judged by the bars up to it."""
    names = ["symbol", "bar_ts", "regime_id", "regime_confidence"]
    if bars.empty or model.empty:
        return pd.DataFrame(columns=names)
    m, bars = model.iloc[0], bars.sort_values("bar_ts", kind="stable")
    k, d = int(m["states"]), len(FEATURES)
    shaped = lambda name, *shape: np.array(m[name]).reshape(shape)
    trans = shaped("transitions", k, k)
    x = (bars[FEATURES].to_numpy(float) - shaped("center", d)) / shaped("scale", d)
    log_b = log_density(x, shaped("means", k, d), shaped("covariances", k, d, d))
    b, state = np.exp(log_b - log_b.max(axis=1, keepdims=True)), shaped("last", k)
    filtered = np.empty((len(x), k))
    for t in range(len(x)):
        state = (state @ trans) * b[t]
        state = state / max(state.sum(), 1e-300)
        filtered[t] = state
    best = filtered.argmax(axis=1)
    return pd.DataFrame({"symbol": bars["symbol"], "bar_ts": bars["bar_ts"], "regime_id": best.astype(np.int32), "regime_confidence": filtered[np.arange(len(x)), best]})[names]


def hmm_score(models: DataFrame, features: DataFrame) -> DataFrame:
    """symbol, bar_ts, regime_id and regime_confidence of new bars that come after those of the fit, by stored models.

    No refit: each bar's regime is the likeliest given the model and the bars up to it, going on from the fit's last
    bar. A symbol without a model has no rows.
    """
    ship_package(features.sparkSession)
    stored = models.select("symbol", "states", *PARAMETERS)
    new = features.select(F.col("symbol").cast("string").alias("symbol"), "bar_ts", *FEATURES)
    return new.groupBy("symbol").cogroup(stored.groupBy("symbol")).applyInPandas(_filter, "symbol string, bar_ts timestamp_ntz, regime_id int, regime_confidence double")


def walk_forward(features: DataFrame, share: float = 0.7) -> DataFrame:
    """Models of the first ``share`` of the time, and what they say of the bars after it: no regime depends on a later bar."""
    first, last = features.agg(F.min("bar_ts"), F.max("bar_ts")).first()
    if first is None:
        return features.select("symbol", "bar_ts", F.lit(0).alias("regime_id"), F.lit(0.0).alias("regime_confidence"))
    until = F.lit(first + (last - first) * share).cast("timestamp_ntz")
    return hmm_score(hmm_models(features.where(F.col("bar_ts") <= until)), features.where(F.col("bar_ts") > until))


def hmm_regimes(models: DataFrame) -> DataFrame:
    return models.select("symbol", F.inline("bars"))


def hmm_transition(models: DataFrame) -> DataFrame:
    each = models.select("symbol", "states", F.posexplode("transitions").alias("i", "prob"))
    return each.select("symbol", F.floor(F.col("i") / F.col("states")).cast("int").alias("from_id"), (F.col("i") % F.col("states")).alias("to_id"), "prob")


def hmm_likelihood(models: DataFrame) -> DataFrame:
    """The log-likelihood after each iteration of the fit."""
    return models.select("symbol", F.posexplode("history").alias("iteration", "log_likelihood"))


def hmm_current(models: DataFrame) -> DataFrame:
    """The last bar's regime of each symbol with that regime's mean return, volatility and number of bars."""
    decoded = hmm_regimes(models)
    stats = decoded.groupBy("symbol", "regime_id").agg(F.avg("returns").alias("mean_return"), F.stddev_samp("returns").alias("volatility"), F.count("*").alias("n"))
    last = decoded.groupBy("symbol").agg(F.max_by(F.struct("regime_id", "regime_confidence"), "bar_ts").alias("l")).select("symbol", "l.*")
    return last.join(stats, ["symbol", "regime_id"])


def model_regimes(bars: DataFrame) -> DataFrame:
    """The bars with regime_id, regime_label and regime_confidence of the fitted models: what strategies take as ``regimes``."""
    models = hmm_models(run(bars.sparkSession, "features", bars=bars))
    labels = F.array(*map(F.lit, REGIMES))
    return materialize(bars.join(hmm_regimes(models).drop("returns"), ["symbol", "bar_ts"]).withColumn("regime_label", F.get(labels, F.col("regime_id"))), "regimes")


def scan(bars: DataFrame, strategy: str) -> DataFrame:
    """The latest signal of each symbol under a strategy, on regimes of its own fitted model."""
    if strategy not in ("v1", "v2", "leaps", "bottoming"):
        raise ValueError(f"no strategy {strategy}")
    return run(bars.sparkSession, f"scan_{strategy}", bars=bars, regimes=model_regimes(bars))


def backtest(bars: DataFrame, strategy: str, result: str = "trades", index_bars: DataFrame | None = None) -> DataFrame:
    """Trades, equity or metrics (``result``) of a strategy's replay on regimes of fitted models; without ``index_bars`` (bar_ts, close) the level is 20."""
    if strategy not in ("v1", "v1_aggressive", "v2") or result not in ("trades", "equity", "metrics"):
        raise ValueError(f"no {result} of {strategy}")
    spark = bars.sparkSession
    index = index_bars if index_bars is not None else spark.createDataFrame([], "bar_ts timestamp_ntz, close double")
    return run(spark, f"metrics_{strategy}" if result == "metrics" else f"backtest_{strategy}_{result}", bars=bars, index_bars=index, regimes=model_regimes(bars))


# No SQL: these are tested by their properties.
RELATIONS["hmm_models"] = Relation("", lambda use: hmm_models(use("features")))
for _name, _build in {"hmm_regimes": hmm_regimes, "hmm_transition": hmm_transition, "hmm_likelihood": hmm_likelihood, "hmm_current": hmm_current}.items():
    RELATIONS[_name] = Relation("", (lambda build: lambda use: build(use("hmm_models")))(_build))
    QUERIES.append(_name)
for _name, _build in {"model_scan_v2": lambda bars: scan(bars, "v2"), "model_backtest_v2": lambda bars: backtest(bars, "v2")}.items():
    RELATIONS[_name] = Relation("", (lambda build: lambda use: build(use("bars")))(_build))
    QUERIES.append(_name)
RELATIONS["hmm_walk_forward"] = Relation("", lambda use: walk_forward(use("features")))
QUERIES.append("hmm_walk_forward")
