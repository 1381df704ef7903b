"""Models: stacked fits against the plain one, stored models on new bars against a plain forward pass."""

import numpy as np
import pytest

from tidemark.operators import hmm
from tidemark.plans import registry


def series(seed, n):
    rng = np.random.default_rng(seed)
    truth = np.repeat(rng.integers(0, 3, n // 20 + 1), 20)[:n]
    return rng.normal(size=(n, 3)) * np.array([0.3, 1.0, 1.0]) + np.array([2.0, 0.5, 0.0]) * (truth - 1)[:, None]


def test_stacked_fits_are_the_plain_fits():
    many = [series(i, n) for i, n in enumerate((150, 61, 400, 20))]
    for states in (1, 3):
        for x, (start, trans, means, covs, history) in zip(many, hmm.batch_fit(many, states, 30), strict=True):
            want = hmm.fit(x, states, 30)
            assert history == pytest.approx(want[4][: len(history)], abs=1e-6) and abs(len(history) - len(want[4])) <= 1
            for a, b in zip((start, trans, means, covs), want[:4], strict=True):
                assert np.allclose(a, b, atol=1e-5)


def test_one_pass():
    x = series(9, 97)
    start, trans, means, covs, _ = hmm.fit(x, 3, 5)
    log_b = hmm.log_density(x, means, covs)
    assert np.allclose(log_b, hmm.batch_density(x[None], means[None], covs[None])[0])
    want, got = hmm.forward_backward(log_b, start, trans), hmm.batch_pass(log_b[None], start[None], trans[None], np.ones((1, 97), bool))
    assert np.allclose(want[0], got[0][0]) and np.allclose(want[1], got[1][0]) and want[2] == pytest.approx(float(got[2][0]))


def test_many_symbols_take_one_pass_over_time():
    import time

    many = [series(i % 5, 200) for i in range(300)]
    began = time.time()
    hmm.batch_fit(many[:3], 3, 10)
    few = time.time() - began
    began = time.time()
    hmm.batch_fit(many, 3, 10)
    assert time.time() - began < 60 * max(few, 0.02)  # a hundred times the symbols


def test_stored_models_on_new_bars(spark):
    features = registry.run(spark, "features", "/root/testdata/sf0.001").cache()
    cut = features.selectExpr("percentile_approx(unix_seconds(cast(bar_ts as timestamp)), 0.7)").first()[0]
    old, new = features.where(f"unix_seconds(cast(bar_ts as timestamp)) <= {cut}"), features.where(f"unix_seconds(cast(bar_ts as timestamp)) > {cut}")
    models = hmm.hmm_models(old)
    got = {(r.symbol, r.bar_ts): r for r in hmm.hmm_score(models, new).collect()}
    assert len(got) == new.count() > 0
    for m in models.collect():
        k, bars = m.states, new.where(f"symbol = '{m.symbol}'").orderBy("bar_ts").collect()
        trans, state = np.array(m.transitions).reshape(k, k), np.array(m["last"])
        for r in bars:
            x = (np.array([r.returns, r.bar_range, r.volume_change]) - m.center) / np.array(m.scale)
            state = (state @ trans) * np.exp(hmm.log_density(x[None], np.array(m.means).reshape(k, 3), np.array(m.covariances).reshape(k, 3, 3))[0])
            state /= state.sum()
            assert (got[m.symbol, r.bar_ts].regime_id, got[m.symbol, r.bar_ts].regime_confidence) == (state.argmax(), pytest.approx(state.max()))
    # What comes later changes nothing, and a symbol without a model has no rows.
    middle = new.selectExpr("percentile_approx(unix_seconds(cast(bar_ts as timestamp)), 0.5)").first()[0]
    early = hmm.hmm_score(models, new.where(f"unix_seconds(cast(bar_ts as timestamp)) <= {middle}")).collect()
    assert early and all(got[r.symbol, r.bar_ts].regime_id == r.regime_id for r in early)
    assert hmm.hmm_score(models.where("symbol = 'BUILDING'"), new).select("symbol").distinct().count() == 1
    assert hmm.walk_forward(features).where(f"unix_seconds(cast(bar_ts as timestamp)) > {cut}").count() > 0
    assert hmm.walk_forward(features.limit(0)).count() == 0
