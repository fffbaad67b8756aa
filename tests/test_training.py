"""Head gradient vs central differences, AdamW vs a plain numpy loop, loss falls, repartition."""

import numpy as np
import pytest

from botsift.operators.head import HeadWeights, fixture_weights, np_head, np_keep, np_sigmoid, row_seed
from botsift.operators.training import AdamState, adamw_step, fit_head, gradient_sums, head_gradient


def _data(spark, n=64, d=8, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    y = (rng.random(n) < 0.5).astype(int)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], int(y[i])) for i in range(n)],
                               "post_id long, embedding array<float>, label int")
    return df, x.astype(np.float64), y


def _loss(w, x, y):
    p = np_head(x, w)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def test_gradient_matches_central_differences(spark):
    df, x, y = _data(spark)
    rng = np.random.default_rng(1)
    w = HeadWeights(rng.normal(scale=0.5, size=(8, 6)), rng.normal(scale=0.1, size=6), rng.normal(size=6), 0.1)
    g = {(r.param, r.idx): r.grad for r in head_gradient(df, w).collect()}
    theta = w.flat()
    names = [("W1", i) for i in range(48)] + [("b1", i) for i in range(6)] + [("w2", i) for i in range(6)] + [("b2", 0)]
    for k, key in enumerate(names):
        e = np.zeros_like(theta)
        e[k] = 1e-6
        num = (_loss(HeadWeights.from_flat(theta + e, 8, 6), x, y) - _loss(HeadWeights.from_flat(theta - e, 8, 6), x, y)) / 2e-6
        assert g[key] == pytest.approx(num, abs=1e-6), key


def test_gradient_independent_of_partitioning(spark):
    df, _, _ = _data(spark)
    w = fixture_weights(8, 6)
    one, many = gradient_sums(df.repartition(1), w), gradient_sums(df.repartition(70), w)
    assert one[-2] == 64 and np.allclose(one, many, atol=1e-9)
    assert gradient_sums(df.filter("post_id < 0"), w)[-2] == 0


def test_gradient_in_train_mode(spark):
    """Central differences of the loss with the row's mask held."""
    df, x, y = _data(spark)
    rng = np.random.default_rng(1)
    w = HeadWeights(rng.normal(scale=0.5, size=(8, 6)), rng.normal(scale=0.1, size=6), rng.normal(size=6), 0.1)
    seeded = df.withColumn("s", row_seed("post_id", 42, 3))
    seeds = np.array([r.s for r in seeded.orderBy("post_id").collect()])
    keep = np_keep(seeds, 6, 0.3)
    assert 0.2 < (keep == 0).mean() < 0.4 and set(np.unique(keep)) == {0.0, 1 / 0.7}

    def loss(theta):
        v = HeadWeights.from_flat(theta, 8, 6)
        p = np_sigmoid(np.maximum(x @ v.W1 + v.b1, 0) * keep @ v.w2 + v.b2)
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    sums = gradient_sums(seeded, w, seed_col="s", rate=0.3)
    theta = w.flat()
    assert sums[-1] / 64 == pytest.approx(loss(theta))
    for k in range(len(theta)):
        e = np.zeros_like(theta)
        e[k] = 1e-6
        assert sums[k] / 64 == pytest.approx((loss(theta + e) - loss(theta - e)) / 2e-6, abs=1e-6)


def test_adamw_matches_reference_loop():
    rng = np.random.default_rng(0)
    theta = rng.normal(size=10)
    st = AdamState(np.zeros(10), np.zeros(10))
    m = np.zeros(10); v = np.zeros(10); ref = theta.copy()
    for t in range(1, 6):
        g = rng.normal(size=10)
        theta = adamw_step(theta, g, st, lr=1e-2)
        ref = ref - 1e-2 * 0.01 * ref
        m = 0.9 * m + 0.1 * g; v = 0.999 * v + 0.001 * g * g
        ref = ref - 1e-2 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    assert np.allclose(theta, ref, atol=1e-12)


def test_loss_falls(spark):
    df, x, y = _data(spark, n=128)
    w0 = fixture_weights(8, 6)
    for rate in (0.0, 0.3):
        w1, hist = fit_head(df, w0, epochs=3, steps_per_epoch=4, lr=5e-2, rate=rate)
        assert [h[:2] for h in hist] == [(e, b) for e in range(3) for b in range(4)]
        assert _loss(w1, x, y) < _loss(w0, x, y)
    # every epoch deals the rows anew
    first = [h[2] for h in fit_head(df, w0, epochs=2, steps_per_epoch=4, lr=0.0, rate=0.0)[1]]
    assert sorted(round(v, 6) for v in first[:4]) != sorted(round(v, 6) for v in first[4:])


@pytest.mark.parametrize("steps_done", [1, 3, 4, 6, 12])
def test_a_run_that_was_ended_goes_on_where_it_was(spark, monkeypatch, steps_done):
    """Ended after some step (also at the end of an epoch) and started again: the history and the weights of one whole run."""
    from botsift.operators import training
    from botsift.session import scratch_path
    from botsift.sinks.publish import names

    df, _, _ = _data(spark, n=96)
    w0 = fixture_weights(8, 6)
    options = dict(epochs=3, steps_per_epoch=4, lr=5e-2, rate=0.3)
    whole, history = fit_head(df, w0, **options)
    path = scratch_path(spark, "t-steps")
    real, left = training.gradient_sums, [steps_done]

    def ending(*args, **kw):
        if not left[0]:
            raise KeyboardInterrupt
        left[0] -= 1
        return real(*args, **kw)

    monkeypatch.setattr(training, "gradient_sums", ending)
    try:
        fit_head(df, w0, log_path=path, **options)
    except KeyboardInterrupt:
        pass
    left[0] = 12 - steps_done
    resumed, again = fit_head(df.repartition(5), w0, log_path=path, **options)
    assert left[0] == 0                                     # no step is done twice
    assert [h[:2] for h in again] == [h[:2] for h in history]
    assert np.allclose([h[2] for h in again], [h[2] for h in history], atol=1e-12)
    assert np.allclose(resumed.flat(), whole.flat(), atol=1e-12)
    assert len(names(spark, path)) <= 2
    with pytest.raises(ValueError, match="other settings"):
        fit_head(df, w0, log_path=path, **{**options, "lr": 1e-3})
