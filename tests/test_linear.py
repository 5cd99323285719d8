from itertools import product

import numpy as np
import pytest

from strandline.functions.scalars import nan_to_null
from strandline.operators import grid, linear
from strandline.sequence import Sequence
from tests.conftest import close, rows

SEQ = Sequence(("c",), ("i",), None)


def series(seed, holes=True):
    rng = np.random.default_rng(seed)
    out = []
    for c, n in enumerate((60, 45, 9)):
        u, w = rng.normal(size=n), rng.normal(size=n)
        y = np.zeros(n)
        for t in range(2, n):
            y[t] = 0.6 * y[t - 1] - 0.2 * y[t - 2] + 0.8 * u[t - 1] + 0.3 * w[t] + 0.01 * rng.normal()
        if holes:
            y[rng.choice(n, 2, replace=False)] = np.nan
        out += [(c, i, float(y[i]), float(u[i]), float(w[i])) for i in range(n)]
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "c int, i int, y double, u double, w double").withColumn("y", nan_to_null("y")).repartition(3)


def regressors(data, na, nb, nk):
    """Plain numpy: (phi, target) over all chunks, finite rows only."""
    phi, target, at = [], [], []
    for c in sorted({r[0] for r in data}):
        part = np.array([r[1:] for r in data if r[0] == c])
        y, xs = part[:, 1], part[:, 2:]
        for t in range(max(na, nk + nb - 1 if nb else 0), len(y)):
            row = [y[t - k] for k in range(1, na + 1)] + [xs[t - nk - k, j] for j in range(2) for k in range(nb)]
            if np.isfinite(row).all() and np.isfinite(y[t]):
                phi.append(row)
                target.append(y[t])
                at.append((c, int(part[t, 0])))
    return np.array(phi).reshape(len(target), -1), np.array(target), at


def test_fit_equals_least_squares(spark):
    data = series(0)
    model = linear.fit_arx(frame(spark, data), SEQ, "y", ["u", "w"], 2, 2, 0)
    phi, target, _ = regressors(data, 2, 2, 0)
    assert model.n_samples == len(target)
    np.testing.assert_allclose(model.theta, np.linalg.lstsq(phi, target, rcond=None)[0], atol=1e-8)


def test_singular_system_gets_jitter():
    theta = linear.solve(np.array([[2.0, 2.0], [2.0, 2.0]]), np.array([1.0, 1.0]))
    assert np.isfinite(theta).all() and theta.sum() == pytest.approx(0.5, abs=1e-6)


@pytest.mark.parametrize("metric", ["rmse", "bic"])
def test_grid_search_equals_one_fit_per_combination(spark, metric):
    train, valid = series(1), series(2)
    scores, best = grid.grid_search(
        frame(spark, train), frame(spark, valid), SEQ, "y", ["u", "w"], [0, 1, 3], [0, 1, 2], [0, 1, 4], metric=metric
    )
    got = {(r["na"], r["nb"], r["nk"]): r for r in scores.collect()}
    expected = {}
    for combo in product([0, 1, 3], [0, 1, 2], [0, 1, 4]):
        phi, target, _ = regressors(train, *combo)
        theta = np.linalg.lstsq(phi, target, rcond=None)[0] if phi.shape[1] else np.zeros(0)
        vphi, vtarget, _ = regressors(valid, *combo)
        e = vtarget - vphi @ theta
        k, n = phi.shape[1] + 1, len(e)
        bic = n * (np.log(2 * np.pi * (e @ e) / n) + 1) + k * np.log(n)
        expected[combo] = {"rmse": np.sqrt(np.mean(e**2)), "bic": bic}
        assert got[combo]["n_train"] == len(target) and got[combo]["n_samples"] == n
        assert close(got[combo]["rmse"], expected[combo]["rmse"], 1e-7) and close(got[combo]["bic"], bic, 1e-7)
    winner = min(expected, key=lambda c: expected[c][metric])
    assert (best.na, best.nb, best.nk) == winner


def simulate(data, theta, na, nb, nk):
    out = {}
    for c in sorted({r[0] for r in data}):
        part = np.array([r[1:] for r in data if r[0] == c])
        y, xs, start = part[:, 1], part[:, 2:], max(na, nk + nb - 1 if nb else 0)
        sim = np.where(np.isfinite(y), y, 0.0)
        for t in range(len(y)):
            if t >= start:
                row = [sim[t - k] for k in range(1, na + 1)] + [xs[t - nk - k, j] for j in range(2) for k in range(nb)]
                sim[t] = np.dot(row, theta)
                out[(c, t)] = sim[t]
            else:
                out[(c, t)] = None
    return out


def test_free_run(spark):
    data = series(3)
    df = frame(spark, data)
    model = linear.fit_arx(df, SEQ, "y", ["u", "w"], 2, 1, 1)
    want = simulate(data, model.theta, 2, 1, 1)
    got = {(r["c"], r["i"]): r["y_pred_freerun"] for r in linear.simulate_linear(df, SEQ, model).collect()}
    assert len(got) == len(data) and all(close(got[k], want[k], 1e-9) for k in want)


def test_free_run_grid_scores(spark):
    train, valid = series(4), series(5)
    scores, _ = grid.grid_search(frame(spark, train), frame(spark, valid), SEQ, "y", ["u", "w"], [0, 2], [1], [0], mode="free_run")
    truth = {(r[0], r[1]): r[2] for r in valid}
    for r in scores.collect():
        phi, target, _ = regressors(train, r["na"], 1, 0)
        theta = np.linalg.lstsq(phi, target, rcond=None)[0]
        sim = simulate(valid, theta, r["na"], 1, 0)
        e = np.array([truth[k] - v for k, v in sim.items() if v is not None and np.isfinite(truth[k])])
        assert r["n_samples"] == len(e) and close(r["rmse"], float(np.sqrt(np.mean(e**2))), 1e-7)


def test_free_run_without_output_lags_is_one_step(spark):
    df = frame(spark, series(6, holes=False))
    model = linear.fit_arx(df, SEQ, "y", ["u", "w"], 0, 2, 1)
    for r in linear.predict_aligned(df, SEQ, model).collect():
        assert close(r["y_pred_osa"], r["y_pred_freerun"], 1e-9)


def test_delta_mode_and_bounds(spark):
    df = spark.createDataFrame([(1, i, float(i), 1.0, 0.0) for i in range(5)], "c int, i int, y double, u double, w double")
    model = linear.LinearModel("y", ("u",), 1, 1, 0, (0.0, 2.0), 0)
    out = linear.simulate_linear(df, SEQ, model, mode="delta", bounds=(0.0, 5.0))
    assert [v for _, v in rows(out.select("i", "y_pred_freerun"))] == [None, 2.0, 4.0, 5.0, 5.0]


@pytest.mark.parametrize("scope", ["exogenous_only", "all"])
def test_power_ridge_equals_numpy(spark, scope):
    data, alpha = series(7), 0.5
    model = linear.fit_power_ridge(frame(spark, data), SEQ, "y", ["u", "w"], 1, 1, 0, 3, alpha, scope=scope, margin=0.1)
    phi, target, at = regressors(data, 1, 1, 0)
    mean, scale = phi.mean(0), phi.std(0)
    z, first = (phi - mean) / scale, 1 if scope == "exogenous_only" else 0
    big = np.hstack([np.ones((len(z), 1)), z, z[:, first:] ** 2, z[:, first:] ** 3])
    penalty = alpha * np.diag([0.0] + [1.0] * (big.shape[1] - 1))
    want = np.linalg.solve(big.T @ big + penalty, big.T @ target)
    np.testing.assert_allclose(model.theta, want, atol=1e-7)
    spread = 0.1 * (target.max() - target.min())
    assert model.bounds == pytest.approx((target.min() - spread, target.max() + spread))
    got = {(r["c"], r["i"]): r["y_pred_osa"] for r in linear.predict_one_step_powers(frame(spark, data), SEQ, model).collect()}
    for key, value in zip(at, big @ want):
        assert close(got[key], float(value), 1e-6)


def test_diverging_free_run_is_missing_to_the_end(spark):
    base = linear.LinearModel("y", ("u",), 1, 1, 0, (), 0)
    model = linear.PowerModel(base, (0.0, 0.0), (1.0, 1.0), linear.additive_terms(2, 2), 0.0, (0.0, 1.0), False, (0.0, 0.0, 0.0, 1e200, 0.0))
    df = spark.createDataFrame([(1, i, 2.0, 1.0, 0.0) for i in range(5)], "c int, i int, y double, u double, w double")
    got = [v for _, v in rows(linear.simulate_powers(df, SEQ, model).select("i", "y_pred_freerun"))]
    assert got[0] is None and got[1] == 4e200 and got[2:] == [None, None, None]


def test_term_budget(spark):
    with pytest.raises(ValueError):
        linear.fit_power_ridge(frame(spark, series(0)), SEQ, "y", ["u"], 1, 1, 0, 3, 0.1, max_terms=3)


def test_rolling_inputs_start_when_they_are_complete(spark):
    """A free run over specified inputs predicts every row from the first one whose delayed windows are full."""
    from strandline.operators import features

    data = [(c, i, float((i * 7 + c) % 11), float((i * 5 + c) % 7), float((i * 3) % 5), 1.0) for c in range(2) for i in range(30)]
    df = spark.createDataFrame(data, "c int, i int, y double, u double, w double, f double")
    inputs, names = features.live_inputs(df, SEQ, "specified", 3, "u", "w", [], "f")
    model = linear.fit_arx(inputs, SEQ, "y", names, 1, 3, 2, **features.input_reach("specified", 3))
    out = linear.predict_aligned(inputs, SEQ, model).collect()
    assert model.start == 4 and len(model.theta) == 1 + len(names)
    assert all((r["y_pred_freerun"] is not None) == (r["y_pred_osa"] is not None) == (r["i"] >= 4) for r in out)
