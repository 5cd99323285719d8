"""Searches against one plain numpy fit per candidate, and the plan of the sums."""

import numpy as np
import pytest

from strandline.operators import grid, linear, normal
from strandline.operators.features import regressors as lag_rows
from tests.conftest import close
from tests.test_linear import SEQ, frame, regressors, series


def powers(phi, na, degree):
    mean, scale = phi.mean(0), phi.std(0)
    build = lambda x: np.hstack([np.ones((len(x), 1)), (x - mean) / scale, *[((x - mean) / scale)[:, na:] ** p for p in range(2, degree + 1)]])
    return build


def ridge(z, target, alpha):
    penalty = alpha * np.diag([0.0] + [1.0] * (z.shape[1] - 1))
    return np.linalg.solve(z.T @ z + penalty, z.T @ target)


def test_power_grid_equals_one_fit_per_candidate(spark):
    train, valid = series(11), series(12)
    candidates = grid.power_grid("y", ["u", "w"], [0, 2], [1, 2], [0, 1], [1, 2, 3], [0.0, 0.5, 20.0])
    rows, best = grid.search(frame(spark, train), frame(spark, valid), SEQ, candidates)
    assert len(rows) == len(candidates) == 2 * 2 * 2 * 3 * 3
    found = {}
    for r in rows:
        phi, target, _ = regressors(train, r["na"], r["nb"], r["nk"])
        vphi, vtarget, _ = regressors(valid, r["na"], r["nb"], r["nk"])
        build = powers(phi, r["na"], r["degree"])
        e = vtarget - build(vphi) @ ridge(build(phi), target, r["alpha"])
        assert (r["status"], r["n_train"], r["n_samples"]) == ("ok", len(target), len(e))
        assert close(r["rmse"], float(np.sqrt(np.mean(e**2))), 1e-6) and close(r["mae"], float(np.abs(e).mean()), 1e-6)
        found[tuple(r[c] for c in ("na", "nb", "nk", "degree", "alpha"))] = r["rmse"]
    winner = min(found, key=found.get)
    assert (best.base.na, best.base.nb, best.base.nk, max(p for _, p in best.terms), best.alpha) == winner


def free_run(data, build, theta, na, nb, nk):
    out = []
    for c in sorted({r[0] for r in data}):
        part = np.array([r[1:] for r in data if r[0] == c])
        y, xs, sim = part[:, 1], part[:, 2:], np.where(np.isfinite(part[:, 1]), part[:, 1], 0.0)
        for t in range(max(na, nk + nb - 1), len(y)):
            row = [sim[t - k] for k in range(1, na + 1)] + [xs[t - nk - k, j] for j in range(2) for k in range(nb)]
            sim[t] = (build(np.array([row])) @ theta)[0]
            if np.isfinite(y[t]):
                out.append(y[t] - sim[t])
    return np.array(out)


@pytest.mark.parametrize("scope", ["exogenous_only", "all"])
def test_power_grid_free_run(spark, scope):
    train, valid = series(13), series(14)
    candidates = grid.power_grid("y", ["u", "w"], [0, 1, 2], [1], [0, 1], [1, 2], [1.0], scope)
    rows, _ = grid.search(frame(spark, train), frame(spark, valid), SEQ, candidates, mode="free_run")
    for r in rows:
        phi, target, _ = regressors(train, r["na"], r["nb"], r["nk"])
        build = powers(phi, r["na"] if scope == "exogenous_only" else 0, r["degree"])
        e = free_run(valid, build, ridge(build(phi), target, 1.0), r["na"], r["nb"], r["nk"])
        assert r["status"] == "ok" and r["n_samples"] == len(e) and close(r["rmse"], float(np.sqrt(np.mean(e**2))), 1e-6)


def test_the_best_power_model_predicts_as_it_was_scored(spark):
    train, valid = series(15), series(16)
    rows, best = grid.search(frame(spark, train), frame(spark, valid), SEQ, grid.power_grid("y", ["u", "w"], [1, 2], [2], [0], [2], [0.1]), mode="free_run")
    out = linear.simulate_powers(frame(spark, valid), SEQ, best).filter("y IS NOT NULL AND y_pred_freerun IS NOT NULL").collect()
    e = np.array([r["y"] - r["y_pred_freerun"] for r in out])
    assert close(min(r["rmse"] for r in rows), float(np.sqrt(np.mean(e**2))), 1e-6)


def test_skipped_candidates_are_recorded(spark):
    train, valid = series(17, holes=False), series(18)
    candidates = [*grid.arx_grid("y", ["u", "w"], [1], [1], [0]), *grid.arx_grid("y", ["u", "w"], [1], [8], [0]), *grid.arx_grid("y", ["u", "w"], [0], [5], [55])]
    rows, best = grid.search(frame(spark, train), frame(spark, valid), SEQ, candidates, max_terms=12)
    assert [r["status"] for r in rows] == ["ok", "over the budget of 12 terms", "too few training rows"] and best.nb == 1
    assert all(rows[k]["rmse"] is None for k in (1, 2))
    with pytest.raises(RuntimeError):
        grid.search(frame(spark, train), frame(spark, valid), SEQ, candidates[1:2], max_terms=12)


def test_clipped_predictions(spark):
    train, valid = series(19), series(20)
    candidates = grid.power_grid("y", ["u", "w"], [0], [1], [0], [3], [0.0])
    rows, best = grid.search(frame(spark, train), frame(spark, valid), SEQ, candidates, margin=0.0, clip_predictions=True)
    phi, target, _ = regressors(train, 0, 1, 0)
    vphi, vtarget, _ = regressors(valid, 0, 1, 0)
    build = powers(phi, 0, 3)
    p = np.clip(build(vphi) @ ridge(build(phi), target, 0.0), target.min(), target.max())
    assert best.bounds == pytest.approx((target.min(), target.max())) and close(rows[0]["rmse"], float(np.sqrt(np.mean((vtarget - p) ** 2))), 1e-6)


def test_one_triangle_per_class_and_task(spark):
    """Each task writes one array per class; two shuffles of such rows make one array per class."""
    df = frame(spark, series(21)).repartition(6)
    terms = [("y1", "y", 1), ("u0", "u", 0)]
    rows = lag_rows(df, SEQ, terms, 1).filter("has_full_history AND phi[0] IS NOT NULL AND y IS NOT NULL").repartition(6)

    def classify(batch):
        z = np.column_stack([linear._matrix(batch.column(0), 2), batch.column(1).to_numpy(zero_copy_only=False)])
        yield b"a", z[::2]
        yield b"b", z[1::2]

    parts = normal.class_sums(rows.select("phi", "y"), classify, 3)
    counts = parts.groupBy("class", "task").count().collect()
    assert all(r["count"] == 1 for r in counts) and 2 < len(counts) <= 12
    plan = normal.total_sums(parts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 3 and "Aggregate" not in plan
    total = dict(normal.collected(normal.total_sums(parts), 3))
    z = np.array([[*r["phi"], r["y"]] for r in rows.collect()])
    np.testing.assert_allclose(total[b"a"].matrix + total[b"b"].matrix, z.T @ z, rtol=1e-9)
    assert total[b"a"].n + total[b"b"].n == len(z) and min(s.low for s in total.values()) == z[:, -1].min()


def test_held_classes_are_bounded(spark, monkeypatch):
    """A task that may hold one matrix writes more rows, with the same sums."""
    train, valid = series(22), series(23)
    monkeypatch.setattr(normal, "HELD_BYTES", 1)
    rows, _ = grid.search(frame(spark, train), frame(spark, valid), SEQ, grid.arx_grid("y", ["u", "w"], [1, 3], [2], [0]))
    for r in rows:
        phi, target, _ = regressors(train, r["na"], 2, 0)
        assert r["n_train"] == len(target)
