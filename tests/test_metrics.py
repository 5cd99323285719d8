import math

import numpy as np
from pyspark.sql import functions as F

from strandline.operators import clean, metrics
from strandline.sequence import Sequence
from tests.conftest import close, rows


def test_constant_truth_has_no_relative_scores(spark):
    row = metrics.metrics(spark.createDataFrame([(2.0, 1.0), (2.0, 3.0), (None, 1.0)], "y double, p double"), "y", "p").first()
    assert row["n_samples"] == 2 and row["rmse"] == 1.0 and row["r2"] is None and row["fit_pct"] is None and row["rrse"] is None and row["nrmse"] is None


def test_null_groups_are_kept_and_empty_groups_are_undefined(spark):
    df = spark.createDataFrame([(None, 1.0, 2.0), ("a", None, 1.0)], "g string, y double, p double")
    got = {r["g"]: (r["n_samples"], r["rmse"]) for r in metrics.metrics(df, "y", "p", ("g",)).collect()}
    assert got == {None: (1, 1.0), "a": (0, None)}


def test_strict_scores_and_criteria(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, float("nan")), ("b", 1.0, 1.0), ("b", 3.0, 3.0)], "g string, y double, p double")
    got = {r["g"]: r for r in metrics.metrics(df, "y", "p", ("g",), n_params=1, strict=True).collect()}
    assert got["a"]["rmse"] == math.inf and got["a"]["r2"] == -math.inf and got["a"]["aic"] == math.inf
    assert got["b"]["rmse"] == 0.0 and math.isfinite(got["b"]["aic"])


def test_correlation_guards(spark):
    df = spark.createDataFrame([("c", 1.0, 5.0), ("c", 2.0, 5.0), ("one", 1.0, 1.0), ("ok", 1.0, 2.0), ("ok", 2.0, 4.0)], "g string, x double, y double")
    got = {r["g"]: r["r"] for r in metrics.pearson(df, "x", "y", ("g",)).collect()}
    assert got["c"] is None and got["one"] is None and close(got["ok"], 1.0)


def test_lag_correlations_stay_inside_a_file(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(2, 80))
    df = spark.createDataFrame([(i // 40, i % 40, float(x[i]), float(y[i])) for i in range(80)], "k int, i int, x double, y double")
    for seq in (Sequence(("k",), ("i",), None), Sequence(("k",), ("i",), "floor(i / 6)", segment_rows=5)):
        got = {r["lag"]: r["r"] for r in metrics.lag_correlations(df, seq, "y", ["x"], 3).collect()}
        for lag in range(4):
            a = np.concatenate([x[s:s + 40 - lag] for s in (0, 40)])
            b = np.concatenate([y[s + lag:s + 40] for s in (0, 40)])
            assert close(got[lag], float(np.corrcoef(a, b)[0, 1]), 1e-9)


def test_best_skips_non_finite_and_keeps_the_first(spark):
    df = spark.createDataFrame([(0, float("nan")), (1, 2.0), (2, 1.0), (3, 1.0), (4, None)], "n int, s double")
    assert metrics.select_best(df, "s", "n").first()["n"] == 2
    assert metrics.select_best(df, "s", "n", lowest=False).first()["n"] == 1


def test_one_row_statistics_use_no_join(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    out = clean.standardize(df, ["a", "b"])
    assert rows(out) == [(-1.0, 0.0), (1.0, 0.0)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "scalar-subquery" in plan
    assert rows(clean.minmax(df, ["a", "b"])) == [(0.0, 0.0), (1.0, 0.0)]


def test_bounds(spark):
    df = spark.createDataFrame([(-1.0,), (4.0,), (None,)], "y double")
    assert tuple(metrics.target_bounds(df, "y", low=0.0, margin=2.0).first()) == (0.0, 6.0)
    assert tuple(metrics.target_bounds(df, "y", low=9.0, margin=2.0).first()) == (9.0, 10.0)
    assert tuple(metrics.target_bounds(df.select(F.col("y")), "y", margin=0.2, relative=True).first()) == (-2.0, 5.0)
