import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.functions import names, scalars
from strandline.operators import features
from strandline.plans import windows
from strandline.sequence import Sequence
from tests.conftest import close, rows

SPECS = [Sequence(("k",), ("i",), None), Sequence(("k",), ("i",), "floor(i / 9)", segment_rows=7)]


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=90), rng.normal(size=90)
    a[rng.choice(90, 8, replace=False)] = np.nan
    return pd.DataFrame({"k": 1, "i": range(90), "a": a, "b": b})


@pytest.fixture(scope="module")
def df(spark, frame):
    return spark.createDataFrame(frame).withColumns({"a": scalars.nan_to_null("a")})


def column(out, c):
    return [r[1] for r in rows(out.select("i", c))]


def check(got, want):
    for x, y in zip(got, want):
        assert close(x, None if pd.isna(y) else float(y), 1e-8)


@pytest.mark.parametrize("seq", SPECS)
def test_rolling_summary_matches_pandas(df, frame, seq):
    out = features.rolling_summary(df, seq, ["a"], [5, 12])
    for n in (5, 12):
        r = frame["a"].rolling(n, min_periods=n)
        for stat, want in {"mean": r.mean(), "std": r.std(ddof=0), "min": r.min(), "max": r.max(),
                           "delta": frame["a"] - frame["a"].shift(n - 1), "slope": (frame["a"] - frame["a"].shift(n - 1)) / (n - 1)}.items():
            check(column(out, f"a_roll_{n}_{stat}"), want)


@pytest.mark.parametrize("seq", SPECS)
def test_window_slope_matches_polyfit(df, frame, seq):
    got = column(features.window_stats(df, seq, ["b"], 6), "b_slope")
    want = [np.nan] * 5 + [np.polyfit(range(6), frame["b"][i - 5:i + 1], 1)[0] for i in range(5, 90)]
    check(got, want)


@pytest.mark.parametrize("seq", SPECS)
@pytest.mark.parametrize("metric", ["rmse", "mae", "pearson"])
def test_best_window_matches_brute_force(df, frame, seq, metric):
    n, best = 10, None
    y, p = frame["a"].to_numpy(), frame["b"].to_numpy()
    for s in range(81):
        u, v = y[s:s + n], p[s:s + n]
        if np.isfinite(u).all():
            score = {"rmse": np.sqrt(np.mean((u - v) ** 2)), "mae": np.mean(abs(u - v)), "pearson": -np.corrcoef(u, v)[0, 1]}[metric]
            best = min(best, (score, s)) if best else (score, s)
    row = features.best_window(df, seq, "a", "b", n, metric).first()
    assert row["start_index"] == best[1] and close(row["metric_value"], -best[0] if metric == "pearson" else best[0], 1e-7)


@pytest.mark.parametrize("seq", SPECS)
def test_sliding_windows_skip_or_reject_holes(df, frame, seq):
    clean = frame.dropna()
    loose = features.sliding_windows(df, seq, ["a"], ["b"], 4)
    assert loose.count() == len(clean) - 3
    strict = features.sliding_windows(df, seq, ["a"], ["b"], 4, strict_contiguous=True)
    whole = frame["a"].rolling(4, min_periods=4).count().eq(4).sum()
    assert strict.count() == whole
    got = {r["window_end"]: r["window"] for r in loose.collect()}
    for j in range(3, len(clean)):
        assert got[clean.index[j]] == pytest.approx(clean["a"].iloc[j - 3:j + 1].tolist())


@pytest.mark.parametrize("seq", SPECS)
def test_a_sequence_of_one_window_is_not_left_out(spark, seq):
    """Keys of 3, 4 and 5 clean rows have no, one and two windows of 4."""
    df = spark.createDataFrame([(k, i, float(10 * k + i)) for k in (3, 4, 5) for i in range(k)] + [(4, 9, None)], "k int, i int, a double")
    out = features.sliding_windows(df, seq, ["a"], ["a"], 4)
    assert rows(out.select("k", "window_end")) == [(4, 3), (5, 3), (5, 4)]
    assert [r["window"] for r in out.filter("k = 4").collect()] == [[40.0, 41.0, 42.0, 43.0]]


def test_the_query_returns_whole_windows(spark):
    """All steps of both inputs and all twelve statistics."""
    out = windows.sliding_windows(spark, "/root/testdata/sf0.001")
    assert len(out.columns) == 4 + 4 * 2 + 12
    r = out.orderBy("l_suppkey", "window_end").first().asDict()
    q, t = (np.array([r[f"{c}_{k}"] for k in range(4)]) for c in ("quantity", "tax"))
    for c, v in (("quantity", q), ("tax", t)):
        for s, want in {"mean": v.mean(), "std": v.std(), "min": v.min(), "max": v.max(), "slope": np.polyfit(range(4), v, 1)[0]}.items():
            assert abs(r[f"{c}_{s}"] - want) < 2e-6
    assert abs(r["product_mean"] - (q * t).mean()) < 2e-6 and abs(r["product_std"] - (q * t).std()) < 2e-6


@pytest.mark.parametrize("seq", SPECS)
def test_lag_matrix_order_and_warmup(df, frame, seq):
    out = features.lag_matrix(df, seq, "b", ["a"], 2, 2, 3)
    got = {r["i"]: r for r in out.collect()}
    assert features.warmup(2, 2, 3) == 4 and not got[3]["has_full_history"] and got[4]["has_full_history"]
    v = lambda c, i: None if pd.isna(frame[c][i]) else frame[c][i]
    assert got[40]["phi"] == [v("b", 39), v("b", 38), v("a", 37), v("a", 36)]


def test_scalar_edges(spark):
    row = spark.range(1).select(
        scalars.safe_div(F.lit(1.0), F.lit(1e-7)).alias("zero"), scalars.to_bool(F.lit("1.0")).alias("b"), scalars.to_bool(F.lit(" Yes ")).alias("y"),
        scalars.to_double(F.lit("nan")).alias("nan"), scalars.to_double(F.lit("x")).alias("junk"), scalars.clip_low(F.lit(None).cast("double")).alias("null"),
        scalars.scale_by_max(F.lit(3.0), F.lit(0.0)).alias("m0"), scalars.scale_by_max(F.lit(3.0), F.lit(None).cast("double")).alias("mn"),
        scalars.scale_by_max(F.lit(None).cast("double"), F.lit(2.0)).alias("vn"),
    ).first()
    assert tuple(row) == (0.0, False, True, None, None, None, 0.0, 3.0, None)


def test_names(spark):
    row = spark.createDataFrame([("detections_Backlit_FR_5m--20mm_1_cam0",)], "s string").select(
        names.normalize_stem("s"), names.feed_setting("s"), names.distance_setting("s"), names.machine_group(names.normalize_stem("s")),
        names.frame_number(F.lit("frame_00012_x7.jpg")), names.frame_number(F.lit("none")), names.safe_token(F.lit("__")),
        names.suffix_name(F.lit("a.b.jpg"), F.lit("src")), names.acquisition_mode(F.lit("/x/BackLit/a/f.jpg")), names.acquisition_mode(F.lit("/x/backlit")),
    ).first()
    assert tuple(row) == ("fr_5m_20mm_1", 5, 20, "fr", 12, 0, "source", "a.b_src.jpg", "backlit", "laserlit")
    keys = spark.createDataFrame([("f2",), ("f10",), ("f1a3",), ("f1a20",), ("g",)], "n string").orderBy(names.natural_key("n"))
    assert [r[0] for r in keys.collect()] == ["f1a3", "f1a20", "f2", "f10", "g"]


@pytest.mark.parametrize("metric", ["rmse", "mse", "mae", "pearson"])
def test_best_window_is_blind_to_an_early_outlier(spark, metric):
    """One huge error before the windows must leave no trace in their sums."""
    rng = np.random.default_rng(4)
    truth = rng.normal(size=60)
    error = rng.normal(scale=1e-3, size=60)
    error[0], error[30:40] = 1e6, 5e-4
    rows = spark.createDataFrame([("a", i, float(t), float(t + e)) for i, (t, e) in enumerate(zip(truth, error))], "k string, i long, y double, p double")
    row = features.best_window(rows, Sequence(("k",), ("i",)), "y", "p", 10, metric).first()
    spans = [(truth[s : s + 10], error[s : s + 10]) for s in range(51)]
    score = {
        "rmse": [float(np.sqrt((e * e).mean())) for _, e in spans], "mse": [float((e * e).mean()) for _, e in spans],
        "mae": [float(np.abs(e).mean()) for _, e in spans], "pearson": [-float(np.corrcoef(t, t + e)[0, 1]) for t, e in spans],
    }[metric]
    if metric != "pearson":
        assert row["start_index"] == int(np.argmin(score)) and abs(row["metric_value"] - min(score)) < 1e-9
        assert row["rmse"] == pytest.approx(float(np.sqrt((spans[row["start_index"]][1] ** 2).mean())))
    else:
        assert row["start_index"] > 0 and abs(row["metric_value"] + min(score)) < 1e-6


def test_null_keys_stay_in_both_plans(spark):
    rows = spark.createDataFrame([(k, i, float(i)) for k in ("a", None) for i in range(20)], "k string, i long, v double")
    plain = features.add_lags(rows, Sequence(("k",), ("i",)), ["v"], [1, 3])
    hot = features.add_lags(rows, Sequence(("k",), ("i",), bucket="floor(i / 4)", segment_rows=5), ["v"], [1, 3])
    assert hot.count() == 40 and sorted(map(str, plain.collect())) == sorted(map(str, hot.select(*plain.columns).collect()))


def test_longer_blob_lists_fail(spark):
    from strandline.sources import files

    blob = "named_struct('x', 1, 'y', 2, 'area', 1d, 'diameter_px', 1d)"
    df = spark.sql(f"SELECT 1 AS k, array({blob}, {blob}) AS b UNION ALL SELECT 2, NULL")
    assert files.widen_blobs(df, "b", "p", 2).count() == 2 and "p_2_area" in files.widen_blobs(df, "b", "p").columns
    with pytest.raises(Exception, match="more than 1 blobs"):
        files.widen_blobs(df, "b", "p", 1).collect()
