"""Grouped evaluation metrics, correlations and orderings: one aggregation each."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalars import all_finite, is_finite
from strandline.operators.features import regressors
from strandline.sequence import Sequence

ERROR_COLUMNS = ("n_samples", "rmse", "mae", "bias", "r2", "rrse", "fit_pct", "nrmse", "mape")


def _errors(truth: str, prediction: str, ok: Column) -> dict[str, Column]:
    y = F.when(ok, F.col(truth).cast("double"))
    e = F.when(ok, F.col(prediction).cast("double") - F.col(truth).cast("double"))
    return {"y": y, "e": e}


def _summary(y: Column, e: Column, prefix: str = "") -> list[Column]:
    n, sse, sst = F.count(y), F.sum(e * e), F.count(y) * F.var_pop(y)
    rmse, span = F.sqrt(sse / n), F.max(y) - F.min(y)
    relative = F.when((F.abs(y) > 1e-8), F.abs(e / y))
    out = {
        "n_samples": n,
        "rmse": rmse,
        "mae": F.avg(F.abs(e)),
        "bias": F.avg(e),
        "r2": F.when((sst > 0) & (n > 1), 1 - sse / sst),
        "rrse": F.when(sst > 0, F.sqrt(sse / sst)),
        "fit_pct": F.when(sst > 0, 100.0 * (1 - F.sqrt(sse) / F.sqrt(sst))),
        "nrmse": F.when(span > 0, rmse / span).when(rmse == 0, F.lit(0.0)),
        "mape": F.avg(relative) * 100.0,
    }
    return [c.alias(f"{prefix}{k}") for k, c in out.items()]


def information_criteria(sse: Column, n: Column, n_params: int) -> tuple[Column, Column]:
    """Gaussian AIC and BIC; one variance term is added to the parameters, the residual sum is floored."""
    k = n_params + 1
    floored = F.greatest(sse, F.lit(sys.float_info.min))
    deviance = n * (F.log(2.0 * math.pi * floored / n) + 1.0)
    return deviance + 2.0 * k, deviance + k * F.log(n.cast("double"))


def metrics(
    df: DataFrame,
    truth: str,
    prediction: str,
    keys: tuple[str, ...] = (),
    *,
    n_params: int | None = None,
    zero_threshold: float | None = None,
    high_threshold: float | None = None,
    strict: bool = False,
    also: list[Column] = (),
) -> DataFrame:
    """RMSE, MAE, bias, R2, RRSE, fit %, NRMSE and MAPE of finite pairs, by any dimensions.

    n_params adds AIC and BIC; zero_threshold adds zero-class rates and scores; high_threshold adds
    the same metrics over truths at least that high; ``also`` are further aggregates of the same pass. ``strict`` scores a group with any non-finite
    pair as the worst possible. Undefined values are NULL; NULL group keys form their own groups.
    Partial aggregation makes hot groups cheap: one row per group and task is shuffled.
    """
    ok = all_finite(truth, prediction)
    base = df.withColumns({f"__{k}": c for k, c in _errors(truth, prediction, ok).items()})
    y, e = F.col("__y"), F.col("__e")
    aggs = _summary(y, e)
    if n_params is not None:
        aic, bic = information_criteria(F.sum(e * e), F.count(y), n_params)
        aggs += [F.when(F.count(y) > 0, aic).alias("aic"), F.when(F.count(y) > 0, bic).alias("bic")]
    if zero_threshold is not None:
        t, p = y <= zero_threshold, (y + e) <= zero_threshold
        tp, fp, fn = F.count_if(t & p), F.count_if(~t & p), F.count_if(t & ~p)
        precision = F.when(tp + fp > 0, tp / (tp + fp))
        recall = F.when(tp + fn > 0, tp / (tp + fn))
        aggs += [
            (F.count_if(t) / F.count(y)).alias("zero_true_rate"),
            (F.count_if(p) / F.count(y)).alias("zero_pred_rate"),
            (F.count_if(t == p) / F.count(y)).alias("zero_accuracy"),
            precision.alias("zero_precision"),
            recall.alias("zero_recall"),
            F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).alias("zero_f1"),
        ]
    if high_threshold is not None:
        high = y >= high_threshold
        aggs += _summary(F.when(high, y), F.when(high, e), "high_")
    if strict:
        aggs.append(F.count_if(~ok).alias("__bad"))
    out = base.groupBy(*keys).agg(*aggs, *also)
    if not strict:
        return out
    worst = {"rmse": math.inf, "mae": math.inf, "r2": -math.inf, "fit_pct": -math.inf}
    if n_params is not None:
        worst.update({"aic": math.inf, "bic": math.inf})
    return out.withColumns({c: F.when(F.col("__bad") > 0, F.lit(v)).otherwise(F.col(c)) for c, v in worst.items()}).drop("__bad")


def metrics_by(df: DataFrame, truth: str, predictions: dict[str, str], dims: tuple[str, ...]) -> DataFrame:
    """Metrics per prediction mode and group, with group means and row counts; one pass over the data."""
    modes = F.explode(
        F.array(*[F.struct(F.lit(m).alias("mode"), F.col(c).cast("double").alias("prediction")) for m, c in predictions.items()])
    )
    long = df.select(*dims, F.col(truth).cast("double").alias("truth"), modes.alias("m")).select(
        *dims, "truth", "m.mode", "m.prediction"
    )
    more = [F.avg("truth").alias("truth_mean"), F.avg("prediction").alias("prediction_mean"), F.count("*").alias("n_rows")]
    return metrics(long, "truth", "prediction", ("mode", *dims), also=more)


def _correlation(a: Column, b: Column) -> Column:
    """Pearson r; NULL below 2 pairs or with a constant side (where ``corr`` itself fails in ANSI mode)."""
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when((F.count(a) >= 2) & (spread > 0), F.covar_pop(a, b) / spread)


def pearson(df: DataFrame, x: str, y: str, keys: tuple[str, ...] = (), out: str = "r") -> DataFrame:
    """Pearson r over finite pairs; missing for fewer than 2 pairs or a constant side."""
    ok = all_finite(x, y)
    a, b = F.when(ok, F.col(x).cast("double")), F.when(ok, F.col(y).cast("double"))
    return df.groupBy(*keys).agg(_correlation(a, b).alias(out), F.count(a).alias("n_pairs"))


def lag_correlations(df: DataFrame, seq: Sequence, y: str, xs: list[str], max_lag: int) -> DataFrame:
    """Correlation of ``y`` with each input at lags 0..max_lag, over all sequences; lags stay inside one.

    All lags of a row are one array from one window pass. A task adds up the pairs of all lags side by side and writes its sums once,
    so no row is multiplied by the number of lags. Values are counted from the least of their column, so a constant gives exact zeros.
    """
    terms = [(f"{x}_{k}", x, k) for x in xs for k in range(max_lag + 1)]
    low = df.agg(*[F.min(F.when(is_finite(c), F.col(c).cast("double"))).alias(f"m{i}") for i, c in enumerate([y, *xs])]).first()
    least_y, least_x = low["m0"] or 0.0, np.repeat([low[f"m{i + 1}"] or 0.0 for i in range(len(xs))], max_lag + 1)
    kept = dict.fromkeys([*seq.keys, *seq.order_by, y, *xs, *([seq.position] if seq.position else [])])
    rows = regressors(df.select(*kept), seq, terms, 0).select("phi", F.col(y).cast("double").alias("y"))
    names = ("n", "x", "y", "xx", "yy", "xy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), len(terms)))
        for batch in batches:
            for s in range(0, batch.num_rows, 4096):
                part = batch.slice(s, 4096)
                x = part.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, len(terms)) - least_x
                v = part.column(1).to_numpy(zero_copy_only=False).astype(float) - least_y
                both = np.isfinite(x) & np.isfinite(v)[:, None]
                x, w = np.where(both, x, 0.0), np.where(both, v[:, None], 0.0)
                total += np.stack([both.sum(axis=0), x.sum(axis=0), w.sum(axis=0), (x * x).sum(axis=0), (w * w).sum(axis=0), (x * w).sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array([total.T.ravel()], pa.list_(pa.float64()))], names=["s"])

    parts = rows.mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("i", "v"))
    at, what = F.floor(F.col("i") / len(names)).cast("int"), F.col("i") % len(names)
    sums = parts.groupBy(at.alias("at")).agg(*[F.sum(F.when(what == k, F.col("v"))).alias(name) for k, name in enumerate(names)])
    n = F.col("n")
    sides = [F.col("xx") - F.col("x") * F.col("x") / n, F.col("yy") - F.col("y") * F.col("y") / n]
    r = F.when((n >= 2) & (sides[0] > 0) & (sides[1] > 0), (F.col("xy") - F.col("x") * F.col("y") / n) / F.sqrt(sides[0] * sides[1]))
    listed = F.array(*[F.lit(x) for x in xs])
    return sums.select(F.get(listed, F.floor(F.col("at") / (max_lag + 1)).cast("int")).alias("input"), (F.col("at") % (max_lag + 1)).cast("int").alias("lag"), r.alias("r"), n.cast("long").alias("n_pairs"))


def target_bounds(df: DataFrame, y: str, low: float | None = None, margin: float = 0.0, relative: bool = False) -> DataFrame:
    """Bounds for predictions from training rows.

    relative: range widened by ``margin`` times the range on both sides; else ``low`` to max + margin.
    """
    ok = all_finite(y)
    lo, hi = F.min(F.when(ok, F.col(y))), F.max(F.when(ok, F.col(y)))
    if relative:
        pad = F.greatest(hi - lo, F.lit(1e-12)) * margin
        return df.agg((lo - pad).alias("low"), (hi + pad).alias("high"))
    floor = F.lit(low) if low is not None else lo
    top = hi + margin
    return df.agg(floor.alias("low"), F.when(top <= floor, floor + 1.0).otherwise(top).alias("high"))


def select_best(df: DataFrame, metric: str, tried: str, lowest: bool = True) -> DataFrame:
    """Row with the best finite score; the earliest tried wins ties."""
    score = F.col(metric) if lowest else -F.col(metric)
    best = F.min_by(F.struct("*"), F.struct(score, F.col(tried)))
    return df.filter(all_finite(metric)).agg(best.alias("b")).filter(F.col("b").isNotNull()).select("b.*")


def ranked(df: DataFrame, c: str, *tie_break: str) -> DataFrame:
    """Ordered export; missing scores last."""
    return df.orderBy(F.col(c).asc_nulls_last(), *tie_break)


def head(df: DataFrame, order_by: list[str], n: int) -> DataFrame:
    return df.orderBy(*order_by).limit(n)
