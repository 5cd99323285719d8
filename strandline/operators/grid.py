"""Search over model orders, input families, polynomial degrees and penalties.

One pass over the training rows fits every candidate. Rows are classed by the candidates they can serve, which depends on the lags a
row has: nearly all rows serve all, those at chunk starts and next to missing values fewer. The sums of a class are taken once, over
all lag terms and their powers, and each candidate reads its own rows and columns out of them. Standardised powers follow from
plain ones by the binomial theorem, and one eigendecomposition serves all penalties. A second pass scores all models side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from strandline.functions.scalars import is_finite
from strandline.operators.features import input_reach, live_inputs, regressors
from strandline.operators.linear import (
    MAX_TERMS, LinearModel, PowerModel, Term, _matrix, additive_terms, powers_of, rough_scales, standardised, target_range, transformed,
)
from strandline.operators.normal import RidgePath, Sums, class_sums, collected, solve, total_sums
from strandline.operators.recurrence import Recurrence, chunks_in
from strandline.sequence import Sequence, with_position

SCORES = "combo int, n long, e2 double, e1 double, y1 double, y2 double"
MODES, METRICS = ("one_step_ahead", "free_run"), ("rmse", "aic", "bic")


@dataclass(frozen=True)
class Candidate:
    """A model to try. ``powers``: its (base term, power) pairs, None for plain least squares without intercept."""

    shape: LinearModel
    powers: tuple[Term, ...] | None = None
    degree: int = 1
    alpha: float = 0.0

    @property
    def size(self) -> int:
        return len(self.shape.terms) if self.powers is None else len(self.powers)


@dataclass
class Fitted:
    candidate: Candidate
    n: int
    weights: np.ndarray  # one per column of the wide design
    model: LinearModel | PowerModel
    bounds: tuple[float, float]


class Design:
    """The columns that any candidate uses: distinct (column, lag) terms, their powers and an intercept."""

    def __init__(self, candidates: list[Candidate]) -> None:
        at: dict[tuple[str, int], int] = {}
        self.base = [[at.setdefault((c, k), len(at)) for _, c, k in x.shape.terms] for x in candidates]
        self.terms = [(f"{c}__{k}", c, k) for c, k in at]
        self.width = len(at)
        self.degree = max(x.degree for x in candidates)
        self.columns = 1 + self.width * self.degree
        self.starts = np.array([x.shape.start for x in candidates])
        self.uses = np.zeros((self.width, len(candidates)), np.float32)
        for k, mine in enumerate(self.base):
            self.uses[mine, k] = 1
        self.last_start = int(self.starts.max(initial=0))

    def slots(self, k: int, powers: int) -> list[int]:
        """Columns of one candidate: intercept and the first ``powers`` powers of its base terms."""
        return [0, *[1 + p * self.width + b for p in range(powers) for b in self.base[k]]]

    def rows(self, df: DataFrame, seq: Sequence, y: str) -> DataFrame:
        """(phi, y, __at): the base terms of every row with a target; missing ones are NaN."""
        wide = regressors(with_position(df, seq, "__at"), seq, self.terms, 0)
        return wide.select("phi", F.col(y).cast("double").alias("y"), F.col("__at").cast("bigint")).filter(is_finite("y"))

    def serves(self, ok: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Which candidates each row can serve: all its terms are finite and it is not before the start."""
        missing = (~ok).astype(np.float32) @ self.uses
        return (missing == 0) & (position[:, None] >= self.starts)


def arx_grid(y: str, xs: list[str], na_values: list[int], nb_values: list[int], nk_values: list[int]) -> list[Candidate]:
    return [Candidate(LinearModel(y, tuple(xs), *orders, (), 0)) for orders in product(na_values, nb_values, nk_values)]


def power_grid(
    y: str, xs: list[str], na_values: list[int], nb_values: list[int], nk_values: list[int], degrees: list[int], alphas: list[float], scope: str = "exogenous_only"
) -> list[Candidate]:
    """Every combination of orders, degree and penalty, in that order."""
    if scope not in ("all", "exogenous_only"):
        raise ValueError("scope must be 'all' or 'exogenous_only'")
    out = []
    for na, nb, nk, degree, alpha in product(na_values, nb_values, nk_values, degrees, alphas):
        shape = LinearModel(y, tuple(xs), na, nb, nk, (), 0)
        out.append(Candidate(shape, additive_terms(len(shape.terms), degree, na if scope == "exogenous_only" else 0), degree, alpha))
    return out


def family_grid(
    df: DataFrame, seq: Sequence, family: str, y: str, na_values: list[int], nb_values: list[int], nk_values: list[int],
    current: str, voltage: str, history: list[str], feed: str,
) -> tuple[DataFrame, list[Candidate]]:
    """``df`` with the inputs of a family for every nb, and the candidates over them: each nb has inputs, delays and a reach of its own."""
    made, inputs = df, {}
    for nb in nb_values:
        made, inputs[nb] = live_inputs(made, seq, family, nb, current, voltage, history, feed)
    out = []
    for na, nb, nk in product(na_values, nb_values, nk_values):
        out.append(Candidate(LinearModel(y, tuple(inputs[nb]), na, nb, nk, (), 0, **input_reach(family, nb))))
    return made, out


def _fit(design: Design, candidates: list[Candidate], sums: list[Sums], centre: np.ndarray, spread: np.ndarray, margin: float, clip: bool) -> tuple[dict[int, Fitted], dict[int, str]]:
    """Fitted models and why the others were skipped. Candidates that differ in the penalty alone share their decomposition."""
    fitted, skipped, paths = {}, {}, {}
    for k, x in enumerate(candidates):
        s, base = sums[k], design.base[k]
        if s.n <= x.size if x.powers is None else not s.n:
            skipped[k] = "too few training rows"
            continue
        weights = np.zeros(design.columns)
        if x.powers is None:
            theta = solve(s.matrix[:-1, :-1], s.matrix[:-1, -1])
            weights[design.slots(k, 1)[1:]] = theta
            model: LinearModel | PowerModel = replace(x.shape, theta=tuple(theta.tolist()), n_samples=s.n)
            bounds = (-np.inf, np.inf)
        else:
            key = (tuple(base), x.powers, s.n)
            if key not in paths:
                mean, scale, turn = standardised(s, x.powers, len(base))
                paths = {key: (mean, scale, turn, RidgePath(transformed(s, turn)))}  # penalties of one model follow each other
            mean, scale, turn, path = paths[key]
            theta = path.solution(x.alpha)
            weights[design.slots(k, x.degree)] = turn.T @ theta
            wide = target_range(s, margin)
            model = PowerModel(
                replace(x.shape, n_samples=s.n), tuple((centre[base] + spread[base] * mean).tolist()), tuple((spread[base] * scale).tolist()),
                x.powers, x.alpha, wide, clip, tuple(theta.tolist()),
            )
            bounds = wide if clip else (-np.inf, np.inf)
        if np.isfinite(weights).all():
            fitted[k] = Fitted(x, s.n, weights, model, bounds)
        else:
            skipped[k] = "diverged: no finite solution"
    return fitted, skipped


def search(
    train: DataFrame,
    validation: DataFrame,
    seq: Sequence,
    candidates: list[Candidate],
    *,
    mode: str = "one_step_ahead",
    metric: str = "rmse",
    max_terms: int = MAX_TERMS,
    margin: float = 0.0,
    clip_predictions: bool = False,
) -> tuple[list[Row], LinearModel | PowerModel]:
    """One row per candidate, in order, with its scores or the reason why it has none (``status``); and the best model.

    A candidate of over ``max_terms`` terms is recorded as skipped, so is one with too few rows or without a finite score. The first
    of equally good ones wins.
    """
    if mode not in MODES:
        raise ValueError("mode must be one_step_ahead or free_run")
    if metric not in METRICS:
        raise ValueError("metric must be rmse, aic or bic")
    status = {k: f"over the budget of {max_terms} terms" for k, x in enumerate(candidates) if x.size > max_terms}
    tried = [k for k in range(len(candidates)) if k not in status]
    if not tried:
        raise RuntimeError("no candidate is within the budget of terms")
    y = candidates[0].shape.y
    mine = [candidates[k] for k in tried]
    design = Design(mine)
    if design.columns > MAX_TERMS:
        raise ValueError(f"the candidates use {design.columns} columns together, over the budget of {MAX_TERMS}: search them in parts")
    powers = any(x.powers is not None for x in mine)
    rows = design.rows(train, seq, y)
    centre, spread = rough_scales(rows, "phi", design.width) if powers else (np.zeros(design.width), np.ones(design.width))

    def wide(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Powers of the base terms (missing ones as 0), targets, and which candidates each row serves."""
        x = (_matrix(batch.column(0), design.width) - centre) / spread
        ok = np.isfinite(x)
        position = batch.column(2).to_numpy(zero_copy_only=False)
        whole = ok.all(axis=1) & (position >= design.last_start)
        serves = np.ones((len(x), len(mine)), bool)
        if not whole.all():
            serves[~whole] = design.serves(ok[~whole], position[~whole])
        return powers_of(np.where(ok, x, 0.0), design.degree), batch.column(1).to_numpy(zero_copy_only=False), serves

    def classify(batch: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray]]:
        design_rows, truth, serves = wide(batch)
        z = np.column_stack([design_rows, truth])
        packed = np.packbits(serves, axis=1)
        kinds, which = np.unique(packed, axis=0, return_inverse=True)
        for i, kind in enumerate(kinds):
            if kind.any():
                yield kind.tobytes(), z[which.ravel() == i]

    sums = [Sums.nothing(1 + len(design.slots(k, x.degree)) - (x.powers is None)) for k, x in enumerate(mine)]
    for kind, s in collected(total_sums(class_sums(rows, classify, design.columns + 1)), design.columns + 1):
        served = np.unpackbits(np.frombuffer(kind, np.uint8), count=len(mine)).astype(bool)
        for k in np.flatnonzero(served).tolist():
            x = mine[k]
            use = design.slots(k, x.degree)[1 if x.powers is None else 0 :]
            sums[k].add(s.block([*use, design.columns]))
    fitted, skipped = _fit(design, mine, sums, centre, spread, margin, clip_predictions)
    if not fitted:
        raise RuntimeError("no combination has enough training rows")

    score = _one_step if mode == "one_step_ahead" else _free_run
    errors = {r["combo"]: r for r in score(validation, seq, design, fitted, wide, y, centre, spread).groupBy("combo").agg(
        *[F.sum(c).alias(c) for c in ("n", "e2", "e1", "y1", "y2")]
    ).collect()}  # one row per candidate
    out, best = [], None
    for k, x in enumerate(candidates):
        t = tried.index(k) if k in tried else None
        row = {"na": x.shape.na, "nb": x.shape.nb, "nk": x.shape.nk, "degree": x.degree, "alpha": x.alpha, "n_params": x.size}
        if t is None or t in skipped or t not in errors:
            out.append(Row(**row, **_nothing, status=status.get(k) or skipped.get(t, "no validation rows")))
            continue
        row |= {"n_train": fitted[t].n, **_scores(errors[t], x.size)}
        value = row[metric]
        fine = value is not None and np.isfinite(value)
        out.append(Row(**row, selection_score=float(value) if fine else None, status="ok" if fine else f"diverged: {metric} is not finite"))
        if fine and (best is None or value < best[0]):
            best = (value, fitted[t].model)
    if best is None:
        raise RuntimeError("no combination produced a finite score")
    return out, best[1]


_nothing = dict.fromkeys(("n_train", "n_samples", "rmse", "mae", "r2", "fit_pct", "aic", "bic", "selection_score"))
RESULT = (
    "na int, nb int, nk int, degree int, alpha double, n_params int, n_train long, n_samples long, rmse double, mae double, r2 double, fit_pct double, "
    "aic double, bic double, selection_score double, status string"
)


def _scores(e: Row, n_params: int) -> dict[str, float | None]:
    n, sse, k = e["n"], e["e2"], n_params + 1
    sst = e["y2"] - e["y1"] ** 2 / n
    floored = max(sse, np.finfo(float).tiny)
    deviance = n * (np.log(2.0 * np.pi * floored / n) + 1.0)
    return {
        "n_samples": n, "rmse": float(np.sqrt(sse / n)), "mae": e["e1"] / n, "r2": 1 - sse / sst if sst > 0 else None,
        "fit_pct": float(100.0 * (1 - np.sqrt(sse / sst))) if sst > 0 else None, "aic": float(deviance + 2.0 * k), "bic": float(deviance + k * np.log(n)),
    }


def _error_rows(names: list[int], truth: np.ndarray, predicted: np.ndarray, valid: np.ndarray) -> pa.RecordBatch:
    """Error sums of one batch, one row per model that predicts anything in it."""
    e = np.where(valid, truth[:, None] - predicted, 0.0)
    seen = np.where(valid, truth[:, None], 0.0)
    columns = [np.array(names, np.int32), valid.sum(axis=0), (e * e).sum(axis=0), np.abs(e).sum(axis=0), seen.sum(axis=0), (seen * seen).sum(axis=0)]
    some = valid.any(axis=0)
    return pa.RecordBatch.from_arrays([pa.array(c[some]) for c in columns], names=[c.split()[0] for c in SCORES.split(", ")])


def _one_step(validation, seq, design, fitted, wide, y, centre, spread) -> DataFrame:
    names = list(fitted)
    weights = np.column_stack([fitted[k].weights for k in names])
    low, high = (np.array([fitted[k].bounds[i] for k in names]) for i in (0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 2048):
                rows, truth, serves = wide(batch.slice(s, 2048))
                with np.errstate(all="ignore"):
                    predicted = np.clip(rows @ weights, low, high)
                yield _error_rows(names, truth, predicted, serves[:, names] & np.isfinite(predicted))

    return design.rows(validation, seq, y).mapInArrow(run, SCORES)


def _free_run(validation, seq, design, fitted, wide, y, centre, spread) -> DataFrame:
    """All models of all chunks of a batch advance together; only the inputs' part is linear algebra over whole batches."""
    names = list(fitted)
    outputs = [i for i, (_, c, _) in enumerate(design.terms) if c == y]  # lags of the target: fed by the models themselves
    lags = max([design.terms[i][2] for i in outputs], default=0)
    by_lag = {design.terms[i][2]: i for i in outputs}
    weights = np.column_stack([fitted[k].weights for k in names])
    ar = np.zeros((len(names), lags, design.degree))
    for lag, i in by_lag.items():
        for p in range(design.degree):
            ar[:, lag - 1, p] = weights[1 + p * design.width + i]
    drive_weights = weights.copy()
    for i in outputs:
        drive_weights[1 + i :: design.width] = 0.0
    recurrence = Recurrence(
        ar, np.array([centre[by_lag[k + 1]] if k + 1 in by_lag else 0.0 for k in range(lags)]), np.array([spread[by_lag[k + 1]] if k + 1 in by_lag else 1.0 for k in range(lags)]),
        False, np.array([fitted[k].bounds[0] for k in names]), np.array([fitted[k].bounds[1] for k in names]), strict=any(fitted[k].candidate.powers is not None for k in names),
    )
    starts = design.starts[names]
    inputs = design.uses.copy()
    inputs[outputs] = 0
    inputs = inputs[:, names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, edges, states in chunks_in(batches, "__at", recurrence):
            x = (_matrix(batch.column(0), design.width) - centre) / spread
            ok = np.isfinite(x)
            drive = powers_of(np.where(ok, x, 0.0), design.degree) @ drive_weights
            drive[(~ok).astype(np.float32) @ inputs > 0] = np.nan  # an input is missing
            truth, position = batch.column(1).to_numpy(zero_copy_only=False).astype(float), batch.column(2).to_numpy(zero_copy_only=False)
            predicted = recurrence.run(drive, truth, position[:, None] >= starts, edges, states)
            truth_known = np.isfinite(truth)
            yield _error_rows(names, np.where(truth_known, truth, 0.0), predicted, np.isfinite(predicted) & truth_known[:, None])

    wide_rows = regressors(with_position(validation, seq, "__at"), seq, design.terms, 0)
    held = wide_rows.select("phi", F.col(y).cast("double").alias("y"), F.col("__at").cast("bigint").alias("__at"), *seq.keys, *[c for c in seq.order_by if c not in seq.keys])
    arranged = held.repartition(*seq.keys).sortWithinPartitions(*seq.keys, *seq.order_by).select("phi", "y", "__at")
    return arranged.mapInArrow(run, SCORES)


def grid_search(
    train: DataFrame, validation: DataFrame, seq: Sequence, y: str, xs: list[str], na_values: list[int], nb_values: list[int], nk_values: list[int],
    *, mode: str = "one_step_ahead", metric: str = "rmse", max_terms: int = MAX_TERMS,
) -> tuple[DataFrame, LinearModel]:
    """Every (na, nb, nk) by least squares over the inputs as they are: (scores, best model)."""
    rows, best = search(train, validation, seq, arx_grid(y, xs, na_values, nb_values, nk_values), mode=mode, metric=metric, max_terms=max_terms)
    return scores_table(train, rows).drop("degree", "alpha"), best


def scores_table(df: DataFrame, rows: list[Row]) -> DataFrame:
    return df.sparkSession.createDataFrame([tuple(r) for r in rows], RESULT)
