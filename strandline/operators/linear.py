"""Autoregressive models: fits from normal equations, one-step predictions and free runs.

Sums come from ``normal``, the ordered part of a free run from ``recurrence``, the search over many models from ``grid``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.scalars import clip
from strandline.operators.features import lag_terms, regressors, usable
from strandline.operators.normal import RidgePath, Sums, class_sums, collected, solve, total_sums
from strandline.operators.recurrence import Recurrence, chunks_in
from strandline.sequence import Sequence, with_field, with_position

MAX_TERMS = 4_000  # a task holds the square of it in doubles (128 MB)
FLAT = 1e-7  # a spread of less, in units of the first pass, counts as constant


@dataclass(frozen=True)
class LinearModel:
    """Coefficients of an ARX model; ``xs`` are its exogenous input columns.

    ``lags``: how many delays each input is taken at (``nb`` if None). ``reach``: how many earlier rows an input column itself
    needs, as rolling inputs do; no row before all of them are there is predicted or simulated.
    """

    y: str
    xs: tuple[str, ...]
    na: int
    nb: int
    nk: int
    theta: tuple[float, ...]
    n_samples: int
    lags: int | None = None
    reach: int = 0

    @property
    def delays(self) -> int:
        return self.nb if self.lags is None else self.lags

    @property
    def terms(self) -> list[tuple[str, str, int]]:
        return lag_terms(self.y, list(self.xs), self.na, self.delays, self.nk)

    @property
    def names(self) -> list[str]:
        return [n for n, _, _ in self.terms]

    @property
    def start(self) -> int:
        return max(self.na, self.nk + self.delays - 1 + self.reach if self.delays > 0 else 0)


Term = tuple[int, int]  # (index of the base term, power); the intercept has power 0


def additive_terms(n_base: int, degree: int, linear_only: int = 0) -> tuple[Term, ...]:
    """Intercept, every base term, and powers up to ``degree`` of all base terms but the first ``linear_only``."""
    return ((-1, 0), *[(k, p) for p in range(1, degree + 1) for k in range(n_base) if p == 1 or k >= linear_only])


@dataclass(frozen=True)
class PowerModel:
    """Weighted sum of powers of standardised lag terms: one coefficient per (base term, power) of ``terms``."""

    base: LinearModel
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    terms: tuple[Term, ...]
    alpha: float
    bounds: tuple[float, float]
    clip_predictions: bool = False
    theta: tuple[float, ...] = field(default=())

    @property
    def names(self) -> list[str]:
        base = self.base.names
        return ["intercept" if p == 0 else base[k] if p == 1 else f"{base[k]}^{p}" for k, p in self.terms]

    @property
    def intercept(self) -> float:
        return float(sum(v for (_, p), v in zip(self.terms, self.theta) if p == 0))

    def polynomial(self, k: int) -> list[float]:
        """Coefficients of the powers 1, 2, ... of one base term."""
        mine = {p: v for (j, p), v in zip(self.terms, self.theta) if j == k and p > 0}
        return [float(mine.get(p, 0.0)) for p in range(1, max(mine, default=0) + 1)]


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return values.reshape(len(flat), width)


def _checked(terms: int) -> None:
    if terms > MAX_TERMS:
        raise ValueError(f"{terms} model terms exceed the budget of {MAX_TERMS}")


def gram_sums(df: DataFrame, phi: str, y: str, width: int) -> DataFrame:
    """Packed upper triangle of [X y]'[X y] over all rows, which must be finite: one row (class, task, n, low, high, sums)."""
    _checked(width)

    def classify(batch: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray]]:
        yield b"", np.column_stack([_matrix(batch.column(0), width), batch.column(1).to_numpy(zero_copy_only=False)])

    return total_sums(class_sums(df.select(phi, F.col(y).cast("double").alias("y")), classify, width + 1))


def gram(df: DataFrame, phi: str, y: str, width: int) -> DataFrame:
    """The same sums as (i, j, s) with i <= j; (-1, -1) holds the number of rows."""
    upper = np.triu_indices(width + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
                columns = [np.append(i, -1).astype(np.int32) for i in upper]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.append(sums.values.to_numpy(), float(n)))], names=["i", "j", "s"])

    return gram_sums(df, phi, y, width).select("n", "sums").mapInArrow(run, "i int, j int, s double")


def gram_sql(df: DataFrame, xs: list[str], y: str) -> DataFrame:
    """The same sums for a few columns with built-in aggregates only: one row."""
    z = [*xs, y]
    pairs = [(a, b) for k, a in enumerate(z) for b in z[k:]]
    return df.agg(F.count("*").alias("n"), *[F.sum(F.col(a) * F.col(b)).alias(f"{a}__{b}") for a, b in pairs])


def _sums(df: DataFrame, phi: str, y: str, width: int) -> Sums:
    out = Sums.nothing(width + 1)
    for _, s in collected(gram_sums(df, phi, y, width), width + 1):
        out.add(s)
    return out


def fit_arx(df: DataFrame, seq: Sequence, y: str, xs: list[str], na: int, nb: int, nk: int, *, lags: int | None = None, reach: int = 0) -> LinearModel:
    """ARX by least squares, without intercept; ``lags`` and ``reach`` as ``input_reach`` gives them for a family of inputs."""
    shape = LinearModel(y, tuple(xs), na, nb, nk, (), 0, lags, reach)
    terms = shape.terms
    _checked(len(terms))
    rows = regressors(df, seq, terms, shape.start).filter(usable("phi", y))
    sums = _sums(rows, "phi", y, len(terms))
    theta = solve(sums.matrix[:-1, :-1], sums.matrix[:-1, -1]) if sums.n else np.zeros(len(terms))
    return replace(shape, theta=tuple(float(v) for v in theta), n_samples=sums.n)


def dot(phi: str, theta: tuple[float, ...] | list[float]) -> Column:
    if len(theta) == 0:
        return F.lit(0.0)
    weights = F.array(*[F.lit(float(v)) for v in theta])
    return F.aggregate(F.zip_with(F.col(phi), weights, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def predict_one_step(df: DataFrame, seq: Sequence, model: LinearModel, out: str = "y_pred_osa") -> DataFrame:
    """One-step predictions aligned to every row: NULL in the warm-up or where a term or the truth is missing."""
    rows = regressors(df, seq, model.terms, model.start)
    return rows.withColumn(out, F.when(usable("phi", model.y), dot("phi", model.theta))).drop("phi")


def _free_run(driven: DataFrame, seq: Sequence, recurrence: Recurrence, y: str, out: str) -> DataFrame:
    """``driven`` has __drive, has_full_history and __at, the position in the chunk. Chunks run in order inside a task, side by side in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, edges, states in chunks_in(batches, "__at", recurrence):
            get = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            truth, drive = get("__truth").astype(float), get("__drive").astype(float)
            predicted = recurrence.run(drive[:, None], truth, get("has_full_history").astype(bool)[:, None], edges, states)[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(predicted, pa.float64())], names=[*batch.schema.names, out])

    rows = driven.drop(out).withColumn("__truth", F.col(y).cast("double"))
    arranged = rows.repartition(*seq.keys).sortWithinPartitions(*seq.keys, *seq.order_by)
    done = arranged.mapInArrow(run, with_field(arranged, out, T.DoubleType()))
    return done.withColumn(out, F.when(~F.isnan(out), F.col(out))).drop("__drive", "__truth", "__at")


def simulate_linear(
    df: DataFrame,
    seq: Sequence,
    model: LinearModel,
    *,
    mode: str = "absolute",
    bounds: tuple[float, float] | None = None,
    seed_missing: float = 0.0,
    out: str = "y_pred_freerun",
) -> DataFrame:
    """Free-run simulation: warm-up rows are seeded with the truth, later lags are the model's own outputs.

    The exogenous contribution is computed by Spark for all rows; the grouped step runs the
    short recurrence only. mode="delta" adds the output to the previous value; bounds clip it.
    """
    rows = regressors(with_position(df, seq, "__at"), seq, model.terms[model.na :], model.start)
    driven = rows.withColumn("__drive", dot("phi", model.theta[model.na :])).drop("phi")
    ar = np.array(model.theta[: model.na]).reshape(1, model.na, 1)
    low, high = bounds if bounds is not None else (-np.inf, np.inf)
    recurrence = Recurrence(ar, np.zeros(model.na), np.ones(model.na), mode == "delta", low, high, seed=seed_missing)
    return _free_run(driven, seq, recurrence, model.y, out)


def predict_aligned(df: DataFrame, seq: Sequence, model: LinearModel) -> DataFrame:
    """Every input row with ``has_full_history``, one-step and free-run predictions."""
    return simulate_linear(predict_one_step(df, seq, model).drop("has_full_history"), seq, model)


# --- powers of lag terms ----------------------------------------------------------------------


def powers_of(x: np.ndarray, degree: int) -> np.ndarray:
    """[1, x, x^2, ...]: a column per base term and power, powers in turn."""
    parts, z = [np.ones((len(x), 1))], np.ones_like(x)
    for _ in range(degree):
        z = z * x
        parts.append(z)
    return np.hstack(parts)


def standardised(sums: Sums, terms: tuple[Term, ...], n_base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means and spreads of the base terms, and the matrix that turns plain powers into powers of standardised terms.

    ``sums`` are those of ``powers_of``: by the binomial theorem one pass over plain powers gives the sums of any standardisation.
    """
    slot = lambda k, p: 0 if p == 0 else 1 + (p - 1) * n_base + k
    g, n = sums.matrix, sums.n
    first = slice(1, 1 + n_base)
    mean = g[0, first] / n
    spread = np.sqrt(np.maximum(np.diag(g)[first] / n - mean**2, 0.0))
    scale = np.where(spread > FLAT, spread, 1.0)
    turn = np.zeros((len(terms), g.shape[0] - 1))
    for row, (k, p) in enumerate(terms):
        choose = 1.0
        for q in range(p, -1, -1):  # (x - m)^p = sum of choose(p, q) x^q (-m)^(p - q)
            turn[row, slot(k, q)] += choose * (-mean[k]) ** (p - q) / scale[k] ** p if p else 1.0
            choose = choose * q / (p - q + 1)
    return mean, scale, turn


def transformed(sums: Sums, turn: np.ndarray) -> Sums:
    """The sums after the columns but the target are turned by ``turn``."""
    whole = np.zeros((len(turn) + 1, sums.matrix.shape[0]))
    whole[:-1, :-1] = turn
    whole[-1, -1] = 1.0
    return Sums(sums.n, sums.low, sums.high, whole @ sums.matrix @ whole.T)


def target_range(sums: Sums, margin: float) -> tuple[float, float]:
    """The range of the targets, widened by ``margin`` times its width."""
    pad = margin * (sums.high - sums.low)
    return float(sums.low - pad), float(sums.high + pad)


def rough_scales(rows: DataFrame, phi: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Centre and spread per base term over the finite values of a first pass: powers of such values neither vanish nor explode."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, width))
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), width)
                ok = np.isfinite(x)
                x = np.where(ok, x, 0.0)
                total += np.stack([ok.sum(axis=0), x.sum(axis=0), (x * x).sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["s"])

    parts = rows.select(phi).mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("i", "v"))
    found = np.zeros(3 * width)
    for r in parts.groupBy("i").agg(F.sum("v").alias("v")).collect():  # three numbers per base term
        found[r["i"]] = r["v"]
    n, s, q = found.reshape(3, width)
    n = np.maximum(n, 1)
    spread = np.sqrt(np.maximum(q / n - (s / n) ** 2, 0.0))
    return s / n, np.where(spread > 0, spread, 1.0)


def fit_power_ridge(
    df: DataFrame,
    seq: Sequence,
    y: str,
    xs: list[str],
    na: int,
    nb: int,
    nk: int,
    degree: int,
    alpha: float,
    *,
    scope: str = "exogenous_only",
    max_terms: int = MAX_TERMS,
    margin: float = 0.0,
    clip_predictions: bool = False,
    lags: int | None = None,
    reach: int = 0,
) -> PowerModel:
    """Ridge over standardised lag terms and their powers; the intercept is not penalised.

    Two passes over the lag rows: rough centres and spreads, then the sums of plain powers, from which the standardised ones follow.
    """
    if scope not in ("all", "exogenous_only"):
        raise ValueError("scope must be 'all' or 'exogenous_only'")
    shape = LinearModel(y, tuple(xs), na, nb, nk, (), 0, lags, reach)
    base = shape.terms
    terms = additive_terms(len(base), degree, na if scope == "exogenous_only" else 0)
    if max_terms and len(terms) > max_terms:
        raise ValueError(f"{len(terms)} expanded terms exceed the budget of {max_terms}")
    _checked(1 + degree * len(base))
    rows = regressors(df, seq, base, shape.start).filter(usable("phi", y)).select("phi", F.col(y).cast("double").alias("y"))
    centre, spread = rough_scales(rows, "phi", len(base))
    width = 1 + degree * len(base)

    def classify(batch: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray]]:
        w = powers_of((_matrix(batch.column(0), len(base)) - centre) / spread, degree)
        yield b"", np.column_stack([w, batch.column(1).to_numpy(zero_copy_only=False)])

    sums = Sums.nothing(width + 1)
    for _, s in collected(total_sums(class_sums(rows, classify, width + 1)), width + 1):
        sums.add(s)
    if not sums.n:
        raise ValueError("no finite training rows")
    mean, scale, turn = standardised(sums, terms, len(base))
    theta = RidgePath(transformed(sums, turn)).solution(alpha)
    return PowerModel(
        replace(shape, n_samples=sums.n), tuple((centre + spread * mean).tolist()), tuple((spread * scale).tolist()), terms, alpha,
        target_range(sums, margin), clip_predictions, tuple(theta.tolist()),
    )


def _power_sum(phi: str, model: PowerModel, first: int, last: int) -> Column:
    """Sum over base terms first..last of their polynomial in the standardised value (Horner form)."""
    out = F.lit(0.0)
    for slot, k in enumerate(range(first, last)):
        z = (F.col(phi)[slot] - F.lit(float(model.mean[k]))) / F.lit(float(model.scale[k]))
        poly = F.lit(0.0)
        for c in reversed(model.polynomial(k)):
            poly = (poly + F.lit(c)) * z
        out = out + poly
    return out


def predict_one_step_powers(df: DataFrame, seq: Sequence, model: PowerModel, out: str = "y_pred_osa") -> DataFrame:
    base = model.base
    rows = regressors(df, seq, base.terms, base.start)
    value = F.lit(model.intercept) + _power_sum("phi", model, 0, len(model.mean))
    if model.clip_predictions:
        value = clip(value, *model.bounds)
    return rows.withColumn(out, F.when(usable("phi", base.y), value)).drop("phi")


def simulate_powers(df: DataFrame, seq: Sequence, model: PowerModel, out: str = "y_pred_freerun") -> DataFrame:
    """Free run with power terms; a diverging trajectory is missing to its end.

    Spark evaluates the exogenous polynomial; the ordered step evaluates the autoregressive one.
    """
    base, na = model.base, model.base.na
    rows = regressors(with_position(df, seq, "__at"), seq, base.terms[na:], base.start)
    driven = rows.withColumn("__drive", F.lit(model.intercept) + _power_sum("phi", model, na, len(model.mean))).drop("phi")
    mine = [model.polynomial(k) for k in range(na)]
    ar = np.zeros((1, na, max(map(len, mine), default=1)))
    for k, c in enumerate(mine):
        ar[0, k, : len(c)] = c
    low, high = model.bounds if model.clip_predictions else (-np.inf, np.inf)
    recurrence = Recurrence(ar, np.array(model.mean[:na]), np.array(model.scale[:na]), False, low, high, strict=True)
    return _free_run(driven, seq, recurrence, base.y, out)
