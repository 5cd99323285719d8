"""Normal equations of many models from one pass over the rows.

A row belongs to a class: the set of models it can serve, given which of its lags are there. Each task sums Z'Z per class with BLAS and
writes one packed upper triangle per class; two shuffles, of about the square root of the tasks and of one row each, add them up.
So neither rows nor single matrix entries are shuffled, and the driver reads one array per class, one at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HELD_BYTES = 1 << 28  # matrices that a task holds before it writes them
JITTER = 1e-10
TRIANGLES = "class binary, task int, n long, low double, high double, sums array<double>"
_NAMES = ["class", "task", "n", "low", "high", "sums"]

Classify = Callable[[pa.RecordBatch], Iterable[tuple[bytes, np.ndarray]]]


@dataclass
class Sums:
    """Z'Z of n rows; the target is the last column of Z and lies between low and high."""

    n: int
    low: float
    high: float
    matrix: np.ndarray

    def add(self, other: "Sums") -> None:
        self.n += other.n
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        self.matrix += other.matrix

    def block(self, use: list[int]) -> "Sums":
        return Sums(self.n, self.low, self.high, self.matrix[np.ix_(use, use)])

    @staticmethod
    def nothing(width: int) -> "Sums":
        return Sums(0, math.inf, -math.inf, np.zeros((width, width)))


def _batch(rows: list[tuple[bytes, int, int, float, float, np.ndarray]]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=_NAMES)


def class_sums(rows: DataFrame, classify: Classify, width: int) -> DataFrame:
    """(class, task, n, low, high, sums): one packed triangle per class and task. ``classify`` splits a batch into (class, Z)."""
    upper = np.triu_indices(width)
    most = max(1, HELD_BYTES // (8 * width * width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = TaskContext.get().partitionId(), {}

        def written() -> Iterator[pa.RecordBatch]:
            for name, s in held.items():
                yield _batch([(name, task, s.n, s.low, s.high, s.matrix[upper])])
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            for name, z in classify(batch):
                if len(z):
                    if name not in held and len(held) >= most:
                        yield from written()
                    held.setdefault(name, Sums.nothing(width)).add(Sums(len(z), float(z[:, -1].min()), float(z[:, -1].max()), z.T @ z))
        yield from written()

    return rows.mapInArrow(run, TRIANGLES)


def _added(parts: DataFrame, by: list[str]) -> DataFrame:
    """Triangles of equal ``by`` added up; rows stream, one sum is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, task, n, low, high, sums = None, 0, 0, math.inf, -math.inf, None
        for batch in batches:
            slots = batch.column(1).to_pylist()
            lists = batch.column(5)
            flat, edge = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for i, (name, m, a, b) in enumerate(zip(batch.column(0).to_pylist(), *[batch.column(c).to_pylist() for c in (2, 3, 4)])):
                mine = (name, slots[i]) if len(by) > 1 else (name,)
                if key is not None and mine != key:
                    yield _batch([(key[0], task, n, low, high, sums)])
                    n, low, high, sums = 0, math.inf, -math.inf, None
                part = flat[edge[i] : edge[i + 1]]
                key, task, n, low, high = mine, slots[i], n + m, min(low, a), max(high, b)
                sums = part.copy() if sums is None else sums + part
        if key is not None:
            yield _batch([(key[0], task, n, low, high, sums)])

    return parts.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, TRIANGLES)


def total_sums(parts: DataFrame) -> DataFrame:
    """One triangle per class. Tasks are first put together in about as many slots as the root of their number."""
    spark = parts.sparkSession
    slots = math.isqrt(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)) + 1
    return _added(_added(parts.withColumn("task", F.pmod("task", F.lit(slots))), ["class", "task"]), ["class"])


def collected(sums: DataFrame, width: int) -> Iterator[tuple[bytes, Sums]]:
    """Driver side: one class at a time."""
    i, j = np.triu_indices(width)
    for row in sums.toLocalIterator():
        matrix = np.zeros((width, width))
        matrix[i, j] = row["sums"]
        matrix[j, i] = row["sums"]
        yield bytes(row["class"]), Sums(row["n"], row["low"], row["high"], matrix)


def solve(g: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Solve normal equations; a singular or ill-conditioned system gets a small diagonal jitter."""
    if g.size == 0:
        return np.empty(0)
    try:
        if np.linalg.cond(g) < 1.0 / np.finfo(float).eps:
            return np.linalg.solve(g, rhs)
    except np.linalg.LinAlgError:
        pass
    jitter = JITTER * max(float(np.trace(g)) / len(g), 1.0)
    return np.linalg.solve(g + jitter * np.eye(len(g)), rhs)


class RidgePath:
    """Ridge solutions for any penalty from one eigendecomposition; the first column is the intercept, which is not penalised."""

    def __init__(self, sums: Sums) -> None:
        g, n = sums.matrix, sums.n
        self.mean = g[0, 1:] / n  # of every column, the target last
        centred = g[1:, 1:] - n * np.outer(self.mean, self.mean)
        self.values, self.vectors = np.linalg.eigh(centred[:-1, :-1])
        self.target = self.vectors.T @ centred[:-1, -1]

    def solution(self, alpha: float) -> np.ndarray:
        damped = self.values + alpha
        if len(damped) and damped.min() <= np.finfo(float).eps * max(damped.max(), 1.0) * len(damped):
            damped = damped + JITTER * max(float(self.values.mean()), 1.0)
        theta = self.vectors @ (self.target / damped)
        return np.concatenate([[self.mean[-1] - self.mean[:-1] @ theta], theta])
