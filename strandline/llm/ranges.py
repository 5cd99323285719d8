"""Rows dealt to ranges of a key, so that tasks read them in global order without one task sorting them all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import NULL_ID


def order_of(key: str) -> Column:
    """The key as a long, null before all others."""
    return F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID))


def cuts(docs: DataFrame, key: str, ranges: int) -> np.ndarray:
    """Quantiles of the key that cut it into about so many ranges of equal rows; a key is never split."""
    if ranges < 2:
        return np.empty(0, np.int64)
    at = F.percentile_approx(order_of(key), F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), F.lit(20 * ranges))
    found = docs.agg(at.alias("c")).first()["c"] or []  # one number per range
    return np.unique(np.array(found, np.int64))


def range_of(edges: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return np.searchsorted(edges, keys, side="right").astype(np.int32)


def dealt(docs: DataFrame, key: str, text: str, edges: np.ndarray, heads: dict[int, int] | None = None) -> DataFrame:
    """(part, guest, o, k, t) in order of key and text inside each range, a range wholly inside one partition.

    ``heads`` names keys whose rows are also wanted as guests, after the own rows of another range.
    """
    kind, heads = docs.schema[key].dataType.simpleString(), heads or {}
    names = ["part", "guest", "o", "k", "t"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            o = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(range_of(edges, o)), pa.array(np.zeros(len(o), np.int32)), *batch.columns], names=names)
            guests = [i for i, x in enumerate(o.tolist()) if x in heads]
            if guests:
                some = batch.take(pa.array(guests))
                to = pa.array([heads[x] for x in o[guests].tolist()], pa.int32())
                yield pa.RecordBatch.from_arrays([to, pa.array(np.ones(len(guests), np.int32)), *some.columns], names=names)

    rows = docs.select(order_of(key).alias("o"), F.col(key).alias("k"), F.col(text).alias("t"))
    rows = rows.mapInArrow(place, f"part int, guest int, o long, k {kind}, t string")
    return rows.repartition("part").sortWithinPartitions("part", "guest", "o", "t")


def heads_of(docs: DataFrame, key: str, edges: np.ndarray) -> dict[int, int]:
    """The least key of each range, and the range before it, which wants it as a guest; the last range wants the first of all."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(range_of(edges, batch.column(0).to_numpy())), batch.column(0)], names=["part", "o"])

    firsts = docs.select(order_of(key).alias("o")).mapInArrow(place, "part int, o long").groupBy("part").agg(F.min("o").alias("o"))
    rows = firsts.orderBy("part").collect()  # one row per range
    return {r["o"]: rows[i - 1]["part"] for i, r in enumerate(rows)}
