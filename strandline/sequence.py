"""Ordered-sequence primitives that stay correct and balanced when one key is huge.

A plain ``Window.partitionBy(key)`` sends a whole key to one task. Here a sequence may be cut into
``bucket``s: a SQL expression that never decreases along the sequence order, such as ``floor(t / 60)``.
Work is then partitioned by (key, bucket) and stitched together:

* ``running_sum`` / ``with_position``: per-bucket totals (a map-side-combined aggregate, one row per
  bucket) give each bucket its starting offset;
* ``carry``: last value seen in earlier buckets fills the head of a bucket;
* ``framed``: bounded look-back/look-ahead windows run on fixed-size position segments, each
  segment carrying copies of the few neighbour rows its frames reach into.

``bucket=None`` states that groups are bounded, by construction (chunks of a fixed length) or by
count (``measured``); the same operators then use a single ordinary window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

if TYPE_CHECKING:
    import pandas as pd

BUCKET = "__bucket"
SEGMENT = "__segment"
CORE = "__core"
POSITION = "__pos"


@dataclass(frozen=True)
class Sequence:
    """How rows form ordered sequences.

    keys: columns naming the sequence (NULL is a value like any other). order_by: total order inside it.
    bucket: integral SQL expression, non-decreasing along the order (rows where it is NULL come
    first); None if groups are bounded.
    axis: numeric SQL expression, non-decreasing along the order, from which ``measured`` sizes buckets.
    position: existing 0-based dense position column, if the table already stores one.
    segment_rows: rows per task-level segment for bounded frames.
    """

    keys: tuple[str, ...]
    order_by: tuple[str, ...]
    bucket: str | None = None
    axis: str | None = None
    width: float | None = None
    position: str | None = None
    segment_rows: int = 200_000

    def sized(self, width: float | None) -> "Sequence":
        """Buckets of ``width`` axis units; none if ``width`` is None."""
        bucket = None if width is None else f"floor(({self.axis}) / {width!r}D)"
        return replace(self, width=width, bucket=bucket)

    def along(self, axis: str, order_by: tuple[str, ...], keys: tuple[str, ...] | None = None) -> "Sequence":
        """The same bucket width for rows ordered by another column on the same scale."""
        return Sequence(keys or self.keys, order_by, axis=axis, segment_rows=self.segment_rows).sized(self.width)


# Most rows of one key that a single window task may hold.
ROWS_PER_WINDOW = 1_000_000


def measured(df: DataFrame, seq: Sequence, limit: int | None = None) -> Sequence:
    """Choose the plan by size: one map-side-combined pass over keys and axis decides.

    If no key exceeds ``limit`` rows, one window per key is the cheaper plan and no buckets are used.
    Otherwise buckets are sized so that the densest large key puts about ``limit / 4`` rows in each
    (a given ``bucket`` is kept as it is). Measure the base table once and reuse the answer.
    """
    limit = ROWS_PER_WINDOW if limit is None else limit
    span = F.expr(seq.axis) if seq.axis is not None else F.lit(0)
    per_key = df.groupBy(*seq.keys).agg(F.count("*").alias("n"), (F.max(span) - F.min(span)).cast("double").alias("span"))
    biggest, spacing = per_key.agg(
        F.max("n"), F.min(F.when((F.col("n") > limit) & (F.col("span") > 0), F.col("span") / F.col("n")))
    ).first()
    if (biggest or 0) <= limit:
        return replace(seq, bucket=None, width=None)
    return seq.sized(spacing * limit / 4) if seq.axis is not None and spacing is not None else seq


def join_stats(
    df: DataFrame, stats: DataFrame, keys: Iterable[str], spread_by: Iterable[str], how: str = "left", salts: int = 32
) -> DataFrame:
    """Join rows to a table with one row per key, spreading a hot key over ``salts`` tasks.

    The small side is copied per salt; the salt is a hash of row values, so a retried task routes its
    rows the same way. Where the small side fits a broadcast, Spark still chooses one.
    """
    keys = list(keys)
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    copies = stats.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "__salt"], how).drop("__salt")


def _bucket(seq: Sequence) -> Column:
    return F.coalesce(F.expr(seq.bucket).cast("bigint"), F.lit(-(2**63)))


def _asc(seq: Sequence) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in seq.order_by]


def _desc(seq: Sequence) -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in seq.order_by]


def _local(seq: Sequence, part: list[str], descending: bool = False) -> WindowSpec:
    return Window.partitionBy(*part).orderBy(*(_desc(seq) if descending else _asc(seq)))


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which a NULL key meets a NULL key, as it does in a window or a group."""
    named = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(named[f"__right_{k}"])
    return left.join(named, same, "left").drop(*[f"__right_{k}" for k in keys])


def running_sum(df: DataFrame, seq: Sequence, sums: dict[str, Column]) -> DataFrame:
    """Inclusive running sums along the sequence."""
    keys = list(seq.keys)
    if seq.bucket is None:
        w = _local(seq, keys).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({n: F.coalesce(F.sum(c).over(w), F.lit(0)) for n, c in sums.items()})
    tagged = df.withColumns({BUCKET: _bucket(seq), **{f"__in_{n}": c for n, c in sums.items()}})
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*keys, BUCKET)
        .agg(*[F.sum(f"__in_{n}").alias(f"__sum_{n}") for n in sums])
        .select(*keys, BUCKET, *[F.coalesce(F.sum(f"__sum_{n}").over(before), F.lit(0)).alias(f"__off_{n}") for n in sums])
    )
    w = _local(seq, [*keys, BUCKET]).rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.withColumns({f"__in_{n}": F.coalesce(F.sum(f"__in_{n}").over(w), F.lit(0)) for n in sums})
    joined = _join(local, offsets, [*keys, BUCKET])
    return joined.withColumns({n: F.col(f"__in_{n}") + F.col(f"__off_{n}") for n in sums}).drop(
        BUCKET, *[f"__in_{n}" for n in sums], *[f"__off_{n}" for n in sums]
    )


def with_position(df: DataFrame, seq: Sequence, name: str = POSITION) -> DataFrame:
    """Add the 0-based dense row position inside each sequence (BIGINT)."""
    if seq.position is not None:
        return df if seq.position == name else df.withColumn(name, F.col(seq.position).cast("bigint"))
    if seq.bucket is None:
        return df.withColumn(name, (F.row_number().over(_local(seq, list(seq.keys))) - 1).cast("bigint"))
    return running_sum(df, seq, {name: F.lit(1).cast("bigint")}).withColumn(name, F.col(name) - 1)


def carry(
    df: DataFrame,
    seq: Sequence,
    values: dict[str, Column],
    *,
    backward: bool = False,
    exclusive: bool = False,
) -> DataFrame:
    """Last non-null value at or before each row (or at or after it, when ``backward``).

    ``exclusive`` leaves the row itself out. The backward pass uses a descending running frame:
    a current-to-end frame would be quadratic.
    """
    keys, stop = list(seq.keys), -1 if exclusive else 0
    if seq.bucket is None:
        w = _local(seq, keys, backward).rowsBetween(Window.unboundedPreceding, stop)
        return df.withColumns({n: F.last(c, ignorenulls=True).over(w) for n, c in values.items()})
    tagged = df.withColumns({BUCKET: _bucket(seq), **{f"__in_{n}": c for n, c in values.items()}})
    pick = F.min_by if backward else F.max_by
    order = F.struct(*[F.col(c) for c in seq.order_by])
    present = F.lit(False)
    for n in values:
        present = present | F.col(f"__in_{n}").isNotNull()
    summary = (
        tagged.filter(present)
        .groupBy(*keys, BUCKET)
        .agg(*[pick(f"__in_{n}", F.when(F.col(f"__in_{n}").isNotNull(), order)).alias(f"__end_{n}") for n in values])
    )
    buckets = tagged.select(*keys, BUCKET).distinct()
    along = F.col(BUCKET).desc() if backward else F.col(BUCKET).asc()
    earlier = Window.partitionBy(*keys).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
    carried = _join(buckets, summary, [*keys, BUCKET]).select(
        *keys, BUCKET, *[F.last(f"__end_{n}", ignorenulls=True).over(earlier).alias(f"__from_{n}") for n in values]
    )
    w = _local(seq, [*keys, BUCKET], backward).rowsBetween(Window.unboundedPreceding, stop)
    local = tagged.withColumns({f"__in_{n}": F.last(f"__in_{n}", ignorenulls=True).over(w) for n in values})
    joined = _join(local, carried, [*keys, BUCKET])
    return joined.withColumns({n: F.coalesce(f"__in_{n}", f"__from_{n}") for n in values}).drop(
        BUCKET, *[f"__in_{n}" for n in values], *[f"__from_{n}" for n in values]
    )


class Frames:
    """Window specs for one ``framed`` stage; all share a partitioning, so one shuffle and one sort."""

    def __init__(self, seq: Sequence, part: list[str]):
        self.seq, self.part = seq, part
        self.order = _local(seq, part)
        self.asc = self.order.rowsBetween(Window.unboundedPreceding, 0)
        self.desc = _local(seq, part, descending=True).rowsBetween(Window.unboundedPreceding, 0)
        self.whole = Window.partitionBy(*part)

    def inside(self, column: str, descending: bool = False) -> WindowSpec:
        """From the start (or the end) of the rows that share ``column`` up to each row."""
        return _local(self.seq, [*self.part, column], descending).rowsBetween(Window.unboundedPreceding, 0)

    def rows(self, first: int, last: int) -> WindowSpec:
        return self.order.rowsBetween(first, last)


def framed(
    df: DataFrame,
    seq: Sequence,
    *stages: Callable[[Frames], dict[str, Column]],
    before: int = 0,
    after: int = 0,
) -> DataFrame:
    """Add window columns whose frames reach at most ``before`` rows back and ``after`` rows ahead.

    Each stage maps window specs to new columns and may use columns of earlier stages. The column
    ``__pos`` (row position) is available to stages and dropped at the end.
    """
    keep_position = seq.position == POSITION
    indexed = with_position(df, seq, POSITION)
    if seq.bucket is None:
        w = Frames(seq, list(seq.keys))
        for stage in stages:
            indexed = indexed.withColumns(stage(w))
        return indexed if keep_position else indexed.drop(POSITION)
    size = seq.segment_rows
    first = F.greatest(F.col(POSITION) - after, F.lit(0)) / size
    last = (F.col(POSITION) + before) / size
    spread = indexed.withColumn(
        SEGMENT, F.explode(F.sequence(F.floor(first).cast("bigint"), F.floor(last).cast("bigint")))
    ).withColumn(CORE, F.floor(F.col(POSITION) / size) == F.col(SEGMENT))
    w = Frames(seq, [*seq.keys, SEGMENT])
    for stage in stages:
        spread = spread.withColumns(stage(w))
    out = spread.filter(CORE).drop(SEGMENT, CORE)
    return out if keep_position else out.drop(POSITION)


def with_field(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    """The table's schema plus one field (a copy: ``StructType.add`` would change the original)."""
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def ordered_fold(
    df: DataFrame,
    keys: Iterable[str],
    order_by: Iterable[str],
    start: Callable[[], Any],
    step: Callable[[Any, pd.DataFrame], pd.DataFrame],
    schema: Any,
) -> DataFrame:
    """Stream each key's rows, in order, through ``step(state, rows)``.

    For recurrences only: rows arrive in Arrow batches, so memory is bounded by the batch and the
    state, whatever the length of the key. Parallelism comes from the number of keys, so callers
    key by chunks or independent episodes.
    """
    keys, order_by = list(keys), list(order_by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd  # only workers of recurrences pay for it

        current, state = None, None
        for rows in batches:
            if rows.empty:
                continue
            own, above = rows[keys], rows[keys].shift()
            changed = ((own != above) & ~(own.isna() & above.isna())).any(axis=1).to_numpy()
            changed[0] = True
            edges = [*changed.nonzero()[0].tolist(), len(rows)]
            parts = []
            for begin, end in zip(edges, edges[1:]):
                part = rows.iloc[begin:end]
                key = tuple(None if pd.isna(v) else v for v in part.iloc[0][keys])
                if key != current:
                    current, state = key, start()
                produced = step(state, part)
                if len(produced):
                    parts.append(produced)
            if parts:
                yield pd.concat(parts, ignore_index=True)

    arranged = df.repartition(*keys).sortWithinPartitions(*keys, *order_by)
    return arranged.mapInPandas(run, schema)
