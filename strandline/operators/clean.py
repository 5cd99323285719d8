"""Projection and filter operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.scalars import all_finite, clip_low, is_finite, safe_div, scale_by_max, to_double
from strandline.sequence import Sequence, framed, join_stats, with_position


def one_row(stats: DataFrame) -> Column:
    """A one-row aggregate as a scalar subquery: evaluated once, no join."""
    return stats.select(F.struct("*")).scalar()


def pick_column(df: DataFrame, names: list[str], required: bool = True) -> str | None:
    """First of ``names`` that the table has."""
    for name in names:
        if name in df.columns:
            return name
    if required:
        raise KeyError(f"none of the columns {names} is present")
    return None


def transform_columns(df: DataFrame, columns: list[str], fn: Callable[[Column], Column]) -> DataFrame:
    """Apply a column function to the listed columns that exist."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: fn(F.col(c)) for c in present})


def rebase(df: DataFrame, keys: list[str], c: str, first: int = 1) -> DataFrame:
    """Renumber so that each key's smallest value is ``first``. An aggregate and a join: no per-key window."""
    low = df.groupBy(*keys).agg(F.min(c).alias("__low"))
    return join_stats(df, low, keys, [c]).withColumn(c, F.col(c) - F.col("__low") + first).drop("__low")


def derive_distances(
    df: DataFrame,
    spec: dict[str, tuple[Column, Column]],
    gates: dict[str, Column] | None = None,
) -> DataFrame:
    """Absolute differences ``|a - b|``; a gated one is missing unless its condition holds."""
    gates = gates or {}
    out = {}
    for name, (a, b) in spec.items():
        distance = F.abs(a - b)
        out[name] = F.when(gates[name], distance) if name in gates else distance
    return df.withColumns(out)


def mask_where(df: DataFrame, flag: str, columns: list[str]) -> DataFrame:
    """Set columns to missing where ``flag`` = 1."""
    return transform_columns(df, columns, lambda c: F.when(F.coalesce(F.col(flag), F.lit(0)) != 1, c))


def scale_cols(df: DataFrame, columns: list[str], factor: str, rename: dict[str, str] | None = None) -> DataFrame:
    out = df.withColumns({c: F.col(c) * F.col(factor) for c in columns})
    return out.withColumnsRenamed(rename or {})


def column_maxima(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row of dataset-wide maxima of the clipped columns; an all-missing column stays NULL."""
    return df.agg(*[F.max(clip_low(c)).alias(f"max_{c}") for c in columns])


def normalize_by_max(df: DataFrame, maxima: DataFrame, columns: list[str]) -> DataFrame:
    """Scale columns into [0, 1] by a one-row table of maxima."""
    row = one_row(maxima)
    return df.withColumns({c: scale_by_max(c, row[f"max_{c}"]) for c in columns})


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Final projection: fixed order and types; absent columns are NULL."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def expand_powers(df: DataFrame, columns: list[str], degree: int, start: int = 0) -> DataFrame:
    """Add powers 2..degree of ``columns[start:]`` as ``name^p``; no cross terms."""
    if not 0 <= start <= len(columns):
        raise ValueError("start must index the columns")
    return df.withColumns({f"{c}^{p}": F.pow(c, F.lit(float(p))) for p in range(2, degree + 1) for c in columns[start:]})


def moments(df: DataFrame, columns: list[str], eps: float = 1e-12) -> DataFrame:
    """One row of means and population scales; a scale within ``eps`` of zero counts as 1."""
    aggs = []
    for c in columns:
        s = F.stddev_pop(c)
        aggs += [F.avg(c).alias(f"mean_{c}"), F.when(s > eps, s).otherwise(F.lit(1.0)).alias(f"scale_{c}")]
    return df.agg(*aggs)


def standardize(df: DataFrame, columns: list[str], stats: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population std; pass the training rows' ``moments`` to transform other rows."""
    row = one_row(stats if stats is not None else moments(df, columns))
    return df.withColumns({c: (F.col(c) - row[f"mean_{c}"]) / row[f"scale_{c}"] for c in columns})


def minmax(df: DataFrame, columns: list[str], joint: bool = False) -> DataFrame:
    """Scale to [0, 1] per column, or over all columns together; zero range gives 0."""
    lows, highs = [F.min(c) for c in columns], [F.max(c) for c in columns]
    if joint and len(columns) > 1:
        lows, highs = [F.least(*lows)] * len(columns), [F.greatest(*highs)] * len(columns)
    row = one_row(
        df.agg(*[v.alias(f"{k}_{c}") for k, vs in (("lo", lows), ("hi", highs)) for c, v in zip(columns, vs)])
    )

    def scaled(c: str) -> Column:
        low, span = row[f"lo_{c}"], row[f"hi_{c}"] - row[f"lo_{c}"]
        value = F.when(span == 0, F.lit(0.0)).otherwise((F.col(c) - low) / span)
        return F.when(F.col(c).isNotNull(), value)

    return df.withColumns({c: scaled(c) for c in columns})


def elapsed(df: DataFrame, seq: Sequence, candidates: list[str], out: str = "elapsed") -> DataFrame:
    """Time since the first finite value of the first available time column, else the row position.

    The first value per sequence is an aggregate joined back, not a window over the whole key.
    """
    c = pick_column(df, candidates, required=False)
    if c is None:
        return with_position(df, seq, out).withColumn(out, F.col(out).cast("double"))
    order = F.struct(*seq.order_by)
    value = F.when(is_finite(c), F.col(c).cast("double"))
    first = (
        df.filter(is_finite(c)).groupBy(*seq.keys).agg(F.min_by(F.col(c).cast("double"), order).alias("__first"))
    )
    joined = join_stats(df, first, seq.keys, seq.order_by)
    return joined.withColumn(out, value - F.col("__first")).drop("__first")


def physics_features(
    df: DataFrame,
    seq: Sequence,
    current: str,
    voltage: str,
    feed: str | None = None,
    *,
    eps: float = 1e-6,
    active_current: float = 5.0,
    active_voltage: float = 1.0,
) -> DataFrame:
    """Product, ratios, per-feed ratios, an activity flag and absolute one-step deltas."""
    i, u = F.col(current), F.col(voltage)
    power = i * u
    out = {
        "active": F.coalesce((i > active_current) | (u > active_voltage), F.lit(False)).cast("double"),
        "product": power,
        "current_to_voltage": safe_div(i, u, eps),
        "voltage_to_current": safe_div(u, i, eps),
    }
    if feed is not None:
        f = F.col(feed)
        out.update(
            {
                "current_per_feed": safe_div(i, f, eps),
                "voltage_per_feed": safe_div(u, f, eps),
                "product_per_feed": safe_div(power, f, eps),
                "feed_to_current": safe_div(f, i, eps),
            }
        )
    return framed(
        df.withColumns(out),
        seq,
        lambda w: {
            "current_abs_delta": F.abs(i - F.lag(i).over(w.order)),
            "voltage_abs_delta": F.abs(u - F.lag(u).over(w.order)),
            "product_abs_delta": F.abs(F.col("product") - F.lag("product").over(w.order)),
        },
        before=1,
    )


def static_context(df: DataFrame, c: str, values: tuple[str, ...]) -> DataFrame:
    """One 0/1 column per category: ``<c>_is_<value>``."""
    return df.withColumns({f"{c}_is_{v}": F.coalesce(F.col(c) == v, F.lit(False)).cast("double") for v in values})


def require_key(df: DataFrame, c: str, kind: str = "bigint") -> DataFrame:
    """Drop rows whose key is missing or not numeric; cast the rest."""
    return df.withColumn(c, to_double(c)).filter(F.col(c).isNotNull()).withColumn(c, F.col(c).try_cast(kind))


def frame_events(df: DataFrame, counter: str, t: str) -> DataFrame:
    """Rows whose counter is a whole number and whose time is present."""
    c = to_double(counter)
    return df.filter((c % 1 == 0) & to_double(t).isNotNull())


def measurement_rows(df: DataFrame, t1: str, t2: str, out: str = "meas_time") -> DataFrame:
    """Rows on which either channel has a time; the first channel's time is preferred."""
    t = F.coalesce(to_double(t1), to_double(t2))
    return df.withColumn(out, t).filter(F.col(out).isNotNull())


def require_columns(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def require_values(df: DataFrame, inputs: list[str], target: str, allow_missing_target: bool = False) -> DataFrame:
    """Required columns must exist and hold numbers; the target may be missing if allowed."""
    require_columns(df, [*inputs, target])
    cast = df.withColumns({c: to_double(c) for c in dict.fromkeys([*inputs, target])})
    return cast.dropna(subset=inputs if allow_missing_target else [*inputs, target])


def filter_condition(
    df: DataFrame, settings: DataFrame, keys: list[str], machine: str | None = None, tolerance: float = 1e-9, **wanted: float
) -> DataFrame:
    """Keep sequences of one machine whose settings lie within ``tolerance`` of the wanted ones.

    ``settings`` has one row per sequence; a missing setting never matches.
    """
    keep = settings
    if machine is not None:
        keep = keep.filter(F.col("machine_group") == machine.lower())
    for c, v in wanted.items():
        keep = keep.filter(F.abs(F.col(c) - F.lit(float(v))) <= tolerance)
    return df.join(keep.select(*keys).distinct(), keys, "left_semi")


def finite_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.filter(all_finite(*columns))


def min_length(df: DataFrame, keys: list[str], n: int, spread_by: list[str] | None = None) -> DataFrame:
    """Drop sequences with at most ``n`` rows: map-side-combined counts and a salted semi-join."""
    long_enough = df.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > n)
    return join_stats(df, long_enough.select(*keys), keys, spread_by or df.columns, "left_semi")


def where_eq(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Equality row filter."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in values.items()], F.lit(True)))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Fail early on an empty table (one short job)."""
    if df.isEmpty():
        raise ValueError(f"no rows left: {what}")
    return df


def slice_rows(df: DataFrame, seq: Sequence, start: int | None, end: int | None) -> DataFrame:
    """Rows at positions [start, end) of each sequence."""
    indexed = with_position(df, seq, "__at")
    keep = F.col("__at") >= (start or 0)
    if end is not None:
        keep = keep & (F.col("__at") < end)
    return indexed.filter(keep).drop("__at")


def load_pairs(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """Finite (truth, prediction) pairs."""
    return df.select(to_double(truth).alias("y_true"), to_double(prediction).alias("y_pred")).filter(
        all_finite("y_true", "y_pred")
    )


def order_columns(df: DataFrame, candidates: list[str], tie_break: str = "pos") -> tuple[str, ...]:
    """Sequence order: the first available candidate, ties broken by source position."""
    c = pick_column(df, candidates, required=False)
    return tuple(x for x in (c, tie_break) if x is not None)
