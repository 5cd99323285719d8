"""Casts, arithmetic guards and per-row signal features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts read as true.
TRUE_TEXTS = ("true", "1", "yes", "y", "t")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)


def to_double(c: Column | str) -> Column:
    """Lenient numeric cast: junk, blanks and NaN become NULL."""
    return nan_to_null(col(c).try_cast("double"))


def is_finite(c: Column | str) -> Column:
    """True for ordinary numbers; false for NULL, NaN and infinities."""
    c = col(c).cast("double")
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def all_finite(*columns: Column | str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & is_finite(c)
    return out


def to_bool(c: Column | str) -> Column:
    """Lenient boolean; missing is false, and so is the text ``1.0``."""
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))).isin(*TRUE_TEXTS), F.lit(False))


def clip_low(c: Column | str, low: float = 0.0) -> Column:
    """Raise values below ``low`` to it; NULL stays NULL (``greatest`` would drop it)."""
    c = col(c)
    return F.when(c < low, F.lit(low)).otherwise(c)


def clip(c: Column | str, low: Column | float | None, high: Column | float | None) -> Column:
    c = col(c)
    out = c
    if high is not None:
        out = F.when(c > high, F.lit(high) if not isinstance(high, Column) else high).otherwise(out)
    if low is not None:
        out = F.when(c < low, F.lit(low) if not isinstance(low, Column) else low).otherwise(out)
    return out


def safe_div(a: Column | str, b: Column | str, eps: float = 1e-6) -> Column:
    """a / b, or 0 where the divisor is within ``eps`` of zero or the result is not finite."""
    a, b = col(a), col(b)
    q = F.when(F.abs(b) > eps, a / b)
    return F.when(is_finite(q), q).otherwise(F.lit(0.0))


def scale_by_max(c: Column | str, maximum: Column | str) -> Column:
    """Clip at 0 and divide by a maximum into [0, 1]; max <= 0 gives 0, no max leaves the clipped value."""
    low, m = clip_low(c), col(maximum)
    return (
        F.when(m.isNull(), low)
        .when(low.isNull(), F.lit(None).cast("double"))
        .when(m <= 0, F.lit(0.0))
        .otherwise(clip(low / m, 0.0, 1.0))
    )


def transform_target(c: Column | str, kind: str) -> Column:
    c = col(c)
    if kind == "log1p":
        return F.log1p(clip_low(c))
    if kind in ("none", ""):
        return c
    raise ValueError(f"unknown target transform: {kind}")


def inverse_transform_target(c: Column | str, kind: str) -> Column:
    c = col(c)
    if kind == "log1p":
        return F.expm1(c)
    if kind in ("none", ""):
        return c
    raise ValueError(f"unknown target transform: {kind}")


def inverse_of_target(values: np.ndarray, kind: str) -> np.ndarray:
    """``inverse_transform_target`` of numbers in a task."""
    if kind == "log1p":
        return np.expm1(values)
    if kind in ("none", ""):
        return values
    raise ValueError(f"unknown target transform: {kind}")


def reconstruct(output: Column | str, previous: Column | str, mode: str, low: float, high: float) -> Column:
    """Turn a model output into a bounded prediction: added to the previous value when ``delta``."""
    if mode not in ("delta", "absolute"):
        raise ValueError("mode must be 'delta' or 'absolute'")
    raw = col(previous) + col(output) if mode == "delta" else col(output)
    return clip(raw, low, high)


def point_x(c: Column | str) -> Column:
    """x of an ``struct<x,y>`` point; NULL unless both coordinates are present."""
    c = col(c)
    return F.when(c.getField("y").isNotNull(), c.getField("x"))


def point_y(c: Column | str) -> Column:
    c = col(c)
    return F.when(c.getField("x").isNotNull(), c.getField("y"))


def blob_present(blobs: Column | str) -> Column:
    """True if any blob in the list has a diameter."""
    return F.coalesce(F.exists(col(blobs), lambda b: b["diameter_px"].isNotNull()), F.lit(False))


def blob_max_diameter(blobs: Column | str) -> Column:
    return F.array_max(F.transform(col(blobs), lambda b: b["diameter_px"]))


def blob_active_count(blobs: Column | str) -> Column:
    """Blobs whose area (diameter when it has none) is positive."""
    active = F.filter(col(blobs), lambda b: F.coalesce(b["area"], b["diameter_px"], F.lit(0.0)) > 0)
    return F.coalesce(F.size(active), F.lit(0))


def blob_total_area(blobs: Column | str) -> Column:
    areas = F.transform(col(blobs), lambda b: F.coalesce(b["area"], F.lit(0.0)))
    return F.coalesce(F.aggregate(areas, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))


def json_safe(columns: list[tuple[str, Column]]) -> Column:
    """JSON text of named values; non-finite numbers are written as null."""
    safe = [F.when(is_finite(c), c.cast("double")).alias(n) for n, c in columns]
    return F.to_json(F.struct(*safe), {"ignoreNullFields": "false"})
