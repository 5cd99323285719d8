"""Rule-based anomaly flags and scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalars import blob_active_count, blob_total_area
from strandline.sequence import POSITION, Frames, Sequence, framed, join_stats


@dataclass(frozen=True)
class AnomalyRules:
    """Rule thresholds and weights."""

    window: int = 30
    jump_fraction: float = 0.20
    jump_min_periods: int = 5
    min_score: float = 1.0
    missing_weight: float = 1.0
    jump_weight: float = 1.0
    transient_weight: float = 2.0
    transient_max_len: int = 2
    use_transient: bool = False


def jump_column(w: Frames, c: str, window: int, fraction: float, min_periods: int) -> Column:
    past = w.rows(-window, -1)
    mean = F.when(F.count(c).over(past) >= min_periods, F.avg(c).over(past))
    return F.coalesce(F.abs(F.col(c) - mean) / (F.abs(mean) + 1e-9) > fraction, F.lit(False))


def jump_flags(
    df: DataFrame, seq: Sequence, c: str, window: int = 30, fraction: float = 0.20, min_periods: int = 5, out: str = "jump"
) -> DataFrame:
    """True where a value departs from the mean of the previous ``window`` rows by more than ``fraction``."""
    return framed(df, seq, lambda w: {out: jump_column(w, c, window, fraction, min_periods)}, before=window)


def _transient_stages(present: Column, tag: str, window: int, max_len: int, out: str):
    on = f"__on{tag}"
    return (
        lambda w: {on: F.coalesce(present, F.lit(False))},
        lambda w: {
            f"__lp{tag}": F.last(F.when(F.col(on), F.col(POSITION)), ignorenulls=True).over(w.asc),
            f"__np{tag}": F.last(F.when(F.col(on), F.col(POSITION)), ignorenulls=True).over(w.desc),
            f"__lo{tag}": F.min(POSITION).over(w.asc),
            f"__hi{tag}": F.max(POSITION).over(w.desc),
        },
        lambda w: {
            f"__l{tag}": F.last(
                F.when(~F.col(on), F.struct(F.col(POSITION).alias("p"), F.col(f"__lp{tag}").alias("seen"))), ignorenulls=True
            ).over(w.asc),
            f"__r{tag}": F.last(
                F.when(~F.col(on), F.struct(F.col(POSITION).alias("p"), F.col(f"__np{tag}").alias("seen"))), ignorenulls=True
            ).over(w.desc),
        },
        lambda w: {out: _isolated(tag, on, window, max_len)},
    )


def _isolated(tag: str, on: str, window: int, max_len: int) -> Column:
    left, right = F.col(f"__l{tag}"), F.col(f"__r{tag}")
    start = F.coalesce(left["p"] + 1, F.col(f"__lo{tag}"))
    end = F.coalesce(right["p"] - 1, F.col(f"__hi{tag}"))
    near_left = F.coalesce(left["seen"] >= start - window, F.lit(False))
    near_right = F.coalesce(right["seen"] <= end + window, F.lit(False))
    return F.col(on) & (end - start + 1 <= max_len) & ~near_left & ~near_right


def transient_flags(
    df: DataFrame, seq: Sequence, present: Column, window: int = 30, max_len: int = 2, out: str = "transient"
) -> DataFrame:
    """True on presence runs of at most ``max_len`` rows with no presence within ``window`` rows either side."""
    reach = window + max_len + 2
    done = framed(df, seq, *_transient_stages(present, "", window, max_len, out), before=reach, after=reach)
    return done.drop("__on", "__lp", "__np", "__lo", "__hi", "__l", "__r")


def presence_features(df: DataFrame, blobs: dict[str, str]) -> DataFrame:
    """Active count and total area per blob list (kind -> array column)."""
    out = {}
    for kind, c in blobs.items():
        out[f"active_{kind}_count"] = blob_active_count(c)
        out[f"active_{kind}_total_area"] = blob_total_area(c)
    return df.withColumns(out)


def all_null_columns(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """One boolean per column: true where it has no value (one pass over all columns)."""
    aggs = [(F.count(c) == 0).alias(c) for c in columns]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def anomaly_score(
    df: DataFrame,
    seq: Sequence,
    critical: list[str],
    rules: AnomalyRules = AnomalyRules(),
    transient: dict[str, Column] | None = None,
) -> DataFrame:
    """Weighted rule score, 0/1 flag and sorted distinct reasons, for every sequence at once.

    A critical column absent from a whole sequence is ignored there.
    """
    transient = (transient or {}) if rules.use_transient else {}
    known = all_null_columns(df, critical, seq.keys).withColumnsRenamed({c: f"__void_{c}" for c in critical})
    base = join_stats(df, known, seq.keys, seq.order_by)

    stages = [
        lambda w: {
            f"__jump_{c}": jump_column(w, c, rules.window, rules.jump_fraction, rules.jump_min_periods) for c in critical
        }
    ]
    helpers = []
    for k, (name, present) in enumerate(transient.items()):
        stages += _transient_stages(present, f"_t{k}", rules.window, rules.transient_max_len, f"__transient_{name}")
        helpers += [f"__{p}_t{k}" for p in ("on", "lp", "np", "lo", "hi", "l", "r")]
    reach = rules.window + rules.transient_max_len + 2 if transient else rules.window
    seen = framed(base, seq, *stages, before=reach, after=reach if transient else 0)

    hits: list[tuple[str, Column, float]] = []
    for c in critical:
        usable = ~F.col(f"__void_{c}")
        hits.append((f"missing:{c}", usable & F.col(c).isNull(), rules.missing_weight))
        hits.append((f"jump:{c}", usable & F.col(f"__jump_{c}"), rules.jump_weight))
    for name in transient:
        hits.append((f"transient:{name}", F.col(f"__transient_{name}"), rules.transient_weight))

    score = F.lit(0.0)
    for _, hit, weight in hits:
        score = score + F.when(hit, F.lit(weight)).otherwise(F.lit(0.0))
    reasons = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(h, F.lit(n)) for n, h, _ in hits]))))
    scored = seen.withColumns({"anomaly_score": score, "anomaly_reasons": reasons}).withColumn(
        "anomaly", (F.col("anomaly_score") >= rules.min_score).cast("int")
    )
    return scored.drop(
        *[f"__void_{c}" for c in critical], *[f"__jump_{c}" for c in critical], *[f"__transient_{n}" for n in transient], *helpers
    )


def anomaly_summary(df: DataFrame, keys: tuple[str, ...], flag: str = "anomaly", recheck_above: float = 0.10) -> DataFrame:
    """Flagged, total, ratio, and whether a recheck is due."""
    ratio = F.col("flagged") / F.col("total")
    return (
        df.groupBy(*keys)
        .agg(F.count_if(F.col(flag) == 1).alias("flagged"), F.count("*").alias("total"))
        .withColumns({"ratio": ratio, "recheck": ratio > recheck_above})
    )


def frames_covered(df: DataFrame, keys: tuple[str, ...], frame: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_distinct(frame).alias("frames_covered"))
