"""Repair of short flagged runs and short gaps in sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalars import to_double
from strandline.sequence import POSITION, Frames, Sequence, framed


def _run_edges(w: Frames, flagged: Column, columns: list[str], tag: str) -> dict[str, Column]:
    """Nearest unflagged rows on both sides of each row, and the visible ends of the segment."""
    clear = F.when(~flagged, F.struct(F.col(POSITION).alias("p"), *[F.col(c) for c in columns]))
    return {
        f"__prev{tag}": F.last(clear, ignorenulls=True).over(w.asc),
        f"__next{tag}": F.last(clear, ignorenulls=True).over(w.desc),
        f"__first{tag}": F.min(POSITION).over(w.asc),
        f"__last{tag}": F.max(POSITION).over(w.desc),
    }


def _run_length(tag: str) -> Column:
    left = F.coalesce(F.col(f"__prev{tag}.p"), F.col(f"__first{tag}") - 1)
    right = F.coalesce(F.col(f"__next{tag}.p"), F.col(f"__last{tag}") + 1)
    return right - left - 1


def _line(tag: str, c: str) -> Column:
    a, b = F.col(f"__prev{tag}"), F.col(f"__next{tag}")
    return a[c] + (b[c] - a[c]) / (b["p"] - a["p"]) * (F.col(POSITION) - a["p"])


def repair_runs(df: DataFrame, seq: Sequence, flag: str, columns: list[str], max_len: int) -> DataFrame:
    """Replace flagged runs of at most ``max_len`` rows by a straight line between the adjacent rows.

    A short run a column cannot be repaired in becomes missing there; longer runs are untouched.
    The flag is cleared on runs repaired in at least one column. Runs reach at most ``max_len`` rows,
    so a halo of ``max_len + 1`` rows decides every row exactly.
    """
    columns = [c for c in columns if c in df.columns]
    base = df.withColumns({**{c: to_double(c) for c in columns}, flag: F.coalesce(to_double(flag).cast("int"), F.lit(0))})
    flagged = F.col(flag) != 0

    def decide(w: Frames) -> dict[str, Column]:
        short = flagged & (_run_length("") <= max_len)
        fixed = {f"__fix_{c}": F.when(short, _line("", c)) for c in columns}
        return {"__short": short, **fixed}

    def replace(w: Frames) -> dict[str, Column]:
        repaired = F.coalesce(*[F.col(f"__fix_{c}") for c in columns]).isNotNull()
        out = {c: F.when(F.col("__short"), F.col(f"__fix_{c}")).otherwise(F.col(c)) for c in columns}
        return {**out, flag: F.when(F.col("__short") & repaired, F.lit(0)).otherwise(F.col(flag))}

    out = framed(
        base, seq, lambda w: _run_edges(w, flagged, columns, ""), decide, replace, before=max_len + 1, after=max_len + 1
    )
    return out.drop("__prev", "__next", "__first", "__last", "__short", *[f"__fix_{c}" for c in columns])


def repair_gaps(df: DataFrame, seq: Sequence, columns: list[str], max_len: int) -> DataFrame:
    """Fill runs of at most ``max_len`` missing values, per column; runs at either end stay missing."""
    columns = [c for c in columns if c in df.columns]
    base = df.withColumns({c: to_double(c) for c in columns})

    def edges(w: Frames) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for k, c in enumerate(columns):
            out.update(_run_edges(w, F.col(c).isNull(), [c], str(k)))
        return out

    def fill(w: Frames) -> dict[str, Column]:
        return {
            c: F.when(F.col(c).isNull() & (_run_length(str(k)) <= max_len), _line(str(k), c)).otherwise(F.col(c))
            for k, c in enumerate(columns)
        }

    out = framed(base, seq, edges, fill, before=max_len + 1, after=max_len + 1)
    return out.drop(*[f"__{part}{k}" for k in range(len(columns)) for part in ("prev", "next", "first", "last")])
