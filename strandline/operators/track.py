"""Multi-object tracking across frames, and measures over tracks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.sequence import Sequence, framed, running_sum, with_field, with_position


@dataclass(frozen=True)
class TrackRules:
    """Matching, confirmation and filter settings of one object type."""

    radius: float = 20.0
    max_missed: int = 3
    min_hits: int = 2
    min_displacement: float = 5.0
    min_vertical: float = 3.0
    process_noise: float = 0.03
    measurement_noise: float = 0.5
    initial_variance: float = 0.0


# Settings per object type.
DROPLET_RULES = TrackRules(20.0, 3, 2, 6.0, 4.0)
SPATTER_RULES = TrackRules(18.0, 2, 2, 3.0, 1.0)

@dataclass(slots=True)
class Track:
    """One object: filter state, first position and counters.

    The motion and noise of the constant-velocity filter are alike on both axes and do not mix them,
    so each axis has its own (position, velocity) and both share one 2 x 2 covariance
    [[pp, pv], [pv, vv]].
    """

    id: int
    x: float
    y: float
    vx: float
    vy: float
    pp: float
    pv: float
    vv: float
    first_x: int
    first_y: int
    hits: int = 1
    missed: int = 0
    confirmed: bool = False


@dataclass
class TrackerState:
    """Everything one key carries from frame to frame: its live tracks and the next id."""

    tracks: list[Track] = field(default_factory=list)
    next_id: int = 0
    frame: int | None = None


def _predict(t: Track, noise: float) -> None:
    t.x += t.vx
    t.y += t.vy
    t.pp += 2 * t.pv + t.vv + noise
    t.pv += t.vv
    t.vv += noise


def _correct(t: Track, x: float, y: float, noise: float) -> None:
    total = t.pp + noise
    gain_p, gain_v = t.pp / total, t.pv / total
    dx, dy = x - t.x, y - t.y
    t.x, t.vx = t.x + gain_p * dx, t.vx + gain_v * dx
    t.y, t.vy = t.y + gain_p * dy, t.vy + gain_v * dy
    t.vv -= gain_v * t.pv
    t.pp, t.pv = t.pp * (1 - gain_p), t.pv * (1 - gain_p)


def coast(state: TrackerState, frames: int, rules: TrackRules) -> None:
    """Advance over frames without detections: predictions move on, misses add up, stale tracks end."""
    for _ in range(min(frames, rules.max_missed + 1)):
        if not state.tracks:
            return
        for track in state.tracks:
            _predict(track, rules.process_noise)
            track.missed += 1
        state.tracks = [t for t in state.tracks if t.missed <= rules.max_missed]


def _near(tracks: list[Track], xs: list[float], ys: list[float], radius: float) -> list[tuple[float, int, int]]:
    """(distance, track, detection) within the radius, nearest first.

    Tracks lie in square cells of the radius, so a detection looks at nine cells: the work grows with the pairs that are near.
    """
    if not tracks or not xs:
        return []
    cell = max(radius, 1e-9)
    homes: dict[tuple[int, int], list[int]] = {}
    for i, t in enumerate(tracks):
        if math.isfinite(t.x) and math.isfinite(t.y):  # an object without coordinates is near nothing
            homes.setdefault((math.floor(t.x / cell), math.floor(t.y / cell)), []).append(i)
    near = []
    for j, (x, y) in enumerate(zip(xs, ys)):
        if not (math.isfinite(x) and math.isfinite(y)):
            continue
        cx, cy = math.floor(x / cell), math.floor(y / cell)
        for a in (cx - 1, cx, cx + 1):
            for b in (cy - 1, cy, cy + 1):
                for i in homes.get((a, b), ()):
                    d = math.hypot(x - tracks[i].x, y - tracks[i].y)
                    if d <= radius:
                        near.append((d, i, j))
    near.sort()
    return near


def advance(state: TrackerState, xs: list[float], ys: list[float], rules: TrackRules) -> list[tuple[int, int]]:
    """One frame: match detections to predictions, nearest first; returns confirmed (detection, track id)."""
    tracks = state.tracks
    for track in tracks:
        _predict(track, rules.process_noise)
        track.missed += 1
    used_tracks: set[int] = set()
    used: set[int] = set()
    out = []
    for _, i, j in _near(tracks, xs, ys, rules.radius):
        if i in used_tracks or j in used:
            continue
        used_tracks.add(i)
        used.add(j)
        track = tracks[i]
        _correct(track, xs[j], ys[j], rules.measurement_noise)
        track.missed, track.hits = 0, track.hits + 1
        if not track.confirmed:
            dx, dy = xs[j] - track.first_x, ys[j] - track.first_y
            track.confirmed = (
                track.hits >= rules.min_hits and math.hypot(dx, dy) >= rules.min_displacement and dy >= rules.min_vertical
            )
        if track.confirmed:
            out.append((j, track.id))
    live = [t for t in tracks if t.missed <= rules.max_missed]
    spread = rules.initial_variance
    for j, (x, y) in enumerate(zip(xs, ys)):
        if j not in used:
            live.append(Track(state.next_id, x, y, 0.0, 0.0, spread, 0.0, spread, int(x), int(y)))
            state.next_id += 1
    state.tracks = live
    return out


def step_frame(state: TrackerState, frame: int, xs: list[float], ys: list[float], rules: TrackRules) -> list[tuple[int, int]]:
    """Coast over the empty frames since the last one, then advance. Shared by batch and stream."""
    if state.frame is not None:
        coast(state, frame - state.frame - 1, rules)
    state.frame = frame
    return advance(state, xs, ys, rules)


def episodes(df: DataFrame, seq: Sequence, frame: str, max_missed: int, out: str = "episode", ends=None) -> DataFrame:
    """Number the independent stretches of each key.

    After more than ``max_missed`` frames without detections every track has ended, so what follows
    depends on nothing before: an exact cut that lets one busy source run as many tasks. ``ends`` adds window columns of the same stage.
    """
    gap = framed(df, seq, lambda w: {"__step": F.col(frame) - F.lag(frame).over(w.order), **(ends(w) if ends else {})}, before=1, after=1 if ends else 0)
    cut = F.when(F.col("__step") > max_missed + 1, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    return running_sum(gap, seq, {out: cut}).drop("__step")


def _key(rows: pd.DataFrame, at: int) -> tuple:
    return tuple(None if pd.isna(v) else v for v in rows.iloc[at])


def track_objects(
    df: DataFrame,
    keys: tuple[str, ...],
    frame: str,
    x: str,
    y: str,
    detection: str,
    rules: TrackRules,
    bucket: str | None,
    passthrough: tuple[str, ...] = (),
    tick: str | None = None,
) -> DataFrame:
    """Confirmed track points: keys, frame, detection, x, y, ``track_key`` (unique per key).

    ``detection`` orders detections within a frame. Tracks run per (key, episode), streamed frame by
    frame: state is the live tracks only, so memory does not grow with the source.

    A frame number without rows is a frame without detections: tracks coast over it. Where some
    frames could not be read at all, pass ``tick``, the frame's rank among the readable ones:
    unreadable frames then advance the frame number but not the tracker.
    """
    tick = tick or frame
    seq = Sequence(keys, (frame, detection), bucket)
    columns = list(dict.fromkeys([*keys, frame, tick, detection, x, y, *passthrough]))
    # A frame may straddle two Arrow batches, so its last row is marked and the frame is processed once that has been seen.
    last = lambda w: {"__last": ~F.col(frame).eqNullSafe(F.lead(frame).over(w.order))}
    rows = episodes(df.select(*columns), seq, tick, rules.max_missed, ends=last)
    rows = rows.withColumns({x: F.col(x).cast("int"), y: F.col(y).cast("int")})

    group = [*keys, "episode"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """All episodes of a batch in one pass over its frames: an episode costs no table operations of its own."""
        tracker, held, previous = TrackerState(), None, None
        for part in parts:
            if part.empty:
                continue
            part = part if held is None else pd.concat([held, part], ignore_index=True)
            own, above = part[group], part[group].shift()
            fresh = ((own != above) & ~(own.isna() & above.isna())).any(axis=1).to_numpy()
            fresh[0] = _key(own, 0) != previous
            begins, hits, ids = fresh.tolist(), [], []
            frames, stops = part[tick].tolist(), (np.flatnonzero(part["__last"].to_numpy(dtype=bool)) + 1).tolist()
            xs, ys, at = part[x].astype(float).tolist(), part[y].astype(float).tolist(), 0
            for end in stops:
                if begins[at]:
                    tracker = TrackerState()
                for d, track in step_frame(tracker, frames[at], xs[at:end], ys[at:end], rules):
                    hits.append(at + d)
                    ids.append(track)
                at = end
            previous = _key(own, at - 1) if at else previous
            held = part.iloc[at:] if at < len(part) else None
            if hits:
                yield part.iloc[hits].drop(columns="__last").assign(track_in_episode=np.asarray(ids, dtype=np.int64))

    schema = with_field(rows.drop("__last"), "track_in_episode", T.LongType())
    arranged = rows.select(*[c for c in rows.columns if c != "__last"], "__last").repartition(*group).sortWithinPartitions(*group, frame, detection)
    done = arranged.mapInPandas(run, schema)
    return done.withColumn("track_key", F.struct("episode", F.col("track_in_episode").alias("n"))).drop(
        "episode", "track_in_episode"
    )


def compact_ids(df: DataFrame, keys: tuple[str, ...], track: str, order_by: list[str], out: str = "track_id") -> DataFrame:
    """Ids 0, 1, ... per key in order of first appearance.

    First appearances are an aggregate, and their numbering is the sequence position, in buckets of
    the first order column, so a key with very many tracks is numbered by many tasks.
    """
    first = df.groupBy(*keys, track).agg(F.min(F.struct(*order_by, track)).alias("__first"))
    flat = first.select(*keys, track, *[F.col(f"__first.{c}").alias(f"__o{k}") for k, c in enumerate(order_by)])
    seq = Sequence(keys, (*[f"__o{k}" for k in range(len(order_by))], track), "floor(__o0 / 100000)")
    ids = with_position(flat, seq, "__id").select(*keys, track, F.col("__id").cast("int").alias(out))
    renamed = df.drop(out) if out in df.columns and out != track else df
    return renamed.join(ids.withColumnRenamed(out, "__new"), [*keys, track], "left").withColumn(out, F.col("__new")).drop("__new")


def displacement(df: DataFrame, keys: tuple[str, ...], frame: str, x: str, y: str) -> DataFrame:
    """First-to-last displacement per track: Euclidean and signed vertical."""
    point = F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ends = df.groupBy(*keys).agg(F.min_by(point, frame).alias("a"), F.max_by(point, frame).alias("b"), F.count("*").alias("n_points"))
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    return ends.withColumns({"total_displacement": F.hypot(dx, dy), "vertical_displacement": dy}).drop("a", "b")


def track_speed(df: DataFrame, seq: Sequence, frame: str, x: str, y: str) -> DataFrame:
    """Pixels per frame since the track's previous point; rows without a positive frame step are dropped."""

    def stage(w) -> dict[str, Column]:
        before = {c: F.lag(c).over(w.order) for c in (frame, x, y)}
        step = F.col(frame) - before[frame]
        return {"speed": F.when(step > 0, F.hypot(F.col(x) - before[x], F.col(y) - before[y]) / step)}

    return framed(df, seq, stage, before=1).filter(F.col("speed").isNotNull())


def classify_blobs(
    df: DataFrame, x: str, y: str, radius: str, box: dict[str, Column], center_tolerance: float, min_droplet_area: float = 500.0
) -> DataFrame:
    """Droplet or spatter by region and size; blobs in neither region are dropped.

    box: x_min, x_max, y_min, y_max and center_y_max (defaults to y_max) of the search box. Centre and
    area >= ``min_droplet_area`` is a droplet, centre and smaller or outside the box sideways spatter.
    """
    middle = F.floor((box["x_min"] + box["x_max"]) / 2)
    bottom = box.get("center_y_max", box["y_max"])
    r = F.floor(F.col(radius))
    area = F.lit(math.pi) * r * r
    central = F.col(x).between(middle - center_tolerance, middle + center_tolerance) & F.col(y).between(box["y_min"], bottom)
    outer = (F.col(x) <= box["x_min"]) | (F.col(x) >= box["x_max"])
    kind = F.when(central & (area >= min_droplet_area), "droplet").when(central | outer, "spatter")
    inside = df.filter(F.col(y).between(box["y_min"], box["y_max"]))
    return inside.withColumns(
        {"area": area, "diameter_px": (2 * F.floor(F.sqrt(area / math.pi))).cast("double"), "feature_type": kind}
    ).filter(F.col("feature_type").isNotNull())
