"""Multi-output jobs."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.names import frame_number
from strandline.functions.scalars import clip_low, to_bool
from strandline.operators import align, anomaly, clean, track
from strandline.operators.repair import repair_runs
from strandline.sequence import Sequence, with_position
from strandline.sources import files


def export_variants(df: DataFrame, columns: list[str], path: str, experiment: str) -> dict[str, str]:
    """Write the raw, clipped and clipped-and-normalised tables; maxima are dataset-wide.

    The raw table is written once and the other two read it back, so upstream work runs once and a
    lost executor repeats only a scan.
    """
    paths = {v: f"{path}/{v}" for v in ("raw", "clipped", "normalized")}
    files.write_by_experiment(df, paths["raw"], experiment)
    raw = df.sparkSession.read.schema(df.schema).parquet(paths["raw"])
    files.write_by_experiment(clean.transform_columns(raw, columns, clip_low), paths["clipped"], experiment)
    maxima = clean.column_maxima(raw, columns)
    files.write_by_experiment(clean.normalize_by_max(raw, maxima, columns), paths["normalized"], experiment)
    return paths


@dataclass
class Run:
    """Result tables of one model run; each is written under its name."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    config: dict[str, Any] = field(default_factory=dict)


def write_run(run: Run, path: str) -> str:
    """One Parquet folder per result table; resolved settings as JSON."""
    for name, df in run.tables.items():
        files.write(df, f"{path}/{name}")
    if run.config:
        spark = next(iter(run.tables.values())).sparkSession
        rows = [(k, str(v)) for k, v in run.config.items()]
        files.write(spark.createDataFrame(rows, "name string, value string"), f"{path}/config", fmt="json")
    return path


@dataclass(frozen=True)
class AlignSpec:
    """Columns of the alignment job."""

    seq: Sequence  # of the samples; its axis is the time column ``t``
    t: str
    frame: str
    frame_time: str
    signals: tuple[str, ...]
    numeric: tuple[str, ...]
    flags: tuple[str, ...]
    pos: str
    flag: str = "anomaly"
    max_run: int = 10
    mode: str = "downsample"

    @property
    def keys(self) -> tuple[str, ...]:
        return self.seq.keys


def build_frames(frames: DataFrame, detections: DataFrame, flags: DataFrame | None, spec: AlignSpec) -> DataFrame:
    """Frame timeline with detections and anomaly flags; short flagged runs repaired."""
    key = [*spec.keys, spec.frame]
    joined = align.attach_detections(frames, detections, key, [spec.pos])
    if flags is None:
        joined = joined.withColumn(spec.flag, F.lit(0))
    else:
        joined = align.attach_flags(joined, align.first_per_key(flags, key, [spec.frame]), key, spec.flag)
    repaired = repair_runs(joined, spec.seq.along(spec.frame_time, (spec.frame_time, spec.frame)), spec.flag, list(spec.numeric), spec.max_run)
    return repaired.withColumns({c: to_bool(c) for c in spec.flags})


def align_experiments(
    samples: DataFrame, frames: DataFrame, detections: DataFrame, flags: DataFrame | None, spec: AlignSpec,
    finalize: list[tuple[str, Column]] = (),
) -> DataFrame:
    """All experiments at once: samples onto frames (downsample) or frame values onto samples (upsample)."""
    level = build_frames(frames, detections, flags, spec)
    assigned = align.assign_nearest(
        samples, frames, spec.keys, spec.t, spec.frame_time, spec.frame, spec.seq.bucket, spec.pos
    )
    key = [*spec.keys, spec.frame]
    if spec.mode == "downsample":
        means = align.frame_means(assigned, key, [spec.t, *spec.signals])
        out = align.downsample(level, means, key, spec.t, spec.frame_time)
    else:
        source = level.withColumnRenamed(spec.frame_time, spec.t)
        placed = align.interpolate_to(
            source, assigned, spec.keys, spec.t, list(spec.numeric), spec.seq.bucket, [spec.frame], spec.pos
        )
        out = align.upsample(placed, level.select(*key, spec.flag, *spec.flags), key)
    for name, column in finalize:
        out = out.withColumn(name, column)
    return out


@dataclass(frozen=True)
class ImageSpec:
    """What the detectors give per image, the rules, and the frames to keep (both ends included)."""

    critical: tuple[str, ...]
    blobs: str  # array of structs with x and y
    bucket: str | None = None  # of the frame number, for sources too long for one task
    start: int | None = None
    end: int | None = None
    scores: anomaly.AnomalyRules = anomaly.AnomalyRules()
    tracks: track.TrackRules = track.TrackRules()


def analyse_sources(images: DataFrame, found: DataFrame, spec: ImageSpec, path: str) -> Run:
    """From the images of all sources to tracks, scores and a summary: every table is written below ``path`` and read back by the next.

    ``images`` has the column ``path``; ``found`` the detectors' values per ``source_name`` and ``frame``, the first of equal rows
    counting. An image without any gets missing values and no blobs; a source without images gives no rows. Tracks advance by the
    images that are there, so a gap in their numbers is no frame without detections. Of images of one source and frame the first path counts.
    """
    key = ["source_name", "frame"]
    seq = Sequence(("source_name",), ("frame",), spec.bucket, axis="frame")
    tagged = files.tag_sources(images.select("path"), "path").withColumn("frame", frame_number("image_name"))
    if spec.start is not None:
        tagged = tagged.filter(F.col("frame") >= spec.start)
    if spec.end is not None:
        tagged = tagged.filter(F.col("frame") <= spec.end)
    ordered = with_position(align.first_per_key(tagged, key, ["path"]), seq, "tick")
    values = found.select(*key, *spec.critical, spec.blobs)
    joined = align.attach_detections(ordered.select(*key, "tick", "image_name", "mode"), values, key, list(spec.critical))

    run = Run()

    def kept(name: str, df: DataFrame) -> DataFrame:
        files.write(df, f"{path}/{name}")
        run.tables[name] = df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")
        return run.tables[name]

    detections = kept("detections", joined)
    points = detections.select(*key, "tick", F.posexplode(spec.blobs).alias("blob", "at")).select(*key, "tick", "blob", "at.x", "at.y")
    points = points.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    confirmed = track.track_objects(points, seq.keys, "frame", "x", "y", "blob", spec.tracks, spec.bucket, tick="tick")
    numbered = track.compact_ids(kept("confirmed", confirmed), seq.keys, "track_key", ["frame"])
    tracks = kept("tracks", numbered.select(*key, "blob", "x", "y", "track_id"))
    one = Sequence(("source_name", "track_id"), ("frame",), spec.bucket, axis="frame")
    kept("speeds", track.track_speed(tracks, one, "frame", "x", "y"))
    kept("trajectories", track.displacement(tracks, one.keys, "frame", "x", "y"))
    scores = kept("anomalies", anomaly.anomaly_score(detections.drop(spec.blobs), seq, list(spec.critical), spec.scores))

    summary = anomaly.anomaly_summary(scores, ("source_name", "mode"))
    moved = tracks.groupBy("source_name").agg(F.count("*").alias("points"), F.count_distinct("track_id").alias("tracks"))
    kept("sources", summary.join(moved, "source_name", "left").na.fill(0, ["points", "tracks"]))
    return run
