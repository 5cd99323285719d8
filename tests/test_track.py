"""The tracker against a direct frame loop, in batch (cut into episodes) and as a stream."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import track
from tests.conftest import rows

RULES = track.TrackRules(radius=8.0, max_missed=2, min_hits=2, min_displacement=2.0, min_vertical=1.0)


def direct(detections, rules, frames):
    """All frames in order with scalar arithmetic; returns {(frame, item): track number}."""
    tracks, found, serial = [], {}, 0
    a = np.array([[1, 0, 1, 0], [0, 1, 0, 1], [0, 0, 1, 0], [0, 0, 0, 1.0]])
    h = np.eye(2, 4)
    for f in range(frames):
        seen = detections.get(f, [])
        for t in tracks:
            t["x"], t["p"] = a @ t["x"], a @ t["p"] @ a.T + rules.process_noise * np.eye(4)
        pairs = sorted(
            (float(np.hypot(x - t["x"][0], y - t["x"][1])), i, j)
            for i, t in enumerate(tracks) for j, (_, x, y) in enumerate(seen)
            if np.hypot(x - t["x"][0], y - t["x"][1]) <= rules.radius
        )
        took, given = set(), set()
        for _, i, j in pairs:
            if i in took or j in given:
                continue
            took.add(i), given.add(j)
            t, (item, x, y) = tracks[i], seen[j]
            s = h @ t["p"] @ h.T + rules.measurement_noise * np.eye(2)
            k = t["p"] @ h.T @ np.linalg.inv(s)
            t["x"], t["p"] = t["x"] + k @ (np.array([x, y]) - h @ t["x"]), (np.eye(4) - k @ h) @ t["p"]
            t["hits"] += 1
            t["missed"] = -1
            dx, dy = x - t["from"][0], y - t["from"][1]
            t["sure"] |= t["hits"] >= rules.min_hits and np.hypot(dx, dy) >= rules.min_displacement and dy >= rules.min_vertical
            if t["sure"]:
                found[(f, item)] = t["id"]
        for t in tracks:
            t["missed"] += 1
        for j, (item, x, y) in enumerate(seen):
            if j not in given:
                tracks.append({"id": serial, "x": np.array([x, y, 0, 0.0]), "p": np.zeros((4, 4)), "from": (x, y), "hits": 1, "missed": 0, "sure": False})
                serial += 1
        tracks = [t for t in tracks if t["missed"] <= rules.max_missed]
    return found


def groups(assignment):
    out = defaultdict(set)
    for point, t in assignment.items():
        out[t].add(point)
    return sorted(map(sorted, out.values()))


@pytest.fixture(scope="module")
def scene():
    random.seed(9)
    data = []
    for key in ("a", "b"):
        item = 0
        for _ in range(25):
            x, y, start = random.randint(0, 60), random.randint(0, 60), random.choice([0, 15, 40, 41, 70]) + random.randint(0, 4)
            for f in range(start, start + random.randint(2, 12)):
                if random.random() < 0.8:
                    data.append((key, f, item, x + 2 * (f - start) + random.randint(-1, 1), y + 3 * (f - start)))
                    item += 1
    return data


@pytest.mark.parametrize("bucket", [None, "floor(f / 10)"])
def test_batch_tracker(spark, scene, bucket):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(scene, "k string, f int, item int, x int, y int").repartition(4)
        out = track.track_objects(df, ("k",), "f", "x", "y", "item", RULES, bucket)
        ids = track.compact_ids(out, ("k",), "track_key", ["f"])
        got = ids.select("k", "f", "item", "track_id").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for key in ("a", "b"):
        frames = defaultdict(list)
        for k, f, item, x, y in scene:
            if k == key:
                frames[f].append((item, x, y))
        want = direct(frames, RULES, 120)
        mine = {(r["f"], r["item"]): r["track_id"] for r in got if r["k"] == key}
        assert groups(mine) == groups(want) and len(want) > 20
        assert sorted(set(mine.values())) == list(range(len(set(mine.values()))))


def test_unreadable_frames_do_not_age_tracks(spark):
    data = [("a", f, f, 0, 3 * f) for f in (0, 1, 2)] + [("a", 20, 3, 0, 9)]
    df = spark.createDataFrame(data, "k string, f int, item int, x int, y int")
    aged = track.track_objects(df, ("k",), "f", "x", "y", "item", RULES, None)
    assert rows(aged.select("f")) == [(1,), (2,)]
    ticked = df.withColumn("tick", F.when(F.col("f") == 20, 3).otherwise(F.col("f")))
    kept = track.track_objects(ticked, ("k",), "f", "x", "y", "item", RULES, None, tick="tick")
    assert rows(kept.select("f")) == [(1,), (2,), (20,)]


def test_stream_matches_batch(spark):
    from strandline.plans import tracking
    from strandline.plans.stand_ins import table

    sf_dir = "/root/testdata/sf0.001"
    events = tracking.stream_rows(table(spark, sf_dir, "events"))
    batch = track.track_objects(
        events.withColumns({"a": F.floor("a"), "b": F.floor("b")}), ("key",), "frame", "a", "b", "item", tracking.STREAM_RULES, None
    )
    points = lambda df: {(r["key"], r["frame"], r["item"]) for r in df.collect()}
    streamed = tracking.track_stream(spark, sf_dir)
    expected = points(batch)
    assert points(streamed) == expected and len(expected) > 20  # the marker releases the last day too


def test_jump_stream_matches_batch(spark):
    from strandline.operators.anomaly import jump_flags
    from strandline.plans import tracking
    from strandline.plans.stand_ins import table
    from strandline.sequence import Sequence

    sf_dir = "/root/testdata/sf0.001"
    events = tracking.stream_rows(table(spark, sf_dir, "events"))
    batch = jump_flags(events, Sequence(("key",), ("frame", "item"), None), "a")
    want = {(r["key"], r["item"]): float(r["jump"]) for r in batch.collect()}
    got = {(r["key"], r["item"]): r["result"] for r in tracking.jump_stream(spark, sf_dir).collect()}
    assert got == want


def test_speed_needs_a_positive_step(spark):
    from strandline.sequence import Sequence

    df = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 2, 6.0, 8.0), (1, 2, 0.0, 0.0)], "t int, f int, x double, y double")
    out = track.track_speed(df, Sequence(("t",), ("f", "x"), None), "f", "x", "y")
    assert sorted(r["speed"] for r in out.collect()) == [0.0]


@pytest.mark.parametrize("radius", [0.5, 7.0, 1e6])
def test_cells_find_the_near_pairs(radius):
    """The cell grid gives what comparing everything with everything gives, in the same order."""
    rng = np.random.default_rng(4)
    tracks = [track.Track(i, float(x), float(y), 0, 0, 0, 0, 0, 0, 0) for i, (x, y) in enumerate(rng.uniform(-60, 60, (70, 2)).round(1))]
    xs, ys = rng.uniform(-60, 60, (2, 90)).round(1).tolist()
    want = sorted((d, i, j) for i, t in enumerate(tracks) for j, (x, y) in enumerate(zip(xs, ys)) if (d := float(np.hypot(x - t.x, y - t.y))) <= radius)
    got = track._near(tracks, xs, ys, radius)
    assert [g[1:] for g in got] == [w[1:] for w in want] and np.allclose([g[0] for g in got], [w[0] for w in want])
    assert track._near(tracks[:1], [float("nan")], [1.0], radius) == [] and track._near([], xs, ys, radius) == []


def test_a_frame_of_many_detections():
    """Two frames of 10 000 objects each: every object is matched with itself, in time that grows with the near pairs only."""
    import time

    side = np.arange(100) * 30.0
    xs, ys = (a.ravel().tolist() for a in np.meshgrid(side, side))
    rules, state = track.TrackRules(radius=20.0, min_hits=2, min_displacement=0.0, min_vertical=0.0), track.TrackerState()
    start = time.perf_counter()
    assert track.step_frame(state, 0, xs, ys, rules) == []
    moved = track.step_frame(state, 1, [x + 3 for x in xs], [y + 4 for y in ys], rules)
    assert sorted(moved) == [(i, i) for i in range(10_000)] and time.perf_counter() - start < 10


class _Held:
    """A map or a value of a stream's state that counts its calls."""

    def __init__(self, calls):
        self.held, self.value, self.calls = {}, None, calls

    def _did(self, what):
        self.calls.append(1)
        return what

    def updateValue(self, key, value):
        self.held[self._did(key)] = value

    def getValue(self, key):
        return self.held[self._did(key)]

    def removeKey(self, key):
        del self.held[self._did(key)]

    def containsKey(self, key):
        return self._did(key in self.held)

    def keys(self):
        return self._did(iter(list(self.held)))

    def exists(self):
        return self._did(bool(self.held) or self.value is not None)

    def get(self):
        return self._did(self.value)

    def update(self, value):
        self.value = self._did(value)


def test_waiting_rows_need_few_calls_of_the_state(monkeypatch):
    """Rows of as many times as rows, in parts that overlap in time, leave in order; the state is called once per many rows."""
    from types import SimpleNamespace

    import pandas as pd

    from strandline.streaming import ordered

    monkeypatch.setattr(ordered, "SORTED", 3000, raising=False)
    calls, timers = [], []
    handle = SimpleNamespace(
        getMapState=lambda *_: _Held(calls), getValueState=lambda *_: _Held(calls), registerTimer=timers.append, deleteTimer=timers.remove
    )
    made = ordered.JumpProcessor(30, 0.2, 5)
    made.init(handle)
    at = np.random.default_rng(5).permutation(20_000)
    part = pd.DataFrame({"at": at * 10, "frame": at, "item": at, "a": at.astype(float), "b": 0.0})
    for half in (part[:9_000], part[9_000:]):
        list(made.handleInputRows(("k",), iter([half[:4_000], half[4_000:]]), None))
    out = []
    for upto in (-1, 70_005, 200_000):
        if timers and min(timers) <= upto:
            timers.clear()
            out.append([f for part in made.handleExpiredTimer(("k",), SimpleNamespace(getCurrentWatermarkInMs=lambda: upto), None) for f in part["frame"]])
    assert out == [list(range(7_001)), list(range(7_001, 20_000))]
    assert len(calls) < 200 and not timers


def test_very_many_short_episodes(spark):
    """An episode costs its frames, not table operations of its own: 200 000 of two frames each."""
    import time

    seen = spark.range(400_000).select(
        (F.col("id") % 40).alias("k"), (F.expr("id div 80") * 50 + F.expr("(id div 40) % 2")).alias("f"), F.col("id").alias("item"),
        F.lit(3).alias("x"), (5 * F.expr("(id div 40) % 2")).alias("y"),
    ).repartition(8, "k")
    began = time.time()
    found = track.track_objects(seen, ("k",), "f", "x", "y", "item", RULES, None).agg(F.count("*"), F.sum("item"), F.max("track_key.n")).first()
    late = [i for i in range(400_000) if i // 40 % 2]
    assert tuple(found) == (200_000, sum(late), 0)
    assert time.time() - began < 25
