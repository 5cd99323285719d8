"""Keyed streaming operators over frames that may arrive out of order.

Rows wait in state until the event-time watermark has passed their frame; they are then processed in
frame order. Rows later than the watermark are dropped by Spark and counted in the query progress
(``numRowsDroppedByWatermark``). Where the input ends, ``end_marker`` rows close it: the watermark follows them past every
row still held. State per key is the rows inside the watermark delay plus the
operator's own small state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import astuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strandline.operators.track import Track, TrackerState, TrackRules, step_frame

END = -(1 << 63)  # the frame of a marker
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


CHUNK = 1000  # rows of one entry of the state
SORTED = 100_000  # rows that are sorted by time before they are cut into entries


class _Ordered(StatefulProcessor):
    """Keeps rows (at, frame, item, a, b) per key in entries of up to CHUNK rows in order of time; subclasses consume them in order.

    New rows are only added, never read with those that wait, so calls to the state grow with the rows a key gets over CHUNK. One
    timer waits for the earliest time; when it fires, entries that begin before the watermark are taken out one after another, and
    what is later than the watermark goes back. Rows leave in order of time, frame and item. All rows of a frame must share one event time.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, serial long", "rows string")
        self.memory = handle.getValueState("memory", "body string, timer long, serial long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        body, timer, serial = self.memory.get() if self.memory.exists() else (None, None, 0)
        held: list[tuple] = []
        first = None
        for part in rows:
            held += part.loc[part["frame"] != END, ["at", "frame", "item", "a", "b"]].itertuples(index=False, name=None)
            if len(held) >= SORTED:
                first, serial, held = self._wait(held, first, serial), serial + -(-len(held) // CHUNK), []
        if held:
            first, serial = self._wait(held, first, serial), serial + -(-len(held) // CHUNK)
        if first is None:
            return iter(())
        if timer is None or first < timer:
            if timer is not None:
                self.handle.deleteTimer(int(timer))
            self.handle.registerTimer(first)
            timer = first
        self.memory.update((body, timer, serial))
        return iter(())

    def _wait(self, rows: list[tuple], first: int | None, serial: int) -> int:
        """Adds rows to the state, with serials from ``serial`` on; the earliest time so far."""
        rows.sort(key=lambda r: r[:3])
        for k, at in enumerate(range(0, len(rows), CHUNK)):
            self.waiting.updateValue((int(rows[at][0]), serial + k), (json.dumps(rows[at : at + CHUNK]),))
        return int(rows[0][0]) if first is None else min(first, int(rows[0][0]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs()
        body, _, serial = self.memory.get() if self.memory.exists() else (None, None, 0)
        state = self.restore(json.loads(body) if body else None)
        entries = sorted((int(k[0]), int(k[1])) for k in self.waiting.keys())
        due = [e for e in entries if e[0] <= upto]
        ready: list[tuple] = []
        for k, entry in enumerate(due):
            ready += map(tuple, json.loads(self.waiting.getValue(entry)[0]))
            self.waiting.removeKey(entry)
            if k + 1 < len(due) and len(ready) < SORTED and due[k + 1][0] <= ready[-1][0]:
                continue  # the next entry begins before this one ends
            ready.sort(key=lambda r: r[:3])
            end = due[k + 1][0] if k + 1 < len(due) else upto + 1
            out_of = next((i for i, r in enumerate(ready) if r[0] >= end), len(ready))
            made = self.consume(state, [r[1:] for r in ready[:out_of]])
            ready = ready[out_of:]
            if made:
                frame = pd.DataFrame(made, columns=["frame", "item", "a", "b", "result"])
                frame.insert(0, "key", str(key[0]))
                yield frame
        later = min([e[0] for e in entries[len(due) : len(due) + 1]] + [r[0] for r in ready[:1]], default=None)
        if ready:
            self._wait(ready, None, serial)
            serial += -(-len(ready) // CHUNK)
        if later is not None:
            self.handle.registerTimer(int(later))
        self.memory.update((json.dumps(self.body(state)), later, serial))

    def close(self) -> None:
        pass


class TrackerProcessor(_Ordered):
    """Same per-frame step as the batch tracker; ``result`` is the track id."""

    def __init__(self, rules: TrackRules):
        self.rules = rules

    def restore(self, body) -> TrackerState:
        state = TrackerState()
        if body is not None:
            state.next_id, state.frame = body["next"], body["frame"]
            state.tracks = [Track(*t) for t in body["tracks"]]
        return state

    def body(self, state: TrackerState) -> dict:
        return {"next": state.next_id, "frame": state.frame, "tracks": [astuple(t) for t in state.tracks]}

    def consume(self, state: TrackerState, rows: list[tuple]) -> list[tuple]:
        out, at = [], 0
        while at < len(rows):
            end = at
            while end < len(rows) and rows[end][0] == rows[at][0]:
                end += 1
            frame = rows[at:end]
            xs, ys = [float(int(r[2])) for r in frame], [float(int(r[3])) for r in frame]
            for d, track in step_frame(state, frame[0][0], xs, ys, self.rules):
                out.append((*frame[d], float(track)))
            at = end
        return out


class JumpProcessor(_Ordered):
    """Jump flag against the mean of the previous ``window`` values; ``result`` is 0 or 1."""

    def __init__(self, window: int, fraction: float, min_periods: int):
        self.window, self.fraction, self.min_periods = window, fraction, min_periods

    def restore(self, body) -> list:
        return list(body or [])

    def body(self, state: list) -> list:
        return state

    def consume(self, state: list, rows: list[tuple]) -> list[tuple]:
        out = []
        for frame, item, a, b in rows:
            seen = [v for v in state if v is not None]
            jump = False
            if len(seen) >= self.min_periods and a == a:
                mean = sum(seen) / len(seen)
                jump = abs(a - mean) / (abs(mean) + 1e-9) > self.fraction
            out.append((frame, item, a, b, float(jump)))
            state[:] = [*state, a if a == a else None][-self.window :]
        return out


def run_ordered(rows: DataFrame, delay: str, processor: StatefulProcessor) -> DataFrame:
    """Streaming plan: ``rows`` needs key, event_time, frame, item, a, b."""
    prepared = (
        rows.withWatermark("event_time", delay)
        .withColumn("at", F.unix_millis("event_time"))
        .select("key", "event_time", "at", "frame", "item", "a", "b")
    )
    return prepared.groupBy("key").transformWithStateInPandas(
        statefulProcessor=processor,
        outputStructType="key string, frame long, item long, a double, b double, result double",
        outputMode="Append",
        timeMode="EventTime",
    )


def end_marker(rows: DataFrame, delay: str) -> DataFrame:
    """One row in the form of ``rows`` that ends the input once it has followed them into the stream; it gives no result.

    Its event time is later than the last row by more than ``delay``, so the watermark passes all rows and they leave in order.
    Rows that arrive after it are late. No rows, no marker.
    """
    last = rows.agg(F.max("event_time").alias("last")).filter("last is not null")
    values = {"event_time": F.expr(f"last + interval {delay} + interval 1 second"), "key": F.lit(""), "frame": F.lit(END), "item": F.lit(0)}
    return last.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema.fields])


def track_stream(rows: DataFrame, delay: str, rules: TrackRules) -> DataFrame:
    return run_ordered(rows, delay, TrackerProcessor(rules))


def jump_stream(rows: DataFrame, delay: str, window: int = 30, fraction: float = 0.20, min_periods: int = 5) -> DataFrame:
    return run_ordered(rows, delay, JumpProcessor(window, fraction, min_periods))
