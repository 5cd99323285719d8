"""Free runs of autoregressive models: many chunks and many models advance side by side, one step of time at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa


@dataclass(frozen=True)
class Recurrence:
    """y(t) = drive(t) + sum over lags k and powers p of ar[m, k, p - 1] * ((y(t - k - 1) - centre[k]) / scale[k]) ** p, for models m.

    ``delta`` adds the previous value. ``bounds`` (low and high per model) clip the output. ``strict``: a model whose output is not
    finite stays missing to the end of the chunk. Before a model is live, the truth is its past, or ``seed`` where it is missing.
    """

    ar: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    delta: bool = False
    low: np.ndarray | float = -np.inf
    high: np.ndarray | float = np.inf
    strict: bool = False
    seed: float = 0.0

    @property
    def shape(self) -> tuple[int, int]:
        return self.ar.shape[0], max(1, self.ar.shape[1])

    def start(self) -> tuple[np.ndarray, np.ndarray]:
        """Past outputs and divergence flags of one chunk."""
        return np.full(self.shape, np.nan), np.zeros(self.shape[0], bool)

    def _driven(self, past: np.ndarray) -> np.ndarray:
        lags, powers = self.ar.shape[1:]
        if not lags:
            return np.zeros(past.shape[:2])
        w = (past[:, :, :lags] - self.centre) / self.scale
        out = np.zeros_like(w)
        for p in range(powers - 1, -1, -1):
            out = (out + self.ar[None, :, :, p]) * w
        # a lag that a model does not use may be missing
        return np.where(self._unused, 0.0, out).sum(axis=2)

    @property
    def _unused(self) -> np.ndarray:
        return (self.ar == 0).all(axis=2)[None]

    def run(self, drive: np.ndarray, truth: np.ndarray, live: np.ndarray, edges: np.ndarray, states: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Outputs [rows, models]; missing where a model is not live. Chunk i holds rows edges[i] to edges[i + 1]; its state is moved on."""
        length = np.diff(edges)
        order = np.argsort(-length, kind="stable")
        first, length = edges[:-1][order], length[order]
        past = np.stack([states[i][0] for i in order])
        dead = np.stack([states[i][1] for i in order])
        seeds = np.where(np.isfinite(truth), truth, self.seed)
        out = np.full(drive.shape, np.nan)
        unused = self._unused if self.ar.shape[1] else np.ones((1, self.shape[0], 1), bool)
        with np.errstate(all="ignore"):
            for t in range(int(length[0]) if len(length) else 0):
                n = int(np.searchsorted(-length, -t, side="left"))  # chunks longer than t
                at, before = first[:n] + t, past[:n]
                value = drive[at] + self._driven(before)
                if self.delta:
                    value = value + before[:, :, 0]
                if self.strict:
                    ready = np.isfinite(drive[at]) & (np.isfinite(before[:, :, : unused.shape[2]]) | unused).all(axis=2)
                    dead[:n] |= live[at] & ready & ~np.isfinite(value)
                    value = np.where(ready & ~dead[:n], value, np.nan)
                value = np.minimum(np.maximum(value, self.low), self.high)  # a missing value stays missing
                out[at] = np.where(live[at], value, np.nan)
                step = np.where(live[at], value, seeds[at, None])
                past[:n] = np.concatenate([step[:, :, None], before[:, :, :-1]], axis=2)
        for slot, i in enumerate(order):
            states[i] = (past[slot], dead[slot])
        return out


def chunks_in(batches: Iterator[pa.RecordBatch], position: str, recurrence: Recurrence) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list]]:
    """(batch, chunk edges, states) of batches in order; a chunk starts where ``position`` is 0, and its state lives on to the next batch."""
    carried = recurrence.start()
    for batch in batches:
        if not batch.num_rows:
            continue
        begins = np.flatnonzero(batch.column(batch.schema.get_field_index(position)).to_numpy() == 0)
        inner = begins[begins > 0]
        edges = np.concatenate([[0], inner, [batch.num_rows]])
        states = [carried if not len(begins) or begins[0] > 0 else recurrence.start(), *[recurrence.start() for _ in inner]]
        yield batch, edges, states
        carried = states[-1]
