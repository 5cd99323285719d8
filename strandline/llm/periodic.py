"""Runs of repeated words: stretches that hold at least three copies of their smallest period, one after another.

String synchronising sets: at each dyadic scale t = 6, 12, 24, ... a position is chosen if, among the positions of some window of
t + 1 whose next t words are not themselves highly periodic (period of t / 3 or less), it or the position t further has the least
hash of its next t words. The choice depends on the next 2 t words alone, so a run of period p chooses the same positions again
p words on. For 1.5 t <= p < 3 t such a run is long enough to hold a chosen position whose context of 2 t words recurs p on, unless
all of it were highly periodic, which its smallest period rules out. So the pairs of equal contexts at distances from 1.5 t to 3 t
propose every period from 9 on; each pair is extended word by word to the whole run, so a hash only decides where to look, never
what is found. Contexts of chosen positions have periods over t / 3, so each meets at most nine earlier ones within 3 t: no pairs
explode. Periods up to 8, which the chosen positions of the least scale may miss, come from the highly periodic regions themselves,
found by comparing the text with its own shifts; the runs found so far give the highly periodic positions of the next scale.

Words of a slice of documents are laid end to end, parted by signs that occur once; a slice holds SLICE bytes of text or one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COPIES, BASE, DIRECT = 3, 6, 8  # least copies of a run, least scale, periods found by shifts
SLICE = 2 << 20
RUN = "struct<start:long,length:long,period:long>"
_ODD, _FAR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values, by doubling."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs of true."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).view(np.int8)))
    return edges[::2], edges[1::2]


def _by_shifts(words: np.ndarray, found: dict[tuple[int, int], int]) -> None:
    for p in range(1, min(DIRECT, len(words) - 1) + 1):
        begins, ends = _stretches(words[:-p] == words[p:])
        long = ends - begins >= (COPIES - 1) * p
        for b, e in zip(begins[long].tolist(), (ends[long] + p).tolist()):
            found.setdefault((b, e), p)  # a multiple of a smaller period has that period's very stretch


def _reach(words: np.ndarray, a: int, d: int, step: int) -> int:
    """How far from ``a`` on, in steps of 1 or -1, words equal the words d further."""
    n, size, done = len(words), 32, 0
    while True:
        if step > 0:
            stop = min(a + done + size, n - d)
            same = words[a + done : stop] == words[a + done + d : stop + d]
        else:
            stop = max(a - done - size + 1, 0)
            top = a - done + 1
            same = (words[stop:top] == words[stop + d : top + d])[::-1] if top > stop else np.empty(0, bool)
        if not len(same):
            return done
        miss = int(np.argmin(same))
        if not same[miss]:
            return done + miss
        done += len(same)
        size *= 2


def _propose(words: np.ndarray, fragments: np.ndarray, contexts: np.ndarray, t: int, periodic: np.ndarray, found: dict[tuple[int, int], int]) -> None:
    """Runs of periods 1.5 t <= p < 3 t. ``fragments`` and ``contexts`` hash the next t and 2 t words of each position."""
    ids = np.where(periodic[: len(fragments)], _FAR, fragments)
    least = _least(ids, t + 1)
    n = min(len(least), len(contexts))
    if n <= 0:
        return
    chosen = np.flatnonzero((least[:n] != _FAR) & ((ids[:n] == least[:n]) | (ids[t : t + n] == least[:n])))
    keys = contexts[chosen]
    order = np.argsort(keys, kind="stable")
    keys, at = keys[order], chosen[order]
    starts, gaps = [], []
    k = 1
    while k < len(at):
        gap = at[k:] - at[:-k]
        near = (keys[k:] == keys[:-k]) & (gap < 3 * t)
        if not near.any():
            break
        near &= 2 * gap >= 3 * t
        starts.append(at[:-k][near]), gaps.append(gap[near])
        k += 1
    if not starts:
        return
    start, gap = np.concatenate(starts), np.concatenate(gaps)
    order = np.lexsort((start, gap))
    known: tuple[int, int] = (0, 0)  # period and end of the stretch extended last
    for i, d in zip(start[order].tolist(), gap[order].tolist()):
        if known[0] == d and i < known[1]:
            continue
        ahead = _reach(words, i, d, 1)
        behind = _reach(words, i - 1, d, -1) if i else 0
        known = (d, i + ahead)
        if ahead + behind >= (COPIES - 1) * d:
            found.setdefault((i - behind, i + ahead + d), d)


def runs(words: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of at least COPIES copies of its smallest period, by start, then period.

    ``words``: one number per distinct word. ``longest``: the most words in a row that can form a run, if fewer than all.
    """
    found: dict[tuple[int, int], int] = {}
    n = len(words)
    if n >= COPIES:
        _by_shifts(words, found)
    longest = n if longest is None else longest
    t, hashes = BASE, None
    while 9 * t <= 2 * longest:  # periods from 1.5 t in at least three copies
        if hashes is None:
            one = _mixed(words.astype(np.uint64) * _ODD + _ODD)
            hashes = one[: n - BASE + 1].copy()
            for i in range(1, BASE):
                hashes = _mixed(hashes * _ODD + one[i : n - BASE + 1 + i])
        doubled = _mixed(hashes[:-t] * _ODD + hashes[t:])
        depth = np.zeros(n + 1, np.int32)
        for (b, e), p in found.items():
            if 3 * p <= t and e - b >= t:
                depth[b] += 1
                depth[e - t + 1] -= 1
        _propose(words, hashes, doubled, t, np.cumsum(depth[:-1]) > 0, found)
        hashes, t = doubled, 2 * t
    return sorted((b, e - b, p) for (b, e), p in found.items())


def runs_of_documents(documents: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each document, given its words. Long documents are taken by themselves, so short ones pay for few scales."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    classes: dict[int, list[int]] = {}
    for i, words in enumerate(documents):
        if len(words) >= COPIES:
            classes.setdefault(len(words).bit_length(), []).append(i)
    for members in classes.values():
        number: dict[bytes, int] = {}
        parts, begins, at = [], [], 0
        for i in members:
            parts.append(np.fromiter((number.setdefault(w, len(number)) for w in documents[i]), np.int64, len(documents[i])))
            begins.append(at)
            at += len(documents[i]) + 1
        line = np.empty(at, np.int64)
        for j, (b, part) in enumerate(zip(begins, parts)):
            line[b : b + len(part)] = part
            line[b + len(part)] = -1 - j  # occurs once: no run crosses it
        del parts, number
        for b, length, p in runs(line, max(len(documents[i]) for i in members)):
            j = int(np.searchsorted(begins, b, side="right")) - 1
            out[members[j]].append((b - begins[j], length, p))
    return out


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together have about SLICE bytes; a longer text is a range of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        more = len(text or "")
        if i > start and size + more > SLICE:
            yield start, i
            start, size = i, 0
        size += more
    if start < len(texts):
        yield start, len(texts)


def with_runs(docs: DataFrame, text: str = "text", least: int = 24, runs_out: str = "runs", collapsed_out: str = "collapsed") -> DataFrame:
    """``docs`` with the runs of at least ``least`` words of each whole text, and its words without the repeats, joined by one space.

    Words are what ASCII white space parts. A run is (start, length, period), numbered from word 0: at least COPIES copies of its smallest
    period that no neighbouring word extends. A word goes if any run holds it after that run's first period. A null text counts as
    empty: no runs, an empty collapsed text. Rows do not move; repeated rows each get their own result, equal texts equal ones; an empty
    table gives an empty table. Columns of docs named like the two outputs are replaced, all others stay as they are.
    """
    docs = docs.drop(runs_out, collapsed_out)
    at = docs.columns.index(text)
    docs = docs.withColumns({runs_out: F.lit(None).cast(f"array<{RUN}>"), collapsed_out: F.lit(None).cast("string")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            kind = batch.schema.field(batch.num_columns - 2).type
            for s, e in slices(texts):
                documents = [(t or "").encode().split() for t in texts[s:e]]
                found, kept = [], []
                for words, mine in zip(documents, runs_of_documents(documents)):
                    mine = [r for r in mine if r[1] >= least]
                    if mine:
                        gone = np.zeros(len(words) + 1, np.int32)
                        for b, length, p in mine:
                            gone[b + p] += 1
                            gone[b + length] -= 1
                        words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
                    found.append([{"start": b, "length": length, "period": p} for b, length, p in mine])
                    kept.append(b" ".join(words).decode())
                part = batch.slice(s, e - s)
                columns = [*part.columns[:-2], pa.array(found, kind), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
