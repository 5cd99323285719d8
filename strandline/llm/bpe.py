"""Byte-level BPE by rank file: encoding and decoding of whole texts.

Pieces of the pattern are encoded in padded matrices of one length class each. In every round each row merges its leftmost pair
of least rank; pair ranks come from a hash table, and rows that are done leave the matrix. A task encodes each distinct piece
once and keeps it.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import lean

NONE = np.int64(1 << 40)  # rank of a pair that does not merge
CLASSES = (2, 4, 8, 12, 16, 24, 32, 64, 128)  # row lengths; longer pieces go through the heap, with the same result
KEPT = 200_000  # distinct pieces a worker remembers before it starts anew
CELLS = 1 << 17  # of a matrix


class Ranks:
    """Token bytes, and a hash table from a pair of ids to the id (which is the rank) of the merged token."""

    def __init__(self, lines: bytes) -> None:
        self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines.splitlines() if line)}
        self.tokens = {b: a for a, b in self.rank.items()}
        if len({len(t) == 1 and t for t in self.rank} - {False}) != 256:
            raise ValueError("the rank file must hold every single byte")
        self.byte_id = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        left, right, merged = [], [], []
        for token, rank in self.rank.items():
            for cut in range(1, len(token)):
                a, b = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        self.bits = max(10, int(4 * len(merged) + 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int64)
        keys, values = np.array(left, np.int64) << 24 | np.array(right, np.int64), np.array(merged, np.int64)
        slots, self.probes = self._slot(keys), 0
        while len(keys):  # each round seats what finds its slot empty and moves the rest one on
            self.probes += 1
            free = self.keys[slots] < 0
            self.keys[slots[free]] = keys[free]
            seated = self.keys[slots] == keys
            self.values[slots[seated]] = values[seated]
            keys, values, slots = keys[~seated], values[~seated], (slots[~seated] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where a pair does not merge (ids below 0 are padding)."""
        keys = left << 24 | right
        slots = self._slot(keys)
        out = np.full(keys.shape, NONE, np.int64)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        flat, keys, slots = out.reshape(-1), keys.reshape(-1), slots.reshape(-1)
        for _ in range(self.probes):
            found = self.keys[slots[open_]]
            hit = found == keys[open_]
            flat[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
            if not len(open_):
                break
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
        return out

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece: itself if it is a token, else what the merges leave."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        by_class: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (whole := self.rank.get(p)) is not None:
                out[i] = np.array([whole], np.int64)
            elif len(p) > CLASSES[-1]:
                out[i] = self._long(p)
            else:
                by_class.setdefault(next(c for c in CLASSES if len(p) <= c), []).append(i)
        for width, members in by_class.items():
            rows = CELLS // width
            for start in range(0, len(members), rows):
                block = members[start : start + rows]
                for i, ids in zip(block, self._matrix([pieces[i] for i in block], width)):
                    out[i] = ids
        return out

    def _matrix(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = np.where(np.arange(width) < lengths[:, None], self.byte_id[raw], -1)
        ranks = self.pair(ids[:, :-1], ids[:, 1:])
        done: list[np.ndarray] = [np.empty(0, np.int64)] * len(pieces)
        rows = np.arange(len(pieces))
        while len(rows):
            at = ranks.argmin(axis=1)  # the first of equal minima
            lines = np.arange(len(rows))
            best = ranks[lines, at]
            stop = best == NONE
            if stop.any():
                for r, line in zip(rows[stop].tolist(), ids[stop]):
                    done[r] = line[line >= 0]
                go = ~stop
                rows, ids, ranks, at, best = rows[go], ids[go], ranks[go], at[go], best[go]
                if not len(rows):
                    break
                lines = np.arange(len(rows))
                used = max(2, int((ids >= 0).sum(axis=1).max()))
                ids, ranks = ids[:, :used], ranks[:, : used - 1]
            shift = np.arange(ids.shape[1]) + (np.arange(ids.shape[1]) > at[:, None])  # closes the gap behind the merged pair
            padded = np.concatenate([ids, np.full((len(rows), 1), -1, np.int64)], axis=1)
            ids = np.take_along_axis(padded, shift, axis=1)
            ids[lines, at] = best
            padded = np.concatenate([ranks, np.full((len(rows), 1), NONE, np.int64)], axis=1)
            ranks = np.take_along_axis(padded, shift[:, :-1], axis=1)
            n = ids.shape[1]
            for side in (at - 1, at):  # only the two pairs that touch the merged token are new
                ok = np.flatnonzero((side >= 0) & (side < n - 1))
                ranks[ok, side[ok]] = self.pair(ids[ok, side[ok]], ids[ok, side[ok] + 1])
        return done

    def _long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece with a heap of (rank, place): n log n."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.pair(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i) for i, r in enumerate(first) if r < NONE]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}

        def rank(i: int) -> int:
            j = after[i]
            if j >= n:
                return int(NONE)
            pair = (ids[i], ids[j])
            if pair not in known:
                known[pair] = int(self.pair(np.array([pair[0]]), np.array([pair[1]]))[0])
            return known[pair]

        current = first + [int(NONE)]
        while heap:
            r, i = heapq.heappop(heap)
            if current[i] != r or ids[i] < 0:
                continue
            j = after[i]
            ids[i], ids[j] = r, -1
            current[j] = int(NONE)
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (i, before[i]):
                if k >= 0:
                    current[k] = rank(k)
                    if current[k] < NONE:
                        heapq.heappush(heap, (current[k], k))
        return np.array([x for x in ids if x >= 0], np.int64)


class Codec:
    """Encodes texts piece by piece; one per Python worker and rank file."""

    _of: dict[bytes, Codec] = {}

    def __init__(self, lines: bytes, pattern: str) -> None:
        self.ranks, self.split = Ranks(lines), regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}

    @classmethod
    def of(cls, lines: bytes, pattern: str) -> Codec:
        name = hashlib.md5(lines + pattern.encode()).digest()
        if name not in cls._of:
            cls._of[name] = cls(lines, pattern)
        return cls._of[name]

    def pieces(self, texts: list[str | None]) -> list[list[str]]:
        """The pieces of each text, all of them in ``known``; those met for the first time are encoded together."""
        found = [self.split(t) if t else [] for t in texts]
        new = set().union(*found).difference(self.known)
        if len(self.known) + len(new) > KEPT:
            self.known.clear()
            new = set().union(*found)
        new = list(new)
        for piece, ids in zip(new, self.ranks.encode([p.encode() for p in new])):
            self.known[piece] = tuple(ids.tolist())
        return found

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        found, known = self.pieces(texts), self.known
        return [[i for p in pieces for i in known[p]] for pieces in found]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.ranks.tokens.__getitem__, ids))


def _slices(batches: Iterator[pa.RecordBatch], column: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut to about so many characters of a column: the pieces of a slice are held at once."""
    for batch in batches:
        start = total = 0
        for i, text in enumerate(batch.column(column)):
            n = len(text.as_py() or "")
            if total and total + n > size:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def encode(docs: DataFrame, ranks_file: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the column ``ids`` (array of int): each match of ``pattern`` encoded by the ranks, no special tokens.

    A null or empty text gives an empty array. Whole texts of any length; pieces longer than the widest matrix are merged by a
    heap in the same order. Rows stay where they are: no shuffle. A column already named like ``ids`` is replaced.
    """
    with open(ranks_file, "rb") as f:  # read by the driver, under a megabyte; tasks get the bytes
        lines = f.read()
    docs = docs.drop(ids).withColumn(ids, F.lit(None).cast("array<int>"))
    at, out = docs.columns.index(text), len(docs.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(lines, pattern)
        for batch in _slices(batches, at):
            arrays = batch.columns
            arrays[out] = pa.array(codec.encode(batch.column(at).to_pylist()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return docs.mapInArrow(lean(run), docs.schema)


def decode(rows: DataFrame, ranks_file: str, pattern: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """``rows`` with the column ``out`` (binary): the bytes of the ids, empty for null or no ids. An unknown id fails."""
    with open(ranks_file, "rb") as f:
        lines = f.read()
    rows = rows.drop(out).withColumn(out, F.lit(None).cast("binary"))
    at, to = rows.columns.index(ids), len(rows.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(lines, pattern)
        for batch in batches:
            arrays = batch.columns
            arrays[to] = pa.array([codec.decode(x or []) for x in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return rows.mapInArrow(lean(run), rows.schema)


def digests(docs: DataFrame, ranks_file: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every text: encoded, and decoded again from the ids, in one pass over the rows.

    The ids are written down as decimal text once per distinct piece; the bytes are those of the ids of each piece, joined.
    """
    with open(ranks_file, "rb") as f:
        lines = f.read()
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(lines, pattern)
        shown: dict[str, tuple[int, str, bytes]] = {}  # per piece: how many ids, the ids written down, the ids decoded
        for part in _slices(batches, 1):
            count, ids_sha, decoded_sha = [], [], []
            found = [codec.split(t) if t else [] for t in part.column(1).to_pylist()]
            if len(shown) > KEPT:
                shown.clear()
            new = list(set().union(*found).difference(shown))
            for piece, ids in zip(new, codec.ranks.encode([p.encode() for p in new])):
                ids = ids.tolist()
                shown[piece] = (len(ids), ",".join(map(str, ids)), codec.decode(ids))
            for pieces in found:
                parts = list(map(shown.__getitem__, pieces))
                count.append(sum([p[0] for p in parts]))
                ids_sha.append(hashlib.sha256(",".join([p[1] for p in parts]).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(b"".join([p[2] for p in parts])).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(key, text).mapInArrow(lean(run), f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
