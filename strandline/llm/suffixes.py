"""Suffix-array dedup: every byte covered by a 100-byte string that also starts earlier is removed.

1. Anchors. In every window of 100 bytes the 24-byte string of least hash is its anchor (the first of equals), so equal windows
   have the same anchor at the same place. The windows of one anchor occurrence are a run of starts; the bytes they cover are its
   piece. A document of n bytes has about n / 35 pieces.
2. Pieces of one anchor and equal content are settled by their first occurrence: 64-bit hashes find them, their bytes confirm it. A task settles its own before the shuffle, so copied pages and passages reach it once per task, not once per
   document. Pieces that hashes alone call equal go to the sort.
3. What is left are first occurrences whose anchor also occurs with other content: the edges of repeated passages. Their bytes
   are fetched, and a suffix sort of their windows finds equal ones. Suffixes are compared by the polynomial hashes of their
   prefixes: a binary search finds how far two agree, and one byte decides. Neighbours that the hashes call equal are compared
   byte by byte; a bucket with a collision is sorted again by its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import NULL_ID, discard, lean, written

LENGTH, GRAM = 100, 24
SPAN = LENGTH - GRAM + 1  # grams of a window
HOT = 16384  # pieces of one anchor that one task sorts; the windows of further ones are settled by their bytes
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))
_RANDOM = np.random.default_rng(20240501)
BYTE = tuple(_RANDOM.integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False) for _ in BASES)
KNOWN = 1 << 18  # powers that a worker keeps; more are made when a text needs them, and go with it
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
SPAN_TYPE = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
SETTLED = 200_000  # pieces that a task settles together, and with them their texts
SORTED = 1 << 19  # bytes of pieces that a task sorts together; more only where one group has more
STEP = 1 << 20  # bytes of one document handled at a time, overlapping by a window


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    if n <= KNOWN and which in _POWERS:
        power, inverse = _POWERS[which]
        return power[:n], inverse[:n]
    made = []
    for factor in (BASES[which], np.uint64(pow(int(BASES[which]), -1, 1 << 64))):
        x = np.full(max(n, KNOWN), factor, np.uint64)
        x[0] = 1
        made.append(np.multiply.accumulate(x, out=x))
    if n <= KNOWN:
        _POWERS[which] = (made[0], made[1])
    return made[0][:n], made[1][:n]


class Prefixes:
    """Polynomial hashes of all prefixes of a byte array; the hash of any stretch in constant time."""

    def __init__(self, data: np.ndarray, which: int = 0) -> None:
        power, self.inverse = _powers(len(data) + 1, which)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE[which][data] * power[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def pieces_of(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per anchor occurrence: first window start, number of further starts, hash of the anchor, hash of the piece."""
    starts, more, anchors, contents = [], [], [], []
    windows = len(data) - LENGTH + 1
    for s in range(0, max(0, windows), STEP):
        part = data[s : min(len(data), s + STEP + LENGTH - 1)]
        first, second = Prefixes(part, 0), Prefixes(part, 1)
        grams = _mixed(first.of(np.arange(len(part) - GRAM + 1), GRAM))
        low = np.uint64((1 << 24) - 1)
        ranked = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)  # least hash, then first place
        width, least = 1, ranked
        while 2 * width <= SPAN:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < SPAN:
            n = len(ranked) - SPAN + 1
            least = np.minimum(least[:n], least[SPAN - width : SPAN - width + n])
        at = (least & low).astype(np.int64)  # the anchor of each window
        run = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        count = np.diff(np.concatenate([run, [len(at)]]))
        place = (at[run] - run) * 128 + count  # where the anchor lies in the piece, and the piece's length
        placed = place.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        starts.append(run + s), more.append(count - 1), anchors.append(grams[at[run]])
        contents.append(_mixed(second.of(run, count + LENGTH - 1) + placed))
    if not starts:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 2
    return tuple(np.concatenate(x) for x in (starts, more, anchors, contents))


def _packed(start: np.ndarray, more: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Start, run and the row's mark in one long that sorts by start."""
    return (start << 33) | (more << 26) | row


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the stretches of the given lengths from ``a`` and from ``b`` are equal."""
    out = np.empty(len(a), bool)
    step = np.arange(int(length.max(initial=0)))
    for s in range(0, len(a), 1 << 13):
        x, y, n = a[s : s + (1 << 13), None], b[s : s + (1 << 13), None], length[s : s + (1 << 13), None]
        inside = np.minimum(step, n - 1)
        out[s : s + (1 << 13)] = (data[x + inside] == data[y + inside]).all(axis=1)
    return out


def _anchors(docs: DataFrame) -> DataFrame:
    """(k, c, d, at): pieces that are first in their batch, and with null ``c`` those that are not.

    The latter are spread by a hash of their place; their bytes have been compared with those of an earlier piece. ``c`` is a hash of
    the piece, of another base than its anchor's ``k``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        texts: list[np.ndarray] = []
        size = total = 0

        def settle() -> pa.RecordBatch:
            k, c, d, at, begin = (np.concatenate(x) for x in zip(*found))
            data = np.concatenate(texts)
            found.clear(), texts.clear()
            order = np.lexsort((at, d, c, k))
            k, c, d, at, begin = k[order], c[order], d[order], at[order], begin[order]
            alike = np.concatenate([[False], (k[1:] == k[:-1]) & (c[1:] == c[:-1])])
            pairs = np.flatnonzero(alike)
            length = (at >> 26 & 127) + LENGTH
            same = length[pairs] == length[pairs - 1]
            same[same] = _same_bytes(data, begin[pairs[same]], begin[pairs[same] - 1], length[pairs[same]])
            alike[pairs] = same
            moved = np.concatenate([[False], (d[1:] != d[:-1]) | (at[1:] >> 33 != at[:-1] >> 33)])
            again = alike & moved
            for i in np.flatnonzero(alike & ~moved):  # rows of one key and text share their piece's fate
                again[i] = again[i - 1]
            k = np.where(again, _mixed(d.astype(np.uint64) * BASES[0] ^ at.astype(np.uint64)), k)
            return pa.RecordBatch.from_arrays(
                [pa.array(k.view(np.int64)), pa.array(c.view(np.int64), mask=again), pa.array(d), pa.array(at)], names=["k", "c", "d", "at"]
            )

        for batch in batches:
            for d, row, text in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                data = np.frombuffer(text.encode(), np.uint8) if text else np.empty(0, np.uint8)
                if len(data) < LENGTH:
                    continue
                start, more, k, c = pieces_of(data)
                found.append((k, c, np.full(len(k), d), _packed(start, more, np.int64(row)), start + total))
                texts.append(data)
                size, total = size + len(k), total + len(data)
                if size > SETTLED:
                    yield settle()
                    size = total = 0
        if found:
            yield settle()

    return docs.select("d", "row", "text").mapInArrow(lean(run), "k long, c long, d long, at long")


# --- the suffix sort


def _agree(text: Prefixes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes two suffixes have in common, LENGTH at most: binary search on prefix hashes."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), LENGTH)
    full = text.of(a, LENGTH) == text.of(b, LENGTH)
    low[full] = LENGTH
    open_ = np.flatnonzero(~full)
    high[open_] = LENGTH - 1
    while len(open_):
        middle = (low[open_] + high[open_] + 1) // 2
        same = text.of(a[open_], middle) == text.of(b[open_], middle)
        low[open_[same]] = middle[same]
        high[open_[~same]] = middle[~same] - 1
        open_ = open_[low[open_] < high[open_]]
    return low


def _before(data: np.ndarray, text: Prefixes, rank: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether suffix a sorts before suffix b: the first byte in which they differ decides, equal ones go by their rank."""
    agree = _agree(text, at[a], at[b])
    equal = agree == LENGTH
    step = np.minimum(agree, LENGTH - 1)
    return np.where(equal, rank[a] < rank[b], data[at[a] + step] < data[at[b] + step])


def sort_suffixes(data: np.ndarray, at: np.ndarray, bucket: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Order of the suffixes ``at`` inside their buckets: a bottom-up mergesort of all buckets at once.

    In each round every suffix finds its place in the neighbouring run by binary search; a round handles all suffixes of buckets
    still longer than a run side by side.
    """
    text = Prefixes(data)
    order = np.lexsort((rank, bucket))
    edges = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]]))
    sizes = np.diff(np.concatenate([edges, [len(order)]]))
    first, size = np.repeat(edges, sizes), np.repeat(sizes, sizes)
    run = 1
    while True:
        live = np.flatnonzero(size > run)
        if not len(live):
            return order
        inside = live - first[live]
        mine = inside // run
        other = (mine ^ 1) * run  # the neighbouring run, cut at the bucket's end
        low, high = np.minimum(other, size[live]), np.minimum(other + run, size[live])
        start = low.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) // 2
            there = order[first[live[open_]] + middle]
            here = order[live[open_]]
            earlier = _before(data, text, rank, at, there, here)
            low[open_[earlier]] = middle[earlier] + 1
            high[open_[~earlier]] = middle[~earlier]
            open_ = open_[low[open_] < high[open_]]
        place = first[live] + np.minimum(mine, mine ^ 1) * run + (inside - mine * run) + (low - start)
        moved = order.copy()
        moved[place] = order[live]
        order = moved
        run *= 2


def repeated(data: np.ndarray, at: np.ndarray, bucket: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which suffixes equal, over LENGTH bytes, one of their bucket with a smaller rank. Bytes confirm what the hashes say."""
    order = sort_suffixes(data, at, bucket, rank)
    text = Prefixes(data)
    a, b = order[:-1], order[1:]
    near = np.flatnonzero(bucket[a] == bucket[b])
    near = near[text.of(at[a[near]], LENGTH) == text.of(at[b[near]], LENGTH)]
    windows = sliding_window_view(data, LENGTH)
    false: set[int] = set()
    for s in range(0, len(near), 1 << 16):
        part = near[s : s + (1 << 16)]
        wrong = (windows[at[a[part]]] != windows[at[b[part]]]).any(axis=1)
        false.update(bucket[a[part[wrong]]].tolist())
    out = np.zeros(len(at), bool)
    joined = np.zeros(len(order), bool)
    joined[near + 1] = True
    head = np.maximum.accumulate(np.where(joined, 0, np.arange(len(order))))
    out[order] = joined & (rank[order] > rank[order[head]])
    for x in false:  # a collision: this bucket by its bytes
        first: dict[bytes, int] = {}
        members = np.flatnonzero(bucket == x)
        for i in members[np.argsort(rank[members], kind="stable")].tolist():
            out[i] = rank[i] > first.setdefault(windows[at[i]].tobytes(), rank[i])
    return out


def _runs(d: np.ndarray, start: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Window starts put together to runs: (d, at)."""
    order = np.lexsort((start, row, d))
    d, start, row = d[order], start[order], row[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)])
    edge = np.flatnonzero(new)
    length = np.diff(np.concatenate([edge, [len(d)]]))
    at = [(_packed(start[edge] + s, np.minimum(length - s, 128) - 1, row[edge]), d[edge], length > s) for s in range(0, int(length.max(initial=0)), 128)]
    return (np.concatenate([x[1][x[2]] for x in at]), np.concatenate([x[0][x[2]] for x in at])) if at else (d, start)


def _eight(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on, as a number."""
    out = np.zeros(len(at), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | data[at + i]
    return out


def _sorted_edges(pieces: DataFrame) -> DataFrame:
    """(d, at, window, start, row): with null ``window`` runs to remove; else windows of hot anchors, the first of their chunk."""

    def sort(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        group, hot, d, at, body = (list(x) for x in zip(*rows))
        data = np.frombuffer(b"".join(body), np.uint8)
        d, at, group, hot = np.array(d, np.int64), np.array(at, np.int64), np.array(group), np.array(hot)
        length = np.fromiter(map(len, body), np.int64, len(body))
        begin, count = np.cumsum(length) - length, length - LENGTH + 1
        piece = np.repeat(np.arange(len(body)), count)
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start, row = (at >> 33)[piece] + inside, (at & ((1 << 26) - 1))[piece]
        # equal windows hold their anchor at the same place, so the bucket is the anchor and that place
        bucket = group[piece] * 128 + ((np.array(offsets_of(body, length))[piece] - inside) & 127)
        # so are their first and last bytes: what is left in a bucket is mostly equal
        head, tail = (_eight(data, begin[piece] + inside + s) for s in (0, LENGTH - 8))
        order = np.lexsort((tail, head, bucket))
        changed = (np.diff(bucket[order]) != 0) | (head[order][1:] != head[order][:-1]) | (tail[order][1:] != tail[order][:-1])
        bucket[order] = np.concatenate([[0], np.cumsum(changed)])
        del head, tail
        order = np.lexsort((start, d[piece]))
        place = np.concatenate([[0], np.cumsum((np.diff(d[piece][order]) != 0) | (np.diff(start[order]) != 0))])
        rank = np.empty(len(order), np.int64)
        rank[order] = place  # windows of the same key and start are equal in rank: neither is earlier
        alone = np.bincount(bucket)[bucket] == 1
        gone = np.zeros(len(bucket), bool)
        some = np.flatnonzero(~alone)
        if len(some):
            gone[some] = repeated(data, (begin[piece] + inside)[some], bucket[some], rank[some])
        rd, rat = _runs(d[piece][gone], start[gone], row[gone])
        n = len(rd)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(rd), pa.array(rat), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=names)
        rest = np.flatnonzero(~gone & hot[piece])
        for s in range(0, len(rest), 1 << 15):
            i = rest[s : s + (1 << 15)]
            w = sliding_window_view(data, LENGTH)[(begin[piece] + inside)[i]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(d[piece][i]), pa.nulls(len(i), pa.int64()), pa.array([x.tobytes() for x in w], pa.binary()), pa.array(start[i]), pa.array(row[i])], names=names
            )

    names = ["d", "at", "window", "start", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group, last, size = -1, None, 0
        for batch in batches:
            for k, chunk, hot, d, at, body in zip(*[batch.column(i).to_pylist() for i in range(6)]):
                if (k, chunk) != last:
                    if size > SORTED:  # whole groups of about so many bytes at a time
                        yield from sort(held)
                        held, size, group = [], 0, -1
                    last, group = (k, chunk), group + 1
                held.append((group, hot, d, at, body))
                size += len(body)
        if held:
            yield from sort(held)

    return pieces.select("k", "chunk", "hot", "d", "at", "body").mapInArrow(lean(run), "d long, at long, window binary, start long, row long")


def offsets_of(body: list[bytes], length: np.ndarray) -> list[int]:
    """Where the anchor lies in each piece: the gram of least hash of its first window."""
    data = np.frombuffer(b"".join(body), np.uint8)
    grams = _mixed(Prefixes(data).of(np.arange(len(data) - GRAM + 1), GRAM)) & ~np.uint64((1 << 24) - 1)
    begin = np.cumsum(length) - length
    return grams[begin[:, None] + np.arange(SPAN)].argmin(axis=1).tolist()


def _confirmed(squeezed: DataFrame, claims: DataFrame) -> DataFrame:
    """``claims`` (k, c, d, at, late, single) with ``same``: whether the bytes of the piece are those of its group's first."""
    wanted = claims.groupBy("d").agg(F.collect_list(F.struct("at", "k", "c", "late", "single")).alias("wanted"))  # of one document
    names = ["k", "c", "d", "at", "late", "single", "body"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        types = (*[pa.int64()] * 4, pa.bool_(), pa.bool_(), pa.binary())
        for batch in batches:
            out: list[tuple] = []
            for d, row, z, pieces in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                raw = unpack(z)
                for p in pieces:
                    at = p["at"]
                    if at & ((1 << 26) - 1) == row:
                        s = at >> 33
                        out.append((p["k"], p["c"], d, at, p["late"], p["single"], raw[s : s + (at >> 26 & 127) + LENGTH]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, first = None, b""
        for batch in batches:
            same = []
            for k, c, body in zip(*[batch.column(i).to_pylist() for i in (0, 1, 6)]):
                if (k, c) != group:
                    group, first = (k, c), body
                same.append(body == first)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(same, pa.bool_())], names=[*names[:6], "same"])

    plain = "k long, c long, d long, at long, late boolean, single boolean"
    bodies = squeezed.select("d", "row", "z").join(wanted, "d").select("d", "row", "z", "wanted").mapInArrow(lean(cut), f"{plain}, body binary")
    return bodies.repartition("k", "c").sortWithinPartitions("k", "c", "d", "at").mapInArrow(lean(compare), f"{plain}, same boolean")


def covered(docs: DataFrame) -> DataFrame:
    """(d, row, gone): per document with anything to remove the packed runs of window starts. ``docs`` has d, row and text."""
    settled = _anchors(docs).repartition("k").sortWithinPartitions("k", "c", "d", "at")
    anchor, content = Window.partitionBy("k"), Window.partitionBy("k", "c")
    here = F.struct("d", F.shiftright("at", 33))
    seen = (
        settled.withColumn("low", F.min("c").over(anchor)).withColumn("high", F.max("c").over(anchor))
        .withColumn("first", F.first(here).over(content.orderBy("d", "at").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("claim", F.col("c").isNotNull() & (F.max(here).over(content) != F.min(here).over(content)))
        .withColumn("single", F.col("low") == F.col("high"))
        .filter(F.col("c").isNull() | F.col("claim") | ~F.col("single"))
        .select("d", "at", "k", "c", "claim", "single", (F.col("first") != here).alias("late"))
    )
    seen = written(seen, "suffix-pieces")
    squeezed = written(_squeezed(docs), "suffix-texts")
    checked = written(_confirmed(squeezed, seen.filter("claim").select("k", "c", "d", "at", "late", "single").distinct()), "suffix-checked")
    false = checked.filter("late and not same").select("k").distinct()  # hashes equal, bytes not: the whole anchor is sorted
    alone = seen.filter("c is not null and not claim").select("d", "at", "k")
    kept = checked.filter("not late or not same").select("d", "at", "k", "single")
    edges = alone.unionByName(kept.filter("not single").drop("single")).unionByName(kept.filter("single").join(false, "k", "left_semi").select("d", "at", "k"))
    crowd = edges.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(f"n > {HOT}")
    edges = edges.join(crowd, "k", "left").withColumn("chunk", F.when(F.col("n").isNotNull(), F.pmod(F.xxhash64("d", "at"), F.ceil(F.col("n") / HOT))).otherwise(F.lit(0)).cast("int"))
    wanted = edges.groupBy("d").agg(F.collect_list(F.struct("at", "k", "chunk", F.col("n").isNotNull().alias("hot"))).alias("wanted"))  # of one document

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, unpack = ["k", "chunk", "hot", "d", "at", "body"], zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out: list[tuple] = []
            for d, row, z, pieces in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                raw = unpack(z)
                for p in pieces:
                    at = p["at"]
                    if at & ((1 << 26) - 1) == row:
                        s = at >> 33
                        out.append((p["k"], p["chunk"], p["hot"], d, at, raw[s : s + (at >> 26 & 127) + LENGTH]))
            if out:
                types = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    bodies = squeezed.join(wanted, "d").select("d", "row", "z", "wanted").mapInArrow(lean(cut), "k long, chunk int, hot boolean, d long, at long, body binary")
    found = written(_sorted_edges(bodies.repartition("k", "chunk").sortWithinPartitions("k", "chunk", "d", "at")), "suffix-found")
    discard(squeezed)
    rivals = found.filter("window is not null")
    first = rivals.groupBy("window").agg(F.min(F.struct("d", "start")).alias("first"))
    late = rivals.join(first, "window").filter(F.struct("d", "start") != F.col("first"))
    late = late.select("d", F.shiftleft("start", 33).bitwiseOR(F.col("row")).alias("at"))
    gone = seen.filter("c is null").select("d", "at").unionByName(checked.filter("late and same").select("d", "at")).unionByName(found.filter("window is null").select("d", "at")).unionByName(late)
    return gone.groupBy("d").agg(F.collect_list("at").alias("gone"))  # runs of one document


def spans(gone: list[int], row: int) -> list[tuple[int, int]]:
    """Maximal removed byte runs of a row."""
    runs = sorted((x >> 33, (x >> 33) + (x >> 26 & 127) + LENGTH) for x in gone if x & ((1 << 26) - 1) == row)
    out: list[tuple[int, int]] = []
    for s, e in runs:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _squeezed(rows: DataFrame) -> DataFrame:
    """The column ``text`` as compressed bytes ``z``: what the joins by document move."""
    at = rows.columns.index("text")
    out = rows.drop("text").withColumn("z", F.lit(None).cast("binary"))
    names = out.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            z = pa.array([pack(t.encode()) for t in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(batch.columns) if i != at], z], names=names)

    return rows.mapInArrow(lean(run), out.schema)


def _keyed(docs: DataFrame, key: str, text: str) -> list:
    mark = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).bitwiseAND(F.lit((1 << 26) - 1))
    return [F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("d"), mark.alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text")]


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes``, ``spans`` (array of start and end bytes removed, maximal) and ``kept`` (binary, what remains).

    Strings are judged on the input: each byte covered by a string of LENGTH bytes that also starts in a document of smaller key, or
    earlier in the same one, goes. Matches do not cross documents. A null text is empty, a null key smaller than all others. Of
    rows that share a key none is earlier than the other at the same start; rows equal in key and text get the same result.
    Columns named like the new ones are replaced.
    """
    rest = [c for c in docs.columns if c not in ("n_bytes", "spans", "kept")]
    found = covered(docs.select(*_keyed(docs, key, text)))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest if c != text] or [F.lit(1).alias("_none")]).alias("_row"), *_keyed(docs, key, text), F.col(text).isNull().alias("empty"))
    joined = _squeezed(rows).join(found, "d", "left").select("_row", "row", "z", "gone", "empty")
    schema = rows.select("_row", "text", "empty").schema.add("n_bytes", T.LongType()).add("spans", T.ArrayType(SPAN_TYPE)).add("kept", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            size, cuts, kept, texts = [], [], [], []
            for row, z, gone in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)]):
                raw = unpack(z)
                texts.append(raw)
                found = spans(gone, row) if gone else []
                ends = [0, *[e for _, e in found]]
                size.append(len(raw)), cuts.append([{"start": s, "end": e} for s, e in found])
                kept.append(b"".join([raw[a:b] for a, b in zip(ends, [*[s for s, _ in found], len(raw)])]) if found else raw)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), batch.column(4), pa.array(size, pa.int64()), pa.array(cuts, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                names=["_row", "text", "empty", "n_bytes", "spans", "kept"],
            )

    out = joined.mapInArrow(lean(run), schema)
    return out.select(*[F.when(~F.col("empty"), F.col("text")).alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in rest], "n_bytes", "spans", "kept")


def with_text(cleaned: DataFrame, text: str = "text") -> DataFrame:
    """``cleaned`` with the kept bytes as ``text`` where anything was cut; bytes that are no whole character, left at a cut, are dropped."""
    at, cut, body = (cleaned.columns.index(c) for c in (text, "spans", "kept"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 1000):
                part = batch.slice(s, 1000)
                texts = [b.decode("utf-8", "ignore") if found else t for t, found, b in zip(*[part.column(i).to_pylist() for i in (at, cut, body)])]
                columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return cleaned.mapInArrow(lean(run), cleaned.schema)


def digest_columns(cleaned: DataFrame, key: str = "doc_id") -> DataFrame:
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return cleaned.select(key, "n_bytes", size.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def brute_force(texts: list[tuple[int, bytes]]) -> dict[int, list[tuple[int, int]]]:
    """The removed runs by definition; for tests."""
    seen: set[bytes] = set()
    out = {}
    for d, raw in sorted(texts):
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - LENGTH + 1):
            w = raw[s : s + LENGTH]
            if w in seen:
                gone[s : s + LENGTH] = True
            seen.add(w)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
        out[d] = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
    return out

