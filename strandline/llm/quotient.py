"""Exact duplicates by counting quotient filters: which fingerprints occur more than once, and which of their texts are equal.

A counting quotient filter splits a fingerprint into a quotient, which names its home slot, and a remainder, which is stored. The
remainders of one quotient lie side by side in ascending order (a run), a run that finds its home taken moves right, and three
bits per slot tell which slots are homes in use, which end a run and which hold digits of the count of the remainder before them. So a
filter read from left to right gives its fingerprints in ascending order with exact counts, and filters merge without loss: equal
remainders meet in the merge and their counts add up. A fingerprint of a third of all rows costs a slot and the digits of its count.

Each task builds filters of its own rows, one per block of the fingerprint range; a task merges the filters of one block. Only
rows whose fingerprint is counted more than once are compared by their bytes; all others are alone without being moved.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import written

BLOCK_ROWS = 1 << 19  # rows per block of the fingerprint range, on average
FILL = 0.85  # slots in use of a filter at most, before runs that pass its end
BROADCAST_ROWS = 1 << 20  # rows of 16 bytes that are sent to every task at most
ROWS_A_FILTER = 1 << 20  # fingerprints that a task holds before it writes their filters


def _spread(remainders: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bytes of each number."""
    return remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]


def _gathered(raw: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, : raw.shape[1]] = raw
    return wide.reshape(-1).view("<u8").astype(np.uint64)


def pack(prints: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """The filter of distinct ascending fingerprints below 2**bits with their counts. An empty set gives an empty filter."""
    n = len(prints)
    if not n:
        return b""
    quotient_bits = min(bits, max(0, int(np.ceil(np.log2(n / FILL)))))
    rest = bits - quotient_bits
    width = max(1, (rest + 7) // 8)
    home = (prints >> np.uint64(rest)).astype(np.int64) if rest < 64 else np.zeros(n, np.int64)
    remainder = prints & np.uint64((1 << rest) - 1)
    extra = (counts - 1).astype(np.uint64)  # digits of the count less one, in base 256 ** width, least first
    digits = np.zeros(n, np.int64)
    left = extra.copy()
    while left.any():
        digits += left > 0
        left = left >> np.uint64(8 * width) if width < 8 else np.zeros(n, np.uint64)
    size = 1 + digits
    ahead = np.cumsum(size) - size
    slot = ahead + np.maximum.accumulate(home - ahead)  # its home, or the first slot after the remainder before it
    slots = int(max(slot[-1] + size[-1], 1 << quotient_bits))
    body, count_bit, home_bit, end_bit = np.zeros((slots, width), np.uint8), np.zeros(slots, bool), np.zeros(slots, bool), np.zeros(slots, bool)
    body[slot] = _spread(remainder, width)
    for k in range(int(digits.max(initial=0))):
        has = digits > k
        digit = extra[has] >> np.uint64(8 * width * k)
        body[slot[has] + 1 + k] = _spread(digit, width)
        count_bit[slot[has] + 1 + k] = True
    home_bit[home] = True
    last = np.append(home[1:] != home[:-1], True)
    end_bit[(slot + size - 1)[last]] = True
    flags = [np.packbits(b).tobytes() for b in (home_bit, end_bit, count_bit)]
    return struct.pack("<QBBB", slots, bits, rest, width) + b"".join(flags) + body.tobytes()


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ascending fingerprints of a filter and their counts."""
    if not packed:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    slots, _, rest, width = struct.unpack_from("<QBBB", packed)
    at, flags = struct.calcsize("<QBBB"), []
    for _ in range(3):
        flags.append(np.unpackbits(np.frombuffer(packed, np.uint8, (slots + 7) // 8, at), count=slots).astype(bool))
        at += (slots + 7) // 8
    homes, ends, counting = np.flatnonzero(flags[0]), np.flatnonzero(flags[1]), flags[2]
    body = np.frombuffer(packed, np.uint8, slots * width, at).reshape(slots, width)
    begins = np.maximum(homes, np.append(0, ends[:-1] + 1))  # the k-th end closes the run of the k-th home
    lengths = ends - begins + 1
    used = np.arange(lengths.sum()) + np.repeat(begins - (np.cumsum(lengths) - lengths), lengths)
    quotient = np.repeat(homes, lengths)
    stored, digit = _gathered(body[used]), counting[used]
    heads = np.flatnonzero(~digit)
    prints = stored[heads] | (quotient[heads].astype(np.uint64) << np.uint64(rest) if rest < 64 else np.uint64(0))
    counts = np.ones(len(heads), np.int64)
    owner = np.cumsum(~digit) - 1
    place = np.arange(len(used)) - heads[owner] - 1
    for k in range(int(place[digit].max(initial=-1)) + 1):
        mine = digit & (place == k)
        counts[owner[mine]] += (stored[mine] << np.uint64(8 * width * k)).astype(np.int64)
    return prints, counts


def merge(filters: list[bytes], bits: int) -> bytes:
    """The filter of all rows of the given filters: sorted remainders meet, counts of equal ones add up."""
    if not filters:
        return b""
    read = [unpack(f) for f in filters]
    return pack(*_added(np.concatenate([p for p, _ in read]), np.concatenate([c for _, c in read])), bits)


def _added(prints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(prints):
        return prints, counts
    order = np.argsort(prints, kind="stable")  # a merge of ascending stretches
    prints, counts = prints[order], counts[order]
    first = np.flatnonzero(np.append(True, prints[1:] != prints[:-1]))
    return prints[first], np.add.reduceat(counts, first)


def block_bits(rows: int) -> int:
    """How many leading bits of a fingerprint name its block, so that a block has about BLOCK_ROWS rows."""
    return max(0, (rows // BLOCK_ROWS).bit_length())


def filters(prints: DataFrame, blocks: int, bits: int = 64) -> DataFrame:
    """(block, part, filter): the filters of rows (part, fp), per block of the fingerprint range, each of rows of one part.

    ``blocks`` leading bits of the ``bits`` of a fingerprint name its block. A part may give several filters of a block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(part: int, held: list[np.ndarray]) -> pa.RecordBatch:
            found, counts = np.unique(np.concatenate(held), return_counts=True)
            block = (found >> np.uint64(bits - blocks)).astype(np.int64) if blocks else np.zeros(len(found), np.int64)
            cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            inner = found & np.uint64((1 << (bits - blocks)) - 1)
            made = [pack(inner[s:e], counts[s:e], bits - blocks) for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(found)])]
            columns = [pa.array(block[cuts], pa.int64()), pa.array([part] * len(cuts), pa.int64()), pa.array(made, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["block", "part", "filter"])

        part, held, size = None, [], 0
        for batch in batches:
            parts, values = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
            for s, e in zip(cuts[:-1], cuts[1:]):
                if s == e:
                    continue
                if held and (parts[s] != part or size >= ROWS_A_FILTER):
                    yield emit(part, held)
                    held, size = [], 0
                part = int(parts[s])
                held.append(values[s:e])
                size += e - s
        if held:
            yield emit(part, held)

    return prints.select("part", "fp").mapInArrow(run, "block long, part long, filter binary")


def _by_block(made: DataFrame, step, schema: str) -> DataFrame:
    """``step(block, parts, filters)`` gives a batch for all filters of a block, which are in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, held = None, [], []
        for batch in batches:
            for b, part, packed in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if held and b != block:
                    yield step(block, parts, held)
                    parts, held = [], []
                block = b
                parts.append(part), held.append(packed)
        if held:
            yield step(block, parts, held)

    grouped = made.repartition("block").sortWithinPartitions("block", "part")
    return grouped.mapInArrow(run, schema)


def merged(made: DataFrame, blocks: int, bits: int = 64) -> DataFrame:
    """(block, filter): one filter of all rows per block."""

    def step(block: int, parts: list[int], held: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([merge(held, bits - blocks)], pa.binary())], names=["block", "filter"])

    return _by_block(made, step, "block long, filter binary")


def repeated(made: DataFrame, blocks: int, bits: int = 64) -> DataFrame:
    """(part, fp): the fingerprints counted more than once over all parts, once for each part that has them.

    A fingerprint of very many rows comes once per part, so a join by both columns spreads its rows as their parts are spread.
    """

    def step(block: int, parts: list[int], held: list[bytes]) -> pa.RecordBatch:
        all_prints, all_counts = unpack(merge(held, bits - blocks))
        often = all_prints[all_counts > 1]
        out_parts, out_prints = [], []
        for part, packed in zip(parts, held):
            mine = np.intersect1d(unpack(packed)[0], often, assume_unique=True)
            out_parts.append(np.full(len(mine), part, np.int64))
            out_prints.append(mine | np.uint64(block << (bits - blocks)))
        columns = [pa.array(np.concatenate(out_parts)), pa.array(np.concatenate(out_prints).view(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=["part", "fp"])

    return _by_block(made, step, "part long, fp long").distinct()


def fingerprinted(docs: DataFrame, key: str, text: str, bits: int = 64) -> DataFrame:
    """(k, row, part, fp, sha, t): t is the text with A-Z in lower case, fp its hash, row a number of the row, part the task that read it."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("t"))
    keep = np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = pc.ascii_lower(pc.fill_null(batch.column(2), ""))
            prints, shas = [], []
            for t in plain:
                raw = t.as_buffer()
                prints.append(xxhash.xxh3_64_intdigest(raw))
                shas.append(hashlib.sha256(raw).hexdigest())
            fp = (np.array(prints, np.uint64) & keep).view(np.int64)
            row = batch.column(1).to_numpy()
            columns = [batch.column(0), batch.column(1), pa.array(row >> 33), pa.array(fp), pa.array(shas, pa.string()), plain]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "row", "part", "fp", "sha", "t"])

    return rows.mapInArrow(run, f"k {kind}, row long, part long, fp long, sha string, t string")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if its rows, counted, are few; else Spark joins by shuffle and splits skewed keys."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _last(k: str, row: str) -> Column:
    """The row with the largest key, null least; of rows of equal key the last read."""
    return F.max(F.struct(F.col(k).isNotNull(), F.col(k), F.col(row)))


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", *, bits: int = 64) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256): per row the key of the row that stays of those with an equal text.

    Texts are equal if identical after lower-casing A-Z; the row with the largest key stays. A null text counts as empty. A null key is
    less than all others, and keep_id is null where all rows of a group have none. Of repeated rows of that largest key exactly one,
    the last one read, is kept. An empty table gives an empty table; other columns of docs are not read.

    ``bits``: width of fingerprints. Fewer bits find more candidates, never other groups: candidates are compared by their bytes.
    """
    rows = written(fingerprinted(docs, key, text, bits), "quotient-rows")
    blocks = min(block_bits(rows.count()), bits - 1)
    often = written(repeated(filters(rows, blocks, bits), blocks, bits), "quotient-often")
    # bytes decide: copies are put together before the shuffle, and texts that met no equal fingerprint are not moved
    suspects = rows.join(_small(often), ["part", "fp"])
    groups = suspects.groupBy("fp", "t").agg(F.count(F.lit(1)).alias("n"), _last("k", "row").alias("last"), F.first("sha").alias("sha"))
    groups = written(groups.select("fp", "sha", F.md5("t").alias("m"), F.col("last.k").alias("keep"), F.col("last.row").alias("keep_row"), "n"), "quotient-groups")
    # a fingerprint with one text needs no text to name the group; one with several tells them by both digests
    alone = groups.groupBy("fp").agg(F.count(F.lit(1)).alias("texts"), F.min(F.struct("keep", "keep_row", "n")).alias("g"))
    named = often.join(alone.filter("texts = 1").select("fp", "g.*"), "fp")
    slim = rows.select("k", "row", "part", "fp", "sha")
    found = slim.join(_small(written(named, "quotient-named")), ["part", "fp"], "left")
    several = alone.filter("texts > 1").select("fp")
    mixed = written(groups.join(several, "fp", "left_semi"), "quotient-mixed")
    if mixed.isEmpty():
        found = found.select("k", "row", "sha", "keep", "keep_row", "n")
    else:
        other = mixed.select(F.col("fp").alias("_fp"), F.col("sha").alias("_sha"), "m", F.col("keep").alias("_keep"), F.col("keep_row").alias("_row"), F.col("n").alias("_n"))
        clash = rows.join(F.broadcast(other.select("_fp").distinct()) if mixed.count() <= BROADCAST_ROWS else other.select("_fp").distinct(), F.col("fp") == F.col("_fp"), "left_semi")
        told = clash.select("row", "fp", "sha", F.md5("t").alias("_m")).join(other, (F.col("fp") == F.col("_fp")) & (F.col("sha") == F.col("_sha")) & (F.col("_m") == F.col("m")))
        told = told.select(F.col("row").alias("_at"), "_keep", "_row", "_n")
        found = found.join(told, found.row == told._at, "left").select(
            "k", "row", "sha", F.when(F.col("_n").isNull(), F.col("keep")).otherwise(F.col("_keep")).alias("keep"),
            F.coalesce("_row", "keep_row").alias("keep_row"), F.coalesce("_n", "n").alias("n"),
        )
    lone = F.col("n").isNull()
    return found.select(
        F.col("k").alias(key), F.when(lone, F.col("k")).otherwise(F.col("keep")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (lone | (F.col("row") == F.col("keep_row"))).alias("kept"), F.col("sha").alias("text_sha256"),
    )
