"""Media columns in FLAC: mono PCM written as frames and read back with every checksum verified.

All work is done on many frames side by side: one NumPy operation handles the same sample of every frame of a batch.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 576  # samples of a frame
RATE = 8000
FRAMES = 2048  # frames of one side-by-side batch, about 1.2 million samples
ORDERS = 5  # fixed predictors 0 to 4 are read
TRIED = 3  # and 0 to 2 are written: text gains nothing from more


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        out = np.where(out >> (bits - 1) & 1, (out << 1) ^ poly, out << 1) & ((1 << bits) - 1)
    return out


CRC8, CRC16 = _crc_table(0x07, 8).astype(np.uint8), _crc_table(0x8005, 16).astype(np.uint16)
_REACH: dict[int, np.ndarray] = {}


def _reach(length: int) -> np.ndarray:
    """What a byte adds to a CRC-16 when so many bytes follow it: the checksum is linear, so a frame's is the XOR of its bytes'."""
    size = 1 << max(10, (length - 1).bit_length())
    if size not in _REACH:
        rows = np.empty((size, 256), np.uint16)
        rows[0] = CRC16
        for i in range(1, size):
            rows[i] = (rows[i - 1] << np.uint16(8)) ^ CRC16[rows[i - 1] >> np.uint16(8)]
        _REACH[size] = rows
    return _REACH[size]


def crc16(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksum of each stretch of ``data``."""
    if not len(start):
        return np.empty(0, np.uint16)
    reach = _reach(int(length.max()))
    ends = np.cumsum(length)
    inside = np.arange(ends[-1]) - np.repeat(ends - length, length)
    left = np.repeat(length, length) - 1 - inside
    terms = reach[left, data[np.repeat(start, length) + inside]]
    return np.bitwise_xor.reduceat(terms, ends - length)


def _number(n: int) -> bytes:
    """A frame's number in the format's UTF-8-like code."""
    if n < 0x80:
        return bytes([n])
    parts = []
    size = next(s for s in range(2, 8) if n < 1 << (5 * s + 1))
    for _ in range(size - 1):
        parts.append(0x80 | n & 0x3F)
        n >>= 6
    return bytes([(0xFF << (8 - size)) & 0xFF | n, *reversed(parts)])


_HEADS: dict[int, bytes] = {}


def _head(n: int) -> bytes:
    """Frame header: fixed block size 576, 8 kHz, mono, 8 bits, with its CRC-8."""
    if n not in _HEADS:
        raw = b"\xff\xf8" + bytes([0x24, 0x02]) + _number(n)
        crc = 0
        for b in raw:
            crc = int(CRC8[crc ^ b])
        if len(_HEADS) > 1 << 16:
            _HEADS.clear()
        _HEADS[n] = raw + bytes([crc])
    return _HEADS[n]


def _stream_head(samples: int, sizes: np.ndarray, payload: bytes) -> bytes:
    """Stream info, and a seek table with the sample offset and byte offset of every frame."""
    info = struct.pack(">HH", BLOCK, BLOCK) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | samples).to_bytes(8, "big") + hashlib.md5(payload).digest()
    points = np.zeros(len(sizes), np.dtype([("sample", ">u8"), ("byte", ">u8"), ("count", ">u2")]))
    points["sample"], points["byte"], points["count"] = np.arange(len(sizes)) * BLOCK, np.cumsum(sizes) - sizes, BLOCK
    seek = points.tobytes()
    return b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek


def encode_frames(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subframes of a matrix (frames x BLOCK) of signed 8-bit samples: their bytes, and how many each has.

    Constant, verbatim or fixed prediction with one Rice parameter, whichever is shortest. Every field is a number that ends at
    a known bit; numbers are shifted into 32-bit lanes, and fields of a lane do not overlap, so their sum is the lane.
    """
    frames = samples.astype(np.int32)
    n = len(frames)
    best = np.full(n, 8 * BLOCK + 8)
    choice, param = np.full(n, -1), np.zeros(n, np.int32)
    still = (frames == frames[:, :1]).all(axis=1)
    best[still], choice[still] = 16, -2
    residual, kept = frames, []
    for order in range(TRIED):
        if order:
            residual = residual[:, 1:] - residual[:, :-1]
        folded = (residual << 1) ^ (residual >> 31)
        kept.append(folded)
        guess = np.log2(np.maximum(folded.mean(axis=1) * 0.7, 1)).astype(np.int32)
        for k in (np.clip(guess, 0, 7), np.clip(guess + 1, 0, 7)):
            bits = 18 + 8 * order + (folded >> k[:, None]).sum(axis=1) + (k + 1) * folded.shape[1]
            better = (bits < best) & ~still
            best[better], choice[better], param[better] = bits[better], order, k[better]
    size = (best + 7) // 8
    offset = (np.cumsum(size) - size) * 8
    lanes = np.zeros(-(-int(size.sum()) // 4) + 1)

    def put(end: np.ndarray, value: np.ndarray) -> None:
        last = end.reshape(-1) - 1
        shifted = value.reshape(-1).astype(np.int64) << (31 - (last & 31))
        lane = last >> 5
        lanes[:] += np.bincount(lane, shifted & 0xFFFFFFFF, len(lanes))
        over = np.flatnonzero(shifted >> 32)
        lanes[:] += np.bincount(lane[over] - 1, shifted[over] >> 32, len(lanes))

    def every(rows: np.ndarray, count: int) -> np.ndarray:
        return (offset[rows] + 16)[:, None] + 8 * np.arange(count)

    plain, flat = np.flatnonzero(choice == -1), np.flatnonzero(choice == -2)
    put(every(flat, 1), frames[flat, :1] & 0xFF)
    put(offset[plain] + 8, np.full(len(plain), 0x02))
    put(every(plain, BLOCK), frames[plain] & 0xFF)
    for order in range(TRIED):
        rows = np.flatnonzero(choice == order)
        if not len(rows):
            continue
        k = param[rows]
        put(offset[rows] + 8, np.full(len(rows), (8 | order) << 1))
        put(every(rows, order), frames[rows, :order] & 0xFF)
        start = offset[rows] + 18 + 8 * order
        put(start, k)  # two bits of method and four of partition order are zero
        codes = kept[order][rows]
        ends = start[:, None] + np.cumsum((codes >> k[:, None]) + (k + 1)[:, None], axis=1)
        put(ends, (codes & ((1 << k) - 1)[:, None]) | (1 << k)[:, None])
    return lanes.astype(">u4").view(np.uint8), size


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of BLOCK unsigned 8-bit samples) as a FLAC stream."""
    counts = np.array([len(p) // BLOCK for p in payloads])
    samples = (np.frombuffer(b"".join(payloads), np.uint8).astype(np.int16) - 128).astype(np.int8).reshape(-1, BLOCK)
    bodies: list[bytes] = []
    for start in range(0, len(samples), FRAMES):
        packed, sizes = encode_frames(samples[start : start + FRAMES])
        raw, ends = packed.tobytes(), np.cumsum(sizes).tolist()
        bodies += [raw[a:b] for a, b in zip([0, *ends[:-1]], ends)]
    out, at = [], 0
    for payload, count in zip(payloads, counts.tolist()):
        frames = [_head(i) + body for i, body in enumerate(bodies[at : at + count])]
        at += count
        sizes = np.fromiter(map(len, frames), np.int64, count)
        joined = np.frombuffer(b"".join(frames), np.uint8)
        crc = crc16(joined, np.cumsum(sizes) - sizes, sizes)
        body = b"".join(f + int(c).to_bytes(2, "big") for f, c in zip(frames, crc.tolist()))
        out.append(_stream_head(count * BLOCK, sizes + 2, payload) + body)
    return out


class Bits:
    """Bit readers over one byte array, one position per frame."""

    def __init__(self, words: np.ndarray, at: np.ndarray) -> None:
        self.words, self.at = words, at.astype(np.int64)

    @staticmethod
    def over(data: np.ndarray) -> np.ndarray:
        """The four bytes from each byte on, as one number."""
        pad = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
        n = len(data) + 4
        words = (pad[:n] << np.uint32(24)) | (pad[1 : n + 1] << np.uint32(16)) | (pad[2 : n + 2] << np.uint32(8)) | pad[3 : n + 3]
        return words

    def peek(self, rows: np.ndarray | slice) -> np.ndarray:
        """The next 25 bits, at the top of a 32-bit word."""
        at = self.at[rows]
        return self.words[np.minimum(at >> 3, len(self.words) - 1)] << (at & 7).astype(np.uint32)

    def take(self, rows: np.ndarray | slice, width: np.ndarray | int) -> np.ndarray:
        """Unsigned numbers of up to 24 bits."""
        width = np.asarray(width)
        value = np.where(width > 0, self.peek(rows) >> (32 - np.maximum(width, 1)).astype(np.uint32), 0).astype(np.int64)
        self.at[rows] += width
        return value

    def signed(self, rows: np.ndarray | slice, width: np.ndarray | int) -> np.ndarray:
        value = self.take(rows, width)
        return np.where(value >= 1 << (np.maximum(width, 1) - 1), value - (1 << np.asarray(width, np.int64)), value)

    def unary(self, rows: np.ndarray) -> np.ndarray:
        """Zeros before the next one, which is passed."""
        count = np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            top = self.peek(rows[todo]) >> np.uint32(8)  # 24 bits
            exponent = (top.astype(np.float64).view(np.int64) >> 52) - 1023  # floor of the binary logarithm, exact for 24 bits
            zeros = np.where(top > 0, 23 - exponent, 24)
            count[todo] += zeros
            self.at[rows[todo]] += zeros + (top > 0)
            todo = todo[top == 0]
            if len(todo) and (self.at[rows[todo]] >> 3).max() > len(self.words):
                raise ValueError("the stream ends inside a code")
        return count


def decode_subframes(words: np.ndarray, at: np.ndarray, block: int, depth: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Samples (frames x block) of the mono subframes that start at byte ``at``, and the byte after each.

    Constant, verbatim, fixed and LPC subframes; wasted bits; both Rice methods with partitions and escapes.
    """
    bits, n = Bits(words, at * 8), len(at)
    everything = np.arange(n)
    kind = bits.take(everything, 8)
    wasted = np.zeros(n, np.int64)
    with_waste = np.flatnonzero(kind & 1)
    if len(with_waste):
        wasted[with_waste] = bits.unary(with_waste) + 1
    kind = kind >> 1
    width = depth - wasted
    out = np.zeros((n, block), np.int64)
    constant, verbatim = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
    fixed, lpc = (kind >= 8) & (kind <= 12), kind >= 32
    if not (fixed | lpc | (kind <= 1)).all():
        raise ValueError("a reserved subframe type")
    if len(constant):
        out[constant] = bits.signed(constant, width[constant])[:, None]
    for i in range(block if len(verbatim) else 0):
        out[verbatim, i] = bits.signed(verbatim, width[verbatim])
    coded = np.flatnonzero(fixed | lpc)
    if len(coded):
        order = np.where(fixed, kind - 8, kind - 31)[coded]
        for i in range(int(order.max())):
            rows = coded[order > i]
            out[rows, i] = bits.signed(rows, width[rows])
        coefs, shift = np.zeros((len(coded), int(max(1, order.max()))), np.int64), np.zeros(len(coded), np.int64)
        curved = np.flatnonzero(lpc[coded])
        if len(curved):
            precision = bits.take(coded[curved], 4) + 1
            shift[curved] = bits.signed(coded[curved], 5)
            for i in range(int(order[curved].max())):
                has = order[curved] > i
                coefs[curved[has], i] = bits.signed(coded[curved[has]], precision[has])
        residual = _residuals(bits, coded, order, block)
        _restore(out, residual, coded, order, coefs, shift, fixed[coded], block)
    out <<= wasted[:, None]
    return out, (bits.at + 7) // 8


def _residuals(bits: Bits, coded: np.ndarray, order: np.ndarray, block: int) -> np.ndarray:
    """Rice-coded residuals; entry i belongs to sample i, and those before the order stay 0."""
    method = bits.take(coded, 2)
    if (method > 1).any():
        raise ValueError("a reserved residual coding")
    parts = 1 << bits.take(coded, 4)
    size = block // parts
    if (size * parts != block).any() or (size < order).any():
        raise ValueError("partitions do not fit the block")
    if (parts == 1).all():
        param = bits.take(coded, np.where(method == 1, 5, 4))
        if (param < np.where(method == 1, 31, 15)).all():
            return _rice_run(bits, coded, param, order, block)
        bits.at[coded] -= np.where(method == 1, 5, 4)
    residual = np.zeros((len(coded), block), np.int64)
    param, raw = np.zeros(len(coded), np.int64), np.full(len(coded), -1)
    for i in range(block):
        rows = np.flatnonzero((order <= i))
        fresh = rows[((i % size[rows]) == 0) | (order[rows] == i)] if i <= int(order.max()) or (i % size == 0).any() else rows[:0]
        if len(fresh):
            wide = np.where(method[fresh] == 1, 5, 4)
            param[fresh] = bits.take(coded[fresh], wide)
            escape = fresh[param[fresh] == (1 << wide) - 1]
            raw[fresh] = -1
            raw[escape] = bits.take(coded[escape], 5)
        rice = rows if not (raw >= 0).any() else rows[raw[rows] < 0]
        if len(rice):
            high = bits.unary(coded[rice])
            code = high << param[rice] | bits.take(coded[rice], param[rice])
            residual[rice, i] = (code >> 1) ^ -(code & 1)
        if len(rice) < len(rows):
            plain = rows[raw[rows] >= 0]
            residual[plain, i] = np.where(raw[plain] > 0, bits.signed(coded[plain], raw[plain]), 0)
    return residual


def _rice_run(bits: Bits, coded: np.ndarray, param: np.ndarray, order: np.ndarray, block: int) -> np.ndarray:
    """The common case, one partition and no escape: code t of every frame in one step, unary part and low bits from one word."""
    at, k, words = bits.at[coded], param.astype(np.uint32), bits.words
    room, low, least = (24 - param).astype(np.int32), np.uint32(32) - k, int(order.min())
    ending = block - int(order.max())
    codes = np.zeros((block - least, len(coded)), np.int64)  # step by step, so that each step writes one stretch
    rows: np.ndarray | slice = slice(None)
    for t in range(block - least):
        if t >= ending:
            rows = np.flatnonzero(order + t < block)
        now = at[rows]
        word = words[now >> 3] << (now & 7).astype(np.uint32)
        exponent = (word >> np.uint32(8)).astype(np.float32).view(np.int32) >> 23
        zeros = 150 - exponent  # of the 24 leading bits; more than there is room for if none is set
        kk = k[rows]
        if (zeros > room[rows]).any():
            bits.at[coded] = at
            live = coded[rows]
            high = bits.unary(live)
            codes[t, rows] = high << param[rows] | bits.take(live, param[rows])
            at = bits.at[coded]
            continue
        rest = np.where(kk > 0, (word << (zeros + 1).astype(np.uint32)) >> np.minimum(low[rows], np.uint32(31)), 0)
        codes[t, rows] = (zeros.astype(np.uint32) << kk) | rest
        at[rows] = now + zeros + 1 + kk
    bits.at[coded] = at
    folded = (codes >> 1) ^ -(codes & 1)
    residual = np.zeros((len(coded), block), np.int64)
    for o in np.unique(order).tolist():
        same = np.flatnonzero(order == o)
        residual[same, o:] = folded[: block - o, same].T
    return residual


def _restore(out, residual, coded, order, coefs, shift, fixed, block) -> None:
    """Adds the predictions: fixed predictors by repeated sums, linear prediction sample by sample over all frames."""
    for o in range(ORDERS):
        rows = np.flatnonzero(fixed & (order == o))
        if not len(rows):
            continue
        head, x = out[coded[rows], :o].copy(), residual[rows, o:]
        for step in range(o, 0, -1):  # x holds differences of degree ``step``; the last one of the head starts the sum
            first = head
            for _ in range(step - 1):
                first = first[:, 1:] - first[:, :-1]
            x = np.cumsum(x, axis=1) + first[:, -1:]
        out[coded[rows], :o], out[coded[rows], o:] = head, x
    rows = np.flatnonzero(~fixed)
    if len(rows):
        x = out[coded[rows]]
        for i in range(block):
            live = np.flatnonzero(order[rows] <= i)
            reach = min(i, coefs.shape[1])
            past = x[live, i - reach : i][:, ::-1]
            x[live, i] = residual[rows[live], i] + ((past * coefs[rows[live], :reach]).sum(axis=1) >> shift[rows[live]])
        out[coded[rows]] = x


def _opened(stream: bytes) -> tuple[int, int, bytes, np.ndarray | None]:
    """First frame's byte, number of frames, MD5, and the byte offset of every frame if the seek table has them all."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, info, seek = 4, False, b"", None
    while not last:
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            info = body
        elif kind == 3:
            seek = np.frombuffer(body, np.dtype([("sample", ">u8"), ("byte", ">u8"), ("count", ">u2")]))
        at += 4 + size
    packed = int.from_bytes(info[10:18], "big")
    if info[:4] != struct.pack(">HH", BLOCK, BLOCK) or packed >> 36 & 0xFF != 7:
        raise ValueError("only mono 8-bit streams of the fixed block size are read")
    count = (packed & (1 << 36) - 1) // BLOCK
    full = seek is not None and len(seek) == count and (seek["sample"] == np.arange(count) * BLOCK).all()
    return at, count, info[18:34], seek["byte"].astype(np.int64) if full else None


def _read_frames(data: np.ndarray, words: np.ndarray, at: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples of the frames at these bytes and the byte after each; their headers and both checksums must be right."""
    heads = [_head(n) for n in numbers.tolist()]
    sizes = np.fromiter(map(len, heads), np.int64, len(heads))
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        want = np.frombuffer(b"".join([heads[r] for r in rows]), np.uint8).reshape(-1, size)
        if (data[np.minimum(at[rows][:, None] + np.arange(size), len(data) - 1)] != want).any():
            raise ValueError("a frame header or its checksum is wrong")
    samples, ends = decode_subframes(words, at + sizes, BLOCK)
    if (ends + 2 > len(data)).any():
        raise ValueError("the stream ends inside a frame")
    want = data[ends].astype(np.uint16) << np.uint16(8) | data[ends + 1]
    if (crc16(data, at, ends - at) != want).any():
        raise ValueError("a frame's checksum is wrong")
    return (samples + 128).astype(np.uint8), ends + 2


def decode_streams(streams: list[bytes]) -> list[bytes]:
    """The unsigned 8-bit payload of each stream; fails if a frame header, a checksum or the MD5 of the samples is wrong.

    With a seek point for every frame all frames are read side by side; without, frame by frame over all streams.
    """
    if not streams:
        return []
    data = np.frombuffer(b"".join(streams), np.uint8)
    words, base = Bits.over(data), np.cumsum([0, *map(len, streams[:-1])])
    opened = [_opened(s) for s in streams]
    counts = np.array([o[1] for o in opened])
    offset = np.cumsum(counts) - counts
    out = np.empty((int(counts.sum()), BLOCK), np.uint8)
    sought = [i for i, o in enumerate(opened) if o[3] is not None]
    if sought:
        at = np.concatenate([base[i] + opened[i][0] + opened[i][3] for i in sought])
        place = np.concatenate([offset[i] + np.arange(counts[i]) for i in sought])
        numbers = np.concatenate([np.arange(counts[i]) for i in sought])
        ends = np.empty(len(at), np.int64)
        for s in range(0, len(at), FRAMES):
            out[place[s : s + FRAMES]], ends[s : s + FRAMES] = _read_frames(data, words, at[s : s + FRAMES], numbers[s : s + FRAMES])
        if (ends[:-1][numbers[1:] > 0] != at[1:][numbers[1:] > 0]).any():
            raise ValueError("the seek table does not fit the frames")
    live = np.array([i for i, o in enumerate(opened) if o[3] is None], np.int64)
    at, frame = base + np.array([o[0] for o in opened]), 0
    while len(live := live[counts[live] > frame]):
        for part in np.array_split(live, -(-len(live) // FRAMES)):
            out[offset[part] + frame], at[part] = _read_frames(data, words, at[part], np.full(len(part), frame))
        frame += 1
    payloads = [out[o : o + c].tobytes() for o, c in zip(offset.tolist(), counts.tolist())]
    if any(hashlib.md5(p).digest() != o[2] for p, o in zip(payloads, opened)):
        raise ValueError("the samples do not match the stream's MD5")
    return payloads


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes, padded with 255 to a positive multiple of BLOCK."""
    raw = (text or "").encode()
    return raw.ljust(max(1, -(-len(raw) // BLOCK)) * BLOCK, b"\xff")


def feature_of(payload: bytes) -> str:
    """Zero crossings, peak, and the energy of eight equal parts of the signal, as integers."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    sign = x >= 0
    energy = (x * x).reshape(8, -1).sum(axis=1)
    return ":".join(map(str, [int((sign[1:] != sign[:-1]).sum()), int(np.abs(x).max()), *energy.tolist()]))


def _chunks(batch: pa.RecordBatch, column: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes in a column, so that one long row or many do not swell the matrices."""
    lengths = [len(x) if x is not None else 0 for x in batch.column(column).to_pylist()]
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > size:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield batch.slice(start)


def _with(batch: pa.RecordBatch, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns[:-1], values], names=batch.schema.names)


def write_media(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``docs`` with the column ``media`` (binary): the padded text as one FLAC stream with a seek point per frame.

    A null text is an empty one: a single frame of padding. Rows do not move. A column already named so is replaced.
    """
    docs = docs.drop(media)
    at = docs.columns.index(text)
    docs = docs.withColumn(media, F.lit(None).cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch, at):
                yield _with(part, pa.array(encode_payloads([payload_of(t) for t in part.column(at).to_pylist()]), pa.binary()))

    return docs.mapInArrow(run, docs.schema)


def read_media(rows: DataFrame, media: str = "media", payload: str = "payload") -> DataFrame:
    """``rows`` with the column ``payload`` (binary): the samples of each stream, null for a null stream; a damaged stream fails."""
    rows = rows.drop(payload)
    at = rows.columns.index(media)
    rows = rows.withColumn(payload, F.lit(None).cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch, at):
                streams = part.column(at).to_pylist()
                found = iter(decode_streams([s for s in streams if s is not None]))
                yield _with(part, pa.array([None if s is None else next(found) for s in streams], pa.binary()))

    return rows.mapInArrow(run, rows.schema)


def pcm_blocks(rows: DataFrame, key: str = "doc_id", media: str = "media", frames: int = 64) -> DataFrame:
    """(key, first_sample, pcm): the samples of each stream in blocks of ``frames`` frames, findable by their sample offset."""
    kind = rows.schema[key].dataType.simpleString()
    size = frames * BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, first, pcm = [], [], []
            have = [(k, m) for k, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if m is not None]
            for (k, _), p in zip(have, decode_streams([m for _, m in have])):
                for s in range(0, len(p), size):
                    keys.append(k), first.append(s), pcm.append(p[s : s + size])
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(first, pa.int64()), pa.array(pcm, pa.binary())], names=[key, "first_sample", "pcm"])

    return rows.select(key, media).mapInArrow(run, f"`{key}` {kind}, first_sample long, pcm binary")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: what was stored and what was read back from the stored stream, as digests and a feature."""
    kind = docs.schema[key].dataType.simpleString()
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    stored = write_media(docs.select(F.col(key).alias("_key"), size.alias("n_bytes"), F.col(text).alias("text"))).select("_key", "n_bytes", "media")
    schema = f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    sha = lambda b: hashlib.sha256(b).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch, 2):
                streams = part.column(2).to_pylist()
                payloads = decode_streams(streams)
                columns = [
                    part.column(0), part.column(1), pa.array([len(p) for p in payloads], pa.int64()), pa.array([sha(p) for p in payloads], pa.string()),
                    pa.array([zlib.crc32(p[-32:]) for p in payloads], pa.int64()), pa.array([len(m) for m in streams], pa.int64()),
                    pa.array([sha(m) for m in streams], pa.string()), pa.array([feature_of(p) for p in payloads], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [key, *[c.split()[0] for c in schema.split(", ")[1:]]]
    return stored.mapInArrow(run, schema)
