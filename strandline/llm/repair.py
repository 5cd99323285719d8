"""Token ids in grammar-compressed files: Re-Pair per shard, with expansion lengths for access to single documents.

A shard file holds a range of documents in ascending order of their key. Its ids are rewritten by rules, each a pair of symbols
that a new symbol stands for; every rule carries the length of its expansion, and every document the place of its first symbol,
so a document is read without decoding those before it.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandline.llm.common import NULL_ID, written
from strandline.llm.ranges import cuts, dealt

END = 1  # closes a document; no rule reaches over it
SHARD_IDS = 1 << 21
SYMBOLS = 1 << 16  # ids and rules together, so that a symbol takes two bytes
LEAST = 12  # a pair is replaced from so many occurrences on
ROUNDS = 8
MAGIC = b"RPG1"
_TABLE = 17  # bits of the lookup of chosen pairs


def compress(ids: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and rules (left, right; rule r is symbol ``first + r``) of a sequence of ids below ``first``.

    A round counts all pairs, turns the most frequent ones into rules, and replaces them from left to right. Pairs that would share
    a slot of the round's lookup wait for the next round.
    """
    s = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    free, base = SYMBOLS - first, first
    for r in range(ROUNDS):
        size = len(s)
        if size < 2 or free <= 0:
            break
        keys = s[:-1] << np.uint32(16)
        keys |= s[1:]
        counted = np.sort(keys)
        edge = np.flatnonzero(counted[1:] != counted[:-1]) + 1
        edge = np.concatenate([[0], edge, [len(counted)]])
        often = np.flatnonzero(edge[1:] - edge[:-1] >= LEAST)
        pairs, count = counted[edge[often]], edge[often + 1] - edge[often]
        inside = (pairs >> np.uint32(16) != END) & (pairs & np.uint32(0xFFFF) != END)
        pairs, count = pairs[inside], count[inside]
        room = free if r == ROUNDS - 1 else max(1, free // 3)  # later rounds see longer phrases, so some room is left for them
        best = pairs[np.lexsort((pairs, -count))[:room]]
        best = best[np.sort(np.unique(_slot(best), return_index=True)[1])]
        if not len(best):
            break
        table, named = np.full(1 << _TABLE, 0, np.uint32), np.zeros(1 << _TABLE, np.uint32)
        table[_slot(best)], named[_slot(best)] = best, base + np.arange(len(best))
        at = _slot(keys)
        hit = np.flatnonzero((table[at] == keys) & (named[at] > 0))
        start = np.concatenate([[True], hit[1:] != hit[:-1] + 1])  # of a stretch of overlapping pairs: every second one is taken
        place = np.arange(len(hit))
        taken = hit[(place - np.maximum.accumulate(np.where(start, place, 0))) & 1 == 0]
        s[taken] = named[at[taken]]
        keep = np.ones(size, bool)
        keep[taken + 1] = False
        s = s[keep]
        rules.append(np.stack([best >> np.uint32(16), best & np.uint32(0xFFFF)], axis=1).astype(np.int64))
        base, free = base + len(best), free - len(best)
        if len(s) > 0.985 * size:
            break
    return s, np.concatenate(rules) if rules else np.empty((0, 2), np.int64)


def _slot(pairs: np.ndarray) -> np.ndarray:
    return (pairs * np.uint32(0x9E3779B1)) >> np.uint32(32 - _TABLE)


def expansions(rules: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All symbols spelled out: ids in a row, and start and length of each symbol's."""
    length = np.ones(first + len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        length[first + i] = length[a] + length[b]
    start = np.cumsum(length) - length
    flat = np.zeros(int(length.sum()), np.int64)
    flat[:first] = np.arange(first)
    for i, (a, b) in enumerate(rules.tolist()):
        at, n = start[first + i], length[a]
        flat[at : at + n] = flat[start[a] : start[a] + n]
        flat[at + n : at + length[first + i]] = flat[start[b] : start[b] + length[b]]
    return flat, start, length


def expand(symbols: np.ndarray, spelled: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    flat, start, length = spelled
    n = length[symbols]
    ends = np.cumsum(n)
    return flat[np.repeat(start[symbols] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


def pack(keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray, first: int) -> bytes:
    """A shard: head, rules with expansion lengths, documents with the places of their first symbol and id, symbols; and a checksum.

    ``sizes`` has the ids of each document, END included: no rule takes END in, so documents begin at whole symbols.
    """
    symbols, rules = compress(ids, first)
    length = np.ones(first + len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        length[first + i] = length[a] + length[b]
    id_at = np.concatenate([[0], np.cumsum(sizes)])
    symbol_at = np.searchsorted(np.concatenate([[0], np.cumsum(length[symbols])]), id_at)
    body = b"".join([
        struct.pack("<IIII", first, len(rules), len(keys), len(symbols)), rules.astype("<u2").tobytes(), length[first:].astype("<u4").tobytes(),
        keys.astype("<i8").tobytes(), symbol_at.astype("<u4").tobytes(), id_at.astype("<u4").tobytes(), symbols.astype("<u2").tobytes(),
    ])
    return MAGIC + struct.pack("<I", zlib.crc32(body)) + body


class Shard:
    """A shard file, opened."""

    def __init__(self, raw: bytes) -> None:
        if raw[:4] != MAGIC or zlib.crc32(raw[8:]) != struct.unpack("<I", raw[4:8])[0]:
            raise ValueError("not a shard file, or damaged")
        self.first, rules, docs, symbols = struct.unpack("<IIII", raw[8:24])
        at = 24

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        self.rules = take("<u2", 2 * rules).reshape(-1, 2).astype(np.int64)
        self.lengths = take("<u4", rules)
        self.keys, self.symbol_at, self.id_at = take("<i8", docs), take("<u4", docs + 1), take("<u4", docs + 1)
        self.symbols = take("<u2", symbols)

    def ids(self) -> np.ndarray:
        return expand(self.symbols.astype(np.int64), expansions(self.rules, self.first)).astype("<u4")

    def document(self, i: int) -> np.ndarray:
        """Ids of one document: only its own symbols are spelled out, rule by rule."""
        out, todo = [], self.symbols[self.symbol_at[i] : self.symbol_at[i + 1]].tolist()[::-1]
        while todo:
            x = todo.pop()
            if x < self.first:
                out.append(x)
            else:
                a, b = self.rules[x - self.first].tolist()
                todo += [b, a]
        return np.array(out, "<u4")


class Words:
    """The tokenizer behind two caches: words between white space, and the pieces its own pattern splits them into.

    White space never lies inside a piece, so a text's ids are those of its words, and a word's those of its pieces. Texts with
    signs that Python and the tokenizer do not agree to be white space, or with one of its added tokens in any case, are given to the
    tokenizer whole, so its own rules for those tokens hold.
    """

    _of: dict[bytes, Words] = {}
    KEPT = 400_000
    UNSURE = re.compile("[\x1c-\x1f\x85᠎​﻿]")

    def __init__(self, file: bytes) -> None:
        self.tokenizer = Tokenizer.from_buffer(file)
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        ends = [i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]
        self.closes = np.zeros(self.size, bool)
        self.closes[ends] = True
        self.words: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}

    @classmethod
    def of(cls, file: bytes) -> Words:
        name = hashlib.md5(file).digest()
        if name not in cls._of:
            cls._of[name] = cls(file)
        return cls._of[name]

    def _learn(self, new: list[str]) -> None:
        """Words of Latin letters, with one closing mark or none, go piece by piece, joined into long lines; others word by word.

        A capital ASCII letter is lowered here, as the tokenizer would; letters beyond Latin-1 may change under its normalization.
        """
        split: list[tuple[str, str, str]] = []
        others = []
        for w in new:
            core, mark = (w[:-1], w[-1]) if w[-1] in ".,;:" else (w, "")
            if core.isalpha() and core.isascii():
                split.append((w, core.lower(), mark))
            elif core.isalpha() and max(core) < "\u0100":
                split.append((w, core, mark))
            else:
                others.append(w)
        pieces = list({p for _, p, _ in split}.difference(self.plain)) + [m for m in ".,;:" if m not in self.plain]
        for s in range(0, len(pieces), 2000):
            part = pieces[s : s + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.closes[ids]) + 1).tolist()
            if len(ends) != len(part):
                raise ValueError("pieces and word ends do not match")
            raw = ids.tobytes()
            for p, a, b in zip(part, [0, *ends[:-1]], ends):
                self.plain[p] = raw[4 * a : 4 * b]
        words, plain = self.words, self.plain
        for w, p, m in split:
            words[w] = plain[p] + plain[m] if m else plain[p]
        for w, e in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False)):
            words[w] = np.array(e.ids, "<u4").tobytes()

    def _has_added(self, text: str) -> bool:
        low = text.lower()
        return any(t in low for t in self.added)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        if len(self.words) > self.KEPT:
            self.words.clear(), self.plain.clear()
        sure = [t.split() if t and not self.UNSURE.search(t) and not self._has_added(t) else None for t in texts]
        new = set().union(*[w for w in sure if w]).difference(self.words)
        if new:
            self._learn(list(new))
        get = self.words.__getitem__
        return [
            b"".join(map(get, w)) if w is not None else np.array(self.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()
            for t, w in zip(texts, sure)
        ]


def write_shards(docs: DataFrame, tokenizer_file: str, key: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """The shard table, written to the shared folder and read back: (part, block, n_docs, n_ids, payload).

    Documents in ascending key order (null first, equal keys by text, null text as an empty one), each closed by END; a shard ends
    at about SHARD_IDS ids and never inside a document. An empty table gives no shard.
    """
    with open(tokenizer_file, "rb") as f:  # read by the driver, under two megabytes; tasks get the bytes
        file = f.read()
    edges = cuts(docs, key, ranges or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = ["part", "block", "n_docs", "n_ids", "payload"]
    end = struct.pack("<I", END)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words.of(file)
        part, block, keys, held, size = None, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            payload = pack(np.array(keys, np.int64), ids, np.array([len(x) // 4 + 1 for x in held[::2]]), words.size)
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([payload], pa.binary())
            ], names=names)

        for batch in batches:
            texts = batch.column(4).to_pylist()
            encoded = (ids for s in range(0, len(texts), 512) for ids in words.encode(texts[s : s + 512]))
            rows = zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), encoded)
            for p, o, ids in rows:
                if keys and (p != part or size >= 4 * SHARD_IDS):
                    yield flush()
                    block, keys, held, size = (block + 1 if p == part else 0), [], [], 0
                part = p
                keys.append(o)
                held += [ids, end]
                size += len(ids) + 4
        if keys:
            yield flush()

    made = dealt(docs, key, text, edges).mapInArrow(run, "part int, block int, n_docs long, n_ids long, payload binary")
    return written(made, "repair-shards")


def read_shards(shards: DataFrame, kind: str = "bigint", key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids): every document of the shards, with the number of ids before it."""
    before = Window.orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)  # one short row per shard
    offsets = shards.select("part", "block", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    names = [key, "start", "n_tokens", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(payload)
                at, ids = shard.id_at.astype(np.int64), shard.ids()
                for s in range(0, len(shard.keys), 1024):
                    e = min(s + 1024, len(shard.keys))
                    keys = shard.keys[s:e]
                    values = pa.ListArray.from_arrays(pa.array((at[s : e + 1] - at[s]).astype(np.int32)), pa.array(ids[at[s] : at[e]].astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array(keys, mask=keys == NULL_ID), pa.array(base + at[s:e]), pa.array(np.diff(at[s : e + 1])), values], names=names)

    found = shards.join(offsets, ["part", "block"]).select("base", "payload")
    return found.mapInArrow(run, f"`{key}` bigint, start long, n_tokens long, ids array<int>").withColumn(key, F.col(f"`{key}`").cast(kind))


def digests(read: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32): checksum over the ids as little-endian unsigned 32-bit numbers."""
    kind = read.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat, at = lists.values.to_numpy().astype("<u4"), lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=[key, "start", "n_tokens", "ids_crc32"])

    return read.mapInArrow(run, f"`{key}` {kind}, start long, n_tokens long, ids_crc32 long")
