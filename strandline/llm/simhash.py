"""SimHash near-duplicates: fingerprints of word shingles, links at a few differing bits, components.

Candidates come from the pigeonring: the 64 bits form a ring of four segments of 16. If two fingerprints differ in at most
three bits, some segment starts a chain whose first l segments together differ in at most l * 3/4 bits for every l: none in the
first, one in the first two, two in the first three. So a candidate shares one whole segment and all but one bit of the next,
a key of 32 bits, and each further segment of the chain prunes it before the full count.

keep_one takes fingerprints of five-word shingles: texts that these link are compared by their shingle sets. Texts of a Jaccard of 0.8
may differ in more than three bits, so pairs that share a rare shingle and no link are compared too, and none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import NULL_ID, discard, lean, settled, written

SEGMENTS, WIDTH, DIFFER = 4, 16, 3
BUDGET = tuple(i * DIFFER // SEGMENTS for i in range(1, SEGMENTS + 1))  # 0, 1, 2, 3
BLOCK = 1024  # fingerprints of a bucket compared at a time with the others
_TOP = np.uint64(1 << 63)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Bits set in over half of the shingle hashes; 0 without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    return _majority(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), grams), np.uint64))


def _majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for s in range(0, len(hashes), 1 << 14):
        part = hashes[s : s + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def with_fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", shingle: int = 3) -> DataFrame:
    """``docs`` with the fingerprint as a long (two's complement of its 64 bits). Rows do not move."""
    docs = docs.drop(out)
    at = docs.columns.index(text)
    docs = docs.withColumn(out, F.lit(None).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t, shingle) for t in batch.column(at).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints.view(np.int64))], names=batch.schema.names)

    return docs.mapInArrow(lean(run), docs.schema)


def _segment(i: int):
    return F.shiftrightunsigned(F.col("fp"), WIDTH * (i % SEGMENTS)).bitwiseAND(F.lit((1 << WIDTH) - 1))


def _keys(prints: DataFrame, flips: bool) -> DataFrame:
    """(ring, key, fp): per start of a chain its segment and the next one, the next one with each of its bits flipped if asked."""
    made = []
    for i in range(SEGMENTS):
        key = F.shiftleft(_segment(i), WIDTH).bitwiseOR(_segment(i + 1))
        variants = [key.bitwiseXOR(F.lit(1 << b)) for b in range(WIDTH)] if flips else [key]
        made += [k.bitwiseOR(F.lit(i << 2 * WIDTH)) for k in variants]  # the start of the chain is part of the key
    return prints.select(F.explode(F.array(*made)).alias("key"), "fp")


def _links(homes: np.ndarray, visitors: np.ndarray, ring: int) -> tuple[list[int], list[int]]:
    """A spanning set of the links inside one bucket: homes share both segments, visitors differ in one bit of the second.

    Each fingerprint of the bucket starts as its own group; blocks of them are compared with the rest along the chain, and only
    links between groups still apart are kept, so a bucket of n gives fewer than n links however dense it is.
    """
    every = np.concatenate([homes, visitors])
    root = np.arange(len(every))
    turned = (every << np.uint64((64 - WIDTH * ring) % 64)) | (every >> np.uint64(WIDTH * ring)) if ring else every
    third = (turned >> np.uint64(2 * WIDTH)) & np.uint64((1 << WIDTH) - 1)
    left, right = [], []
    for s in range(0, len(homes), BLOCK):
        e = min(s + BLOCK, len(homes))
        for t in range(s, len(every), BLOCK):
            u = min(t + BLOCK, len(every))
            apart = (np.arange(t, u) >= len(homes)).astype(np.uint8)  # the bit in which a visitor differs
            chain = np.bitwise_count(third[s:e, None] ^ third[None, t:u]) + apart <= BUDGET[2]
            a, b = np.nonzero(chain)
            near = np.bitwise_count(every[s + a] ^ every[t + b]) <= DIFFER
            for x, y in zip((s + a[near]).tolist(), (t + b[near]).tolist()):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                while root[y] != y:
                    root[y] = root[root[y]]
                    y = root[y]
                if x != y:
                    left.append(int(every[x].view(np.int64))), right.append(int(every[y].view(np.int64)))
                    root[max(x, y)] = min(x, y)
    return left, right


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` that connect exactly what the links of up to DIFFER bits connect."""
    homes = _keys(prints, False)
    crowded = homes.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("low"))
    visits = _keys(prints, True).join(crowded.select("key"), "key", "left_semi").withColumn("home", F.lit(False))
    shared = homes.join(crowded.filter("n > 1").select("key"), "key", "left_semi").withColumn("home", F.lit(True))
    visited = homes.join(visits.select("key").distinct(), "key", "left_semi").withColumn("home", F.lit(True))
    members = written(visits.unionByName(shared).unionByName(visited).distinct(), "simhash-buckets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(key: int, rows: list[np.ndarray], flags: list[np.ndarray]) -> pa.RecordBatch | None:
            prints, home = np.concatenate(rows).view(np.uint64), np.concatenate(flags)
            if len(prints) < 2 or not home.any():
                return None
            a, b = _links(prints[home], prints[~home], key >> (2 * WIDTH))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]) if a else None

        key, rows, flags = None, [], []
        for batch in batches:
            keys = batch.column(0).to_numpy()
            prints, home = batch.column(1).to_numpy().astype(np.int64), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for s, e in zip(cuts[:-1], cuts[1:]):
                if s == e:
                    continue
                if keys[s] != key:
                    if rows and (out := emit(key, rows, flags)) is not None:
                        yield out
                    key, rows, flags = int(keys[s]), [], []
                rows.append(prints[s:e]), flags.append(home[s:e])
        if rows and (out := emit(key, rows, flags)) is not None:
            yield out

    # buckets with a visitor may have one home; those without need two
    grouped = members.repartition("key").sortWithinPartitions("key", "home", "fp")
    return grouped.select("key", "fp", "home").mapInArrow(lean(run), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable, for every node of an edge. Large-star and small-star steps until nothing moves.

    Each step is two aggregations over the edges; a hub is pre-aggregated to its least neighbour and joined back by key.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "stars")
    while True:
        both = now.select("v", "u").unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = both.join(least, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("v <> u").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v")
        pairs = small.select("v", F.col("m").alias("u")).unionByName(small.filter("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")))
        following = written(pairs.distinct(), "stars")
        done = following.count() == now.count() and following.exceptAll(now).isEmpty()
        discard(now)
        if done:
            return following.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(
                following.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
            )
        now = following


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(key, fp, component_id): per row its fingerprint (long) and the smallest key reachable over links of up to DIFFER bits.

    Equal fingerprints link, those without words (zero) like any other. Distinct fingerprints, not rows, are compared, so copies
    cost nothing; no pair of a bucket is ever written. A null key sorts before all others and is returned as null where it is the
    smallest; repeated rows are each returned. An empty table gives an empty table.
    """
    prints = written(with_fingerprints(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), "t", "fp", shingle).select("k", "fp"), "simhash")
    distinct = written(prints.groupBy("fp").agg(F.min(F.coalesce(F.col("k").cast("long"), F.lit(NULL_ID))).alias("low")), "simhash-distinct")
    roots = components(links(distinct.select("fp")))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")
    smallest = named.groupBy("root").agg(F.min("low").alias("least"))
    found = named.join(smallest, "root").select("fp", F.when(F.col("least") != NULL_ID, F.col("least")).alias("component_id"))
    return prints.join(found, "fp").select(F.col("k").alias(key), "fp", "component_id")


# --- near copies by their shingle sets, for keep_one

HELD = 200_000  # shingles of compared texts that a worker holds, but for the two at hand
STAYS = 1 << 20  # rows of five numbers that are sent to every task at most
WORDS, SAMPLE, OFTEN, LISTED = 5, 5_000, 3, 200_000  # shingle length; texts counted, least count and most shingles of the order of shingles
PARITIES = 1024  # parity bits of a text's shingles


def _grams(words: list[bytes]) -> list[bytes]:
    if len(words) <= WORDS:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*[words[i:] for i in range(WORDS)])))


def _shingles(words: list[bytes]) -> np.ndarray:
    """Distinct hashes of the shingles, in ascending order."""
    grams = _grams(words)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64, len(grams)))


def _parities(found: np.ndarray) -> np.ndarray:
    """Of each of PARITIES bits, whether an odd number of the shingles falls to it, as longs.

    Two sets of shingles differ in at least as many shingles as their parities in bits.
    """
    odd = np.bincount((found % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def jaccard(a: str | None, b: str | None) -> float:
    """Likeness of two texts by the shingles themselves; 1 if both have none."""
    x, y = (set(_grams((t or "").encode().lower().split())) for t in (a, b))
    return len(x & y) / len(x | y) if x or y else 1.0


def _texts(docs: DataFrame, words: bool = True) -> DataFrame:
    """``docs``, which has t and whatever else, with t replaced by two hashes of the words, a and b, and, if asked, the words themselves, compressed as z."""
    at = docs.columns.index("t")
    kept = [c for c in docs.columns if c != "t"]
    none = F.lit(None)
    out = docs.select(*kept, none.cast("long").alias("a"), none.cast("long").alias("b"), *([none.cast("binary").alias("z")] if words else []))
    names, schema = out.columns, out.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for whole in batches:
            for s in range(0, whole.num_rows, 1000):
                batch = whole.slice(s, 1000)
                plain = [b" ".join((t or "").encode().lower().split()) for t in batch.column(at).to_pylist()]
                a, b = (pa.array(np.fromiter(map(f, plain), np.uint64, len(plain)).view(np.int64)) for f in (xxhash.xxh64_intdigest, xxhash.xxh3_64_intdigest))
                others = [c for i, c in enumerate(batch.columns) if i != at]
                packed = [pa.array(map(pack, plain), pa.binary())] if words else []
                yield pa.RecordBatch.from_arrays([*others, a, b, *packed], names=names)

    return docs.mapInArrow(lean(run), schema)


def _sized(texts: DataFrame) -> DataFrame:
    """``texts``, which has z, with the number n of shingles, their parities as ``bits`` and their fingerprint ``fp``."""
    at = texts.columns.index("z")
    out = texts.select("*", F.lit(None).cast("int").alias("n"), F.lit(None).cast("array<long>").alias("bits"), F.lit(None).cast("long").alias("fp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for whole in batches:
            for s in range(0, whole.num_rows, 1000):
                batch = whole.slice(s, 1000)
                sizes, bits, prints = [], [], []
                for z in batch.column(at).to_pylist():
                    found = _shingles(unpack(z).split())
                    sizes.append(len(found)), bits.append(_parities(found)), prints.append(_majority(found))
                added = [pa.array(sizes, pa.int32()), pa.array(bits, pa.list_(pa.int64())), pa.array(np.array(prints, np.uint64).view(np.int64))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=out_names)

    out_names = out.columns
    return texts.mapInArrow(lean(run), out.schema)


def _common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of the texts has often, and how often. They only set the order of shingles: any order finds all pairs."""
    share = min(1.0, SAMPLE / max(1, texts.count()))
    picked = texts.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("z")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for z in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(_shingles(unpack(z).split()).view(np.int64))], names=["h"])

    counted = picked.mapInArrow(lean(run), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= OFTEN)
    rows = counted.orderBy(F.desc("c"), "h").limit(LISTED).collect()
    found = np.array([r["h"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], np.array([r["c"] for r in rows], np.int64)[order]


def _rarest(texts: DataFrame) -> DataFrame:
    """(key, id, n, pos): of the n shingles of a text, rarest first, so many that texts of Jaccard 0.8 or more share one of them."""
    listed, often = _common(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            keys, ids, sizes = [np.empty(0, np.uint64)], [], []
            for i, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = _shingles(unpack(z).split())
                if len(listed):
                    at = np.minimum(np.searchsorted(listed, found), len(listed) - 1)
                    found = found[np.argsort(np.where(listed[at] == found, often[at], 0), kind="stable")]
                if len(found):
                    keys.append(found[: len(found) - (4 * len(found) + 4) // 5 + 1])
                    ids.append(i), sizes.append(len(found))
            count = np.fromiter(map(len, keys[1:]), np.int64, len(ids))
            key = np.concatenate(keys).view(np.int64)
            pos = np.arange(len(key)) - np.repeat(np.cumsum(count) - count, count)
            columns = [key, np.repeat(np.array(ids, np.int64), count), np.repeat(np.array(sizes, np.int32), count), pos.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "id", "n", "pos"])

    return texts.select("id", "z").mapInArrow(lean(run), "key long, id long, n int, pos int")


def _possible(a: str, b: str) -> Column:
    """Whether two texts that share a shingle can reach 0.8, by their sizes and the places of the shingle."""
    n, pos = ([F.col(f"{x}.{c}") for x in (a, b)] for c in ("n", "pos"))
    return 9 * (F.least(*pos) + F.least(n[0] - pos[0], n[1] - pos[1])) >= 4 * (n[0] + n[1])


def _alike(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose Jaccard, by the shingles themselves, is 0.8 or more.

    At 0.8 two texts of n shingles together differ in at most n / 9. Texts are brought together only where their parities allow that, and
    only texts of such pairs are moved.
    """
    for x in "ab":
        pairs = pairs.join(texts.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}")), x)
    differ = F.aggregate(F.zip_with("bitsa", "bitsb", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, c: total + c)
    pairs = written(pairs.filter(9 * differ <= F.col("na") + F.col("nb")).select("a", "b"), "near-pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    needed = written(texts.select("id", "z").join(F.broadcast(ids) if 2 * pairs.count() <= STAYS else ids, "id", "left_semi"), "near-needed")
    left, right = (needed.select(F.col("id").alias(x), F.col("z").alias(f"z{x}")) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            held: dict[int, set[bytes]] = {}
            good = []
            for a, b, za, zb in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if len(held) > 500 or sum(map(len, held.values())) > HELD:
                    held.clear()
                x, y = (held[i] if i in held else held.setdefault(i, set(_grams(unpack(z).split()))) for i, z in ((a, za), (b, zb)))
                both = len(x & y)
                good.append(5 * both >= 4 * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "za", "zb").mapInArrow(lean(run), "a long, b long")


def _linked(texts: DataFrame) -> DataFrame:
    """(a, b): pairs of texts that connect what equal fingerprints and the links of up to DIFFER bits connect; a is the greater id."""
    prints = texts.select("fp", "id")
    least = written(prints.groupBy("fp").agg(F.min("id").alias("id")), "near-prints")
    equal = prints.join(least.withColumnRenamed("id", "other"), "fp").filter("id <> other").select("id", "other")
    ends = (least.select(F.col("fp").alias(x), F.col("id").alias(i)) for x, i in (("a", "id"), ("b", "other")))
    apart = links(least.select("fp")).join(next(ends), "a").join(next(ends), "b").select("id", "other")
    return equal.unionByName(apart).select(F.greatest("id", "other").alias("a"), F.least("id", "other").alias("b")).distinct()


def _near_components(rows: DataFrame) -> DataFrame:
    """(a, b, root, low): per distinct text, told by both hashes, the component of near copies it is in and its smallest key.

    ``rows`` has k, a, b and z. Texts that share the first hash alone get another number in the graph.
    """
    distinct = rows.groupBy("a", "b").agg(F.min(F.coalesce(F.col("k").cast("long"), F.lit(NULL_ID))).alias("low"), F.min("z").alias("z"))
    texts = written(_sized(distinct), "near-texts")
    clash = texts.groupBy("a").agg((F.count(F.lit(1)) > 1).alias("clash")).filter("clash")
    if clash.isEmpty():
        texts = texts.withColumn("id", F.col("a"))
    else:
        texts = written(texts.join(clash, "a", "left").withColumn("id", F.when(F.col("clash"), F.col("a").bitwiseXOR(F.col("b"))).otherwise(F.col("a"))).drop("clash"), "near-texts")
    linked = written(_linked(texts), "near-linked")
    edges = settled(lambda: _alike(linked, texts), "near-edges")
    members = _rarest(texts).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("m > 1").drop("m")
    members = written(members, "near-members")
    me = F.struct("id", "n", "pos")
    found = []
    for order in (["n", "id"], [F.xxhash64("id"), "id"]):
        beside = members.select(me.alias("x"), F.lag(me).over(Window.partitionBy("key").orderBy(*order)).alias("y")).filter("y is not null")
        found.append(beside.filter(_possible("x", "y")).select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b")))
    beside = found[0].unionByName(found[1]).distinct().join(linked, ["a", "b"], "left_anti")
    edges = edges.unionByName(settled(lambda: _alike(beside, texts), "near-edges"))
    joined = components(edges)

    named = members.join(joined, members.id == joined.node, "left").select("key", "id", "n", "pos", F.coalesce("root", "id").alias("comp"))
    under = Window.partitionBy("key")
    open_ = named.withColumn("low", F.min("comp").over(under)).withColumn("high", F.max("comp").over(under)).filter("low <> high")
    open_ = open_.withColumn("most", F.count(F.lit(1)).over(Window.partitionBy("key", "comp"))).withColumn("most", F.max(F.struct("most", "comp")).over(under))
    open_ = written(open_.select("key", "comp", F.struct("id", "n", "pos").alias("x"), (F.col("comp") != F.col("most.comp")).alias("apart")), "near-open")
    discard(members)
    others = open_.select("key", F.col("comp").alias("beyond"), F.col("x").alias("y"))
    crossing = open_.filter("apart").join(others, "key").filter((F.col("comp") != F.col("beyond")) & _possible("x", "y"))
    pairs = crossing.select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b")).distinct()
    late = settled(lambda: _alike(pairs, texts), "near-edges")
    if not late.isEmpty():
        joined = components(edges.unionByName(late))
    return texts.join(joined, texts.id == joined.node, "left").select("a", "b", F.coalesce("root", "id").alias("root"), "low")


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, component_id): the smallest key reachable over pairs of texts whose five-word shingles have a Jaccard of 0.8 or more.

    Texts whose fingerprints are linked are checked by their shingles first. All pairs of 0.8 count, also those of more bits: they share one
    of the rarest fifth of their shingles, and each pair that does is checked too.
    Neighbours under a shingle are checked first, so that a large group of copies is mostly one component before the pairs between
    components are. Texts of equal words, told by two 64-bit hashes, are one; a text without words, null or empty, is like its equals only.
    A null key is less than all others and returned as null where it is the smallest. Components that share their smallest key are told
    apart by ``keep_one`` only. Repeated rows are each returned; other columns are not read; an empty table gives an empty table.
    """
    plain = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    rows = written(_texts(plain, words=False), "near-rows")
    roots = written(_near_components(_texts(plain)), "near-roots")
    smallest = roots.groupBy("root").agg(F.min("low").alias("least"))
    named = roots.join(smallest, "root").select("a", "b", F.when(F.col("least") != NULL_ID, F.col("least")).alias("component_id"))
    return rows.select("k", "a", "b").join(named, ["a", "b"]).select(F.col("k").alias(key), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component of near copies (see ``near_copies``): of its texts the one with the smallest key.

    Null keys come first. Where several texts or rows of a component share that key, the text of least hash stays, and of its rows one,
    by a hash of their other columns. Rows without words, null or empty, are one component. Columns of any name and type are kept as they are.
    """
    columns = docs.columns
    plain = [f.name for f in docs.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    low = F.coalesce(F.col(f"row.`{key}`").cast("long"), F.lit(NULL_ID)).alias("low")
    told = [low, F.xxhash64(*[F.col(f"row.`{c}`") for c in plain]).alias("h"), F.col(f"row.`{text}`").alias("t")]
    plain_texts = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))

    def choice() -> DataFrame:
        rows = written(_texts(boxed.select(*told), words=False), "near-rows")
        stays = _near_components(_texts(plain_texts)).groupBy("root").agg(F.min(F.struct("low", "a", "b")).alias("s")).select("s.*")
        ones = rows.groupBy("low", "a", "b", "h").agg(F.count(F.lit(1)).alias("n")).groupBy("low", "a", "b").agg(F.min(F.struct("h", "n")).alias("r"))
        return stays.join(ones, ["low", "a", "b"]).select("low", "a", "b", "r.h", "r.n")

    chosen = settled(choice, "near-stays")
    # the texts are hashed once more: rows are told by numbers, and only rows that occur more than once are moved
    again = _texts(boxed.select("row", *told), words=False)
    small = chosen.count() <= STAYS
    at = ["low", "h", "a", "b"]
    once = chosen.filter("n = 1").select(*at)
    kept = again.join(F.broadcast(once) if small else once, at, "left_semi").select("row")
    more = chosen.filter("n > 1").select(*at)
    if not more.isEmpty():
        kept = kept.unionByName(again.join(F.broadcast(more) if small else more, at, "left_semi").dropDuplicates(at).select("row"))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in columns])
