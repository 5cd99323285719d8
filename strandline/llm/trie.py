"""Prefix trie of conversations: which first turns are shared, by how many, and what a cache of shared prefixes saves.

Z-fast trie: unary paths are one compacted node, hashed by its handle, the prefix whose length is the two-fattest number (the one with
most trailing zero bits) between the node's shortest and longest prefix. A fat binary search over lengths finds where a
conversation leaves the trie in as many look-ups as its length has binary digits. Conversations are inserted in batches: equal ones are put
together, all of a batch are located in the trie as it is, and those that leave it at the same node are inserted together from there.
At the end the edges are expanded to one row per prefix.

A task builds the trie of its own conversations, so that a prefix which a third of all conversations share reaches the shuffle once per
task. Prefixes are known by 128 bits, the exclusive or of the hashes of their turns with their places, so they are made by running sums.
Long conversations are cut into segments of SEGMENT turns; a segment hangs on the prefix before it, so no task holds a whole conversation.

Sums over a subtree need no walk: a node's smallest conversation owns it, an owner owns the rest of its path from some depth on,
and each node is owned once. So leaves and distinct bytes below a node are sums over its members of numbers known per conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import written

SEGMENT = 4096  # turns of a conversation that are handled together
BATCH, HELD = 2048, 1 << 18  # paths inserted together; turns that a trie holds before it is written and begun anew
RANGE_BITS = 12  # ids of a node's conversations are first joined in ranges of so many bits


def two_fattest(a: int, b: int) -> int:
    """The number in (a, b] with most trailing zero bits."""
    return b & (-1 << ((a ^ b).bit_length() - 1))


@dataclass(frozen=True, slots=True)
class Path:
    """Prefixes of ``base`` + 1 up to ``base`` + len turns, 16 bytes each in ``ids``, below the prefix ``root``; ``before``: bytes before each turn."""

    root: bytes
    base: int
    ids: bytes
    before: np.ndarray

    @property
    def end(self) -> int:
        return self.base + len(self.ids) // 16

    def at(self, depth: int) -> bytes:
        i = 16 * (depth - self.base)
        return self.ids[i - 16 : i] if i else self.root


class ZFastTrie:
    """Compacted nodes with the least member, the number of members and the sum of their sizes of the paths that end in them."""

    def __init__(self) -> None:
        self.handles: dict[bytes, int] = {}
        self.roots: dict[bytes, int] = {}
        self.path: list[Path] = []  # one whose prefix is the node's extent
        self.name: list[int] = []  # turns of the parent's extent
        self.extent: list[int] = []
        self.parent: list[int] = []
        self.children: list[dict[bytes, int]] = []
        self.members: list[int] = []
        self.total: list[int] = []
        self.least: list[tuple | None] = []
        self.lookups = 0

    def _new(self, path: Path, name: int, extent: int, parent: int) -> int:
        for column, value in (
            (self.path, path), (self.name, name), (self.extent, extent), (self.parent, parent), (self.children, {}), (self.members, 0), (self.total, 0),
            (self.least, None),
        ):
            column.append(value)
        return len(self.path) - 1

    def _handle(self, node: int) -> bytes:
        return self.path[node].at(two_fattest(self.name[node], self.extent[node]))

    def locate(self, x: Path, start: int | None = None) -> tuple[int, int]:
        """(exit node, its parent's extent): the node at or inside which ``x`` leaves the trie, searched from ``start``, a prefix of x."""
        node = self.roots[x.root] if start is None else start
        a, b = self.extent[node], x.end
        while a < b:
            f = two_fattest(a, b)
            self.lookups += 1
            found = self.handles.get(x.at(f))
            if found is None:
                b = f - 1
                continue
            e = self.extent[found]
            if e > x.end or self.path[found].at(e) != x.at(e):
                return found, self.name[found]
            node, a = found, e
        below = self.children[node].get(x.at(a + 1)) if a < x.end else None
        return (node, self.name[node]) if below is None else (below, a)

    def insert(self, batch: dict[tuple[bytes, bytes], tuple[Path, int, int, tuple]]) -> None:
        """Paths by root and last prefix, each with its number of members, the sum of their sizes and the least of them."""
        groups: dict[int, list[tuple[bytes, bytes]]] = {}
        for key, (x, *_) in batch.items():
            if x.root not in self.roots:
                self.roots[x.root] = self._new(x, x.base, x.base, -1)
            groups.setdefault(self.locate(x)[0], []).append(key)
        for exit_, keys in groups.items():
            start = exit_ if self.parent[exit_] < 0 else self.parent[exit_]
            for key in keys:
                x, members, total, least = batch[key]
                node = self._place(x, start)
                self.members[node] += members
                self.total[node] += total
                self.least[node] = least if self.least[node] is None else min(least, self.least[node])

    def _place(self, x: Path, start: int) -> int:
        """The node whose extent is the whole of ``x``, made if need be."""
        node, _ = self.locate(x, start)
        low, high = self.name[node], min(self.extent[node], x.end)
        while low < high:  # how far x follows the edge
            middle = (low + high + 1) // 2
            if self.path[node].at(middle) == x.at(middle):
                low = middle
            else:
                high = middle - 1
        if low < self.extent[node]:
            node = self._split(node, low)
        if low == x.end:
            return node
        leaf = self._new(x, low, x.end, node)
        self.children[node][x.at(low + 1)] = leaf
        self.handles[self._handle(leaf)] = leaf
        return leaf

    def _split(self, node: int, depth: int) -> int:
        path, name, parent = self.path[node], self.name[node], self.parent[node]
        del self.handles[self._handle(node)]
        upper = self._new(path, name, depth, parent)
        self.children[parent][path.at(name + 1)] = upper
        self.name[node], self.parent[node] = depth, upper
        self.children[upper][path.at(depth + 1)] = node
        self.handles[self._handle(upper)] = upper
        self.handles[self._handle(node)] = node
        return upper

    def expand(self) -> Iterator[tuple[int, int, Path, int, int, tuple]]:
        """(first depth, last depth, path, members, sum of sizes, least) of every node's edge; a root's own depth for those of depth 0."""
        order = sorted(range(len(self.path)), key=lambda i: -self.extent[i])
        order.sort(key=lambda i: self.parent[i] < 0)  # roots last: a root may be as deep as the last prefix of another segment
        for i in order:
            if self.least[i] is None:
                continue
            up = self.parent[i]
            if up >= 0:
                self.members[up] += self.members[i]
                self.total[up] += self.total[i]
                self.least[up] = self.least[i] if self.least[up] is None else min(self.least[up], self.least[i])
                yield self.name[i] + 1, self.extent[i], self.path[i], self.members[i], self.total[i], self.least[i]
            elif self.extent[i] == 0:
                yield 0, 0, self.path[i], self.members[i], self.total[i], self.least[i]


def _pairs(column: pa.Array, first: str, second: str) -> tuple[np.ndarray, np.ndarray]:
    flat = column.flatten()
    return flat.field(first).to_numpy(zero_copy_only=False), flat.field(second).to_numpy(zero_copy_only=False)


def paths_of(turns: DataFrame) -> DataFrame:
    """(conv, base, root_a, root_b, a, b, before, size, turns, end_a, end_b): the segments of all conversations with their prefixes.

    ``turns`` has conv, at (1, 2, ...; a row with 0 for every conversation), a and b (two hashes of the turn), bytes.
    """
    placed = turns.select(
        "conv", "at", F.when(F.col("at") > 0, F.xxhash64("at", "a")).otherwise(F.lit(0).cast("long")).alias("a"),
        F.when(F.col("at") > 0, F.xxhash64(F.lit("second"), "at", "b")).otherwise(F.lit(0).cast("long")).alias("b"), "bytes",
        F.expr(f"greatest(at - 1, 0L) div {SEGMENT}").alias("segment"),
    )
    cut = placed.groupBy("conv", "segment").agg(
        F.sort_array(F.collect_list(F.struct("at", "a", "b", "bytes"))).alias("rows"), F.bit_xor("a").alias("seg_a"), F.bit_xor("b").alias("seg_b"),
        F.sum("bytes").alias("seg_bytes"), F.sum(F.when(F.col("at") > 0, 1).otherwise(0)).alias("seg_turns"),
    )
    cut = written(cut, "trie-segments")  # at most SEGMENT + 1 rows each
    all_ = Window.partitionBy("conv")
    earlier = all_.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    placed = cut.select(
        "conv", "segment", F.coalesce(F.bit_xor("seg_a").over(earlier), zero).alias("root_a"), F.coalesce(F.bit_xor("seg_b").over(earlier), zero).alias("root_b"),
        F.coalesce(F.sum("seg_bytes").over(earlier), zero).alias("bytes_before"), F.sum("seg_bytes").over(all_).alias("size"), F.sum("seg_turns").over(all_).alias("turns"),
        F.bit_xor("seg_a").over(all_).alias("end_a"), F.bit_xor("seg_b").over(all_).alias("end_b"),
    )
    whole = cut.select("conv", "segment", "rows").join(placed, ["conv", "segment"])
    names = ["conv", "base", "root_a", "root_b", "a", "b", "before", "size", "turns", "end_a", "end_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name)).to_numpy()  # noqa: B023, E731
            rows = batch.column(batch.schema.get_field_index("rows"))
            at, size = _pairs(rows, "at", "bytes")
            a, b = _pairs(rows, "a", "b")
            edges = rows.offsets.to_numpy() - rows.offsets[0].as_py()
            out_a, out_b, before, base = [], [], [], []
            for s, e, ra, rb, sofar in zip(edges[:-1].tolist(), edges[1:].tolist(), get("root_a").tolist(), get("root_b").tolist(), get("bytes_before").tolist()):
                if at[s] == 0:
                    s += 1
                    base.append(0)
                else:
                    base.append(int(at[s]) - 1)
                out_a.append(np.bitwise_xor.accumulate(a[s:e]) ^ ra), out_b.append(np.bitwise_xor.accumulate(b[s:e]) ^ rb)
                before.append(np.cumsum(size[s:e]) - size[s:e] + sofar)
            kind = pa.list_(pa.int64())
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in c])]), pa.int32()), pa.array(np.concatenate(c))) for c in (out_a, out_b, before)]
            columns = [get("conv"), np.array(base), get("root_a"), get("root_b")]
            arrays = [*map(pa.array, columns), *[x.cast(kind) for x in lists], *[pa.array(get(n)) for n in names[7:]]]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "conv long, base long, root_a long, root_b long, a array<long>, b array<long>, before array<long>, size long, turns long, end_a long, end_b long"
    return whole.mapInArrow(run, schema)


NODE = "a long, b long, depth long, parent_a long, parent_b long, before long, members long, total long, low long, low_size long, low_turns long"


def partial_nodes(paths: DataFrame) -> DataFrame:
    """The prefixes of each task's conversations: one row per prefix and trie, with members, sum of their sizes and the least of them."""

    def rows_of(trie: ZFastTrie) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([p[0] for p in parts])
            ups = np.concatenate([p[1] for p in parts])
            many = [len(p[0]) for p in parts]
            fixed = [np.repeat([p[3][i] for p in parts], many) for i in range(5)]
            depth = np.concatenate([p[2] for p in parts])
            before = np.concatenate([p[4] for p in parts])
            columns = [ids[:, 0], ids[:, 1], depth, ups[:, 0], ups[:, 1], before, *fixed]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in NODE.split(", ")])

        for first, last, path, members, total, least in trie.expand():
            known = np.frombuffer(path.root + path.ids, np.int64).reshape(-1, 2)
            i = first - path.base
            fixed = (members, total, *least)
            if first == 0:
                parts.append((known[:1], known[:1], np.zeros(1, np.int64), fixed, np.zeros(1, np.int64)))
            else:
                n = last - first + 1
                parts.append((known[i : i + n], known[i - 1 : i - 1 + n], np.arange(first, last + 1), fixed, path.before[i - 1 : i - 1 + n]))
            held += last - first + 1
            if held >= 1 << 14:
                yield flush()
                parts.clear()
                held = 0
        if parts:
            yield flush()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, batch, held = ZFastTrie(), {}, 0
        for rows in batches:
            names = rows.schema.names
            lists = [rows.column(names.index(c)) for c in ("a", "b", "before")]
            edges = (lists[0].offsets.to_numpy() - lists[0].offsets[0].as_py()).tolist()
            a, b, before = (c.flatten().to_numpy() for c in lists)
            ids = np.column_stack([a, b]).tobytes()
            scalar = [rows.column(names.index(c)).to_pylist() for c in ("conv", "base", "root_a", "root_b", "size", "turns")]
            for s, e, conv, base, ra, rb, size, turns in zip(edges[:-1], edges[1:], *scalar):
                root = np.array([ra, rb], np.int64).tobytes()
                mine = ids[16 * s : 16 * e]
                key, least = (root, mine[-16:]), (conv, size, turns)
                if key in batch:
                    x, n, total, low = batch[key]
                    batch[key] = (x, n + 1, total + size, min(low, least))
                else:
                    batch[key] = (Path(root, base, mine, before[s:e].copy()), 1, size, least)
                    held += e - s + 1
                if len(batch) >= BATCH:
                    trie.insert(batch)
                    batch = {}
                if held >= HELD:
                    trie.insert(batch)
                    yield from rows_of(trie)
                    trie, batch, held = ZFastTrie(), {}, 0
        trie.insert(batch)
        yield from rows_of(trie)

    return paths.select("conv", "base", "root_a", "root_b", "a", "b", "before", "size", "turns").mapInArrow(run, NODE)


def id_digests(ends: DataFrame) -> DataFrame:
    """(a, b, digest): sha256 of the ids that end at each prefix, in ascending order, joined by commas. ``ends`` has conv, a, b.

    Ids are joined in ranges first, so the last step, which has to read a prefix's ids in order, reads few long strings and holds none.
    """
    ranged = ends.groupBy("a", "b", F.shiftright("conv", RANGE_BITS).alias("range")).agg(F.sort_array(F.collect_list("conv")).alias("ids"))
    joined = ranged.select("a", "b", "range", F.array_join(F.transform("ids", lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, hashlib.sha256()
        for batch in batches:
            out = []
            for a, b, ids in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if (a, b) == key:
                    digest.update(b",")
                else:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = (a, b), hashlib.sha256()
                digest.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["a", "b", "digest"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, digest.hexdigest())], names=["a", "b", "digest"])

    ordered = joined.repartition("a", "b").sortWithinPartitions("a", "b", "range").select("a", "b", "ids")
    return ordered.mapInArrow(run, "a long, b long, digest string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row per distinct prefix.

    ``turns`` has conv, at, a, b, bytes: the turns of each conversation numbered 1, 2, ... without gaps, two 64-bit hashes of what a
    turn says, and its size; and for every conversation a row with at = 0 (a, b and bytes are not read), which alone makes one without turns.
    Its prefix of no turns is the root, of which all are members. conv_id is a prefix's smallest member; n_leaves counts the childless
    prefixes at or below it; saved_tokens sums, at and below it, the bytes of the last turn times the members but one; ends_sha256
    digests the ids of the members that have no further turn. Conversations must have an id; equal ones share all their prefixes. An
    empty table has no prefix at all, not even the root.
    """
    turns = turns.select("conv", "at", *[F.when(F.col("at") > 0, F.col(c)).otherwise(F.lit(0).cast("long")).alias(c) for c in ("a", "b", "bytes")])
    paths = written(paths_of(turns), "trie-paths")
    low = F.min(F.struct("low", "low_size", "low_turns"))
    shared = partial_nodes(paths).groupBy("a", "b").agg(
        F.min("depth").alias("depth"), F.min("parent_a").alias("parent_a"), F.min("parent_b").alias("parent_b"), F.min("before").alias("before"),
        F.sum("members").alias("members"), F.sum("total").alias("total"), low.alias("low"),
    )
    nodes = written(shared.select("a", "b", "depth", "parent_a", "parent_b", "before", "members", "total", "low.*"), "trie-nodes")
    # what each owner owns: its path from its highest node on
    top = F.min(F.struct("depth", "parent_a", "parent_b", "before"))
    owners = nodes.groupBy(F.col("low").alias("conv")).agg(top.alias("top"), F.first("low_size").alias("size"), F.first("low_turns").alias("turns"))
    owners = owners.select("conv", "size", "turns", F.col("top.depth").alias("own"), F.col("top.parent_a").alias("up_a"), F.col("top.parent_b").alias("up_b"), (F.col("size") - F.col("top.before")).alias("own_bytes"))
    owners = written(owners, "trie-owners")
    above = nodes.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("low").alias("up"))
    ends = paths.filter("base = 0").select("conv", F.col("end_a").alias("a"), F.col("end_b").alias("b"))
    forked = owners.filter("own > 0").select(F.col("up_a").alias("a"), F.col("up_b").alias("b")).distinct().withColumn("forks", F.lit(True))
    leaves = ends.join(owners.select("conv"), "conv").join(forked, ["a", "b"], "left").select("conv", F.col("forks").isNull().cast("long").alias("leaf"))
    known = written(owners.join(above, ["up_a", "up_b"]).join(leaves, "conv").select("conv", "turns", "own", "own_bytes", "up", "leaf"), "trie-known")

    steps = paths.select("conv", "base", F.posexplode(F.arrays_zip("a", "b")).alias("i", "p")).select("conv", (F.col("base") + F.col("i") + 1).alias("depth"), "p.a", "p.b")
    zero = F.lit(0).cast("long")
    steps = steps.unionByName(paths.filter("base = 0").select("conv", zero.alias("depth"), zero.alias("a"), zero.alias("b")))
    first = F.min(F.struct("conv", "turns", "own", "own_bytes", "up"))
    below = steps.join(known, "conv").groupBy("a", "b").agg(
        F.sum("own_bytes").alias("owned"), F.sum("leaf").alias("n_leaves"), F.sum((F.col("own") == F.col("depth") + 1).cast("long")).alias("begun"), first.alias("m")
    )
    whole = nodes.join(below, ["a", "b"]).join(id_digests(ends), ["a", "b"], "left")
    distinct = F.col("low_size") - F.col("before") + F.col("owned") - F.col("m.own_bytes")  # bytes of all prefixes at and below
    return whole.select(
        F.col("low").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.when(F.col("m.own") < F.col("depth"), F.col("low")).otherwise(F.col("m.up"))).alias("parent_conv_id"),
        F.col("members").alias("n_convs"), (F.col("begun") + (F.col("m.turns") > F.col("depth")).cast("long")).alias("n_children"), "n_leaves",
        (F.col("total") - F.col("members") * F.col("before") - distinct).alias("saved_tokens"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
