"""Counting quotient filters against plain counts, and exact duplicates against a plain grouping, with narrow fingerprints too."""

import hashlib
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import quotient

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@pytest.mark.parametrize("bits", [1, 3, 8, 16, 57, 63, 64])
def test_filters_keep_prints_and_counts(bits):
    r = np.random.default_rng(bits)
    for n in (0, 1, 2, 50, 700):
        prints = np.unique(r.integers(0, 2**64, size=n, dtype=np.uint64) >> np.uint64(64 - bits))
        for top in (1, 3, 300, 70_000, 2**33):
            counts = r.integers(1, top + 1, size=len(prints))
            back, how_often = quotient.unpack(quotient.pack(prints, counts, bits))
            assert np.array_equal(back, prints) and np.array_equal(how_often, counts)


def test_crowded_homes():
    """All remainders share a few homes, so runs push each other on, past the last slot."""
    prints = np.unique(np.array([*range(200), *range(1 << 63, (1 << 63) + 300), *range(2**64 - 100, 2**64)], np.uint64))
    back, counts = quotient.unpack(quotient.pack(prints, np.ones(len(prints), np.int64), 64))
    assert np.array_equal(back, prints) and (counts == 1).all()


def test_merge_adds_counts():
    r = np.random.default_rng(5)
    values = r.integers(0, 400, size=3000).astype(np.uint64)
    parts = [np.unique(values[i::7], return_counts=True) for i in range(7)]
    prints, counts = quotient.unpack(quotient.merge([quotient.pack(p, c, 20) for p, c in parts] + [b""], 20))
    want = np.unique(values, return_counts=True)
    assert np.array_equal(prints, want[0]) and np.array_equal(counts, want[1])
    assert quotient.merge([], 20) == b""


def test_merged_filters_of_all_rows(spark):
    rows = spark.range(5000).select((F.col("id") % 13).alias("part"), (F.xxhash64(F.col("id") % 700)).alias("fp"))
    made = quotient.filters(rows.repartition(4, "part").sortWithinPartitions("part"), 3)
    found = {}
    for block, packed in quotient.merged(made, 3).collect():
        prints, counts = quotient.unpack(bytes(packed))
        found.update(zip((prints | np.uint64(block << 61)).view(np.int64).tolist(), counts.tolist()))
    assert found == {r["fp"]: r["count"] for r in rows.groupBy("fp").count().collect()}


ROWS = [
    (1, "Same Text"), (2, "same text"), (9, "SAME TEXT"), (3, None), (4, ""), (None, ""), (5, "É"), (6, "é"), (7, "long " * 50_000), (8, "LONG " * 50_000),
    (10, "row"), (10, "row"), (10, "ROW"), (None, "no key"), (None, "NO key"), (11, "alone"), (12, "a\x00b"), (13, "A\x00b"), (14, " same text"),
]


def plain(rows):
    groups = {}
    for k, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(k)
    out = []
    for t, keys in groups.items():
        best = max((k for k in keys if k is not None), default=None)
        for i, k in enumerate(sorted(keys, key=lambda k: (k is not None, k or 0))):
            out.append((k, best, len(keys), i == len(keys) - 1, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [64, 6, 1])
@pytest.mark.parametrize("tasks", [1, 5])
def test_exact_duplicates(spark, bits, tasks):
    """Narrow fingerprints make different texts meet: their bytes keep them apart."""
    docs = spark.createDataFrame([(*r, "x", 0) for r in ROWS], "doc_id long, text string, fp string, row int").repartition(tasks)
    assert sorted(map(tuple, quotient.exact_duplicates(docs, bits=bits).collect()), key=str) == plain(ROWS)
    assert quotient.exact_duplicates(docs.limit(0)).count() == 0


def test_duplicates_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(quotient, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(quotient, "BLOCK_ROWS", 2)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    for bits in (64, 4):
        assert sorted(map(tuple, quotient.exact_duplicates(docs, bits=bits).collect()), key=str) == plain(ROWS)
