"""Runs of repeated words against a plain search over every period, and the query against its contract in plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import periodic, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    """Every stretch of equal words p apart, smallest period first."""
    found = {}
    same = {}
    for i, w in enumerate(words):
        same.setdefault(w, []).append(i)
    gaps = {b - a for places in same.values() for k, a in enumerate(places) for b in places[k + 1 :]}  # no other period can occur
    for p in sorted(g for g in gaps if 3 * g <= len(words)):
        i = 0
        while i + p < len(words):
            if words[i] != words[i + p]:
                i += 1
                continue
            begin = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i - begin >= 2 * p:
                found.setdefault((begin, i + p), p)
    return sorted((b, e - b, p) for (b, e), p in found.items())


def made(r):
    """Random words over few letters with repeats of repeats in them."""
    letters, out = r.choice([1, 2, 2, 3, 5]), []
    for _ in range(r.randint(0, 12)):
        unit = [r.randrange(letters) for _ in range(r.randint(1, 40))]
        if r.random() < 0.4:
            unit = unit[: r.randint(1, 8)] * r.randint(1, 8) + unit[:3]
        out += (unit * 8)[: int(len(unit) * r.uniform(0.5, 6))]
    return out[:400]


def test_every_run_is_found():
    r = random.Random(11)
    for _ in range(500):
        words = made(r)
        assert periodic.runs(np.array(words, np.int64)) == plain_runs(words)


@pytest.mark.parametrize("period", [1, 8, 9, 17, 18, 35, 36, 100, 1000])
def test_lone_runs_of_three_copies(period):
    """A run of just three copies between other words, at the bounds of the scales."""
    head, unit = [f"h{i}" for i in range(7)], [f"w{i}" for i in range(period)]
    words = head + unit * 3 + [f"t{i}" for i in range(5)]
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    assert periodic.runs(np.array([number[w] for w in words], np.int64)) == [(7, 3 * period, period)]
    short = head + (unit * 3)[:-1] + ["end"]
    number = {w: i for i, w in enumerate(dict.fromkeys(short))}
    assert all(p != period or period == 1 for _, _, p in periodic.runs(np.array([number[w] for w in short], np.int64)))


def test_runs_never_cross_documents():
    documents = [[b"a"] * 2, [b"a"] * 2, [b"a", b"b"] * 3, [], [b"b", b"a"] * 2]
    assert periodic.runs_of_documents(documents) == [[], [], [(0, 6, 2)], [], []]


def digest(doc_id, text):
    """A row of the query in plain Python."""
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = [r for r in plain_runs(words) if r[1] >= 24]
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    top = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None, None, None)
    return (
        doc_id, len(found), *top, 1000 * top[1] // top[2] if found else None,
        hashlib.sha256("".join("%d,%d,%d\n" % r for r in found).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
    )


SCHEMA = "doc_id long, text string, runs string, collapsed string"
CASES = [
    None, "", " \t\n ", "one", "a b " * 12, "a b " * 11 + "a", "x " * 24, "x " * 23, "é ü " * 40, "head " + "one two three four " * 9 + "tail", "aA Aa " * 30,
    "\x0b".join(["q", "r"] * 20), " ".join(str(i % 50) for i in range(300)), " ".join(str(i) for i in range(500)),
]


def test_query_equals_its_contract(spark, tmp_path):
    rows = [(i, t, "x", "y") for i, t in enumerate(CASES * 5)] + [(3, "a b " * 12, None, None), (3, "a b " * 12, None, None), (None, "a b " * 12, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op11_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    want = sorted((digest(d, t) for d, t, *_ in rows), key=str)
    assert got == want and any(r[1] for r in want)


def test_a_very_long_text(spark):
    row = periodic.with_runs(spark.createDataFrame([(1, "start " + "z y " * 100_000)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row["runs"]] == [(1, 200_000, 2)] and row["collapsed"] == "start z y"


def test_query_on_the_small_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, queries.op11_periodic_runs(spark, sf).collect())) == sorted(digest(d, t) for d, t in docs)


def test_operator_keeps_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b c " * 10, "old", "old")], SCHEMA).withColumn("period", F.lit(7))
    row = periodic.with_runs(docs, least=3).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 30, 3)] and row["collapsed"] == "a b c" and row["period"] == 7 and row["doc_id"] == 1
    assert periodic.with_runs(docs.limit(0)).count() == 0
