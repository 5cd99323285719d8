import random

import numpy as np
import pytest

from strandline.operators import align
from tests.conftest import close, rows

BUCKETS = [None, "floor(t / 3)"]


@pytest.mark.parametrize("bucket", BUCKETS)
def test_nearest_frame_bounds(spark, bucket):
    frames = spark.createDataFrame([("e", 1, 0.0), ("e", 2, 10.0), ("e", 3, 20.0)], "k string, frame int, ft double")
    samples = spark.createDataFrame(
        [("e", 0, -99.0), ("e", 1, 4.999), ("e", 2, 5.0), ("e", 3, 15.0), ("e", 4, 99.0), ("e", 5, None), ("x", 6, 1.0)], "k string, pos int, t double"
    )
    out = align.assign_nearest(samples, frames, ("k",), "t", "ft", "frame", bucket, "pos")
    assert rows(out.select("pos", "frame")) == [(0, 1), (1, 1), (2, 2), (3, 3), (4, 3)]


@pytest.mark.parametrize("bucket", BUCKETS)
def test_nearest_frame_against_binary_search(spark, bucket):
    rng = np.random.default_rng(0)
    times = np.sort(rng.uniform(0, 50, 30)).round(2)
    sample_t = rng.uniform(-5, 60, 200).round(2)
    frames = spark.createDataFrame([("e", i + 1, float(t)) for i, t in enumerate(times)], "k string, frame int, ft double")
    samples = spark.createDataFrame([("e", i, float(t)) for i, t in enumerate(sample_t)], "k string, pos int, t double")
    lower = np.concatenate([[-np.inf], (times[:-1] + times[1:]) / 2])
    expected = [(i, int(np.searchsorted(lower, t, side="right"))) for i, t in enumerate(sample_t)]
    out = align.assign_nearest(samples, frames, ("k",), "t", "ft", "frame", bucket, "pos")
    assert rows(out.select("pos", "frame")) == expected


@pytest.mark.parametrize("bucket", BUCKETS)
def test_interpolation(spark, bucket):
    source = spark.createDataFrame(
        [("a", 1, 0.0, 0.0, None), ("a", 2, 10.0, 100.0, 5.0), ("a", 3, 10.0, 999.0, 7.0), ("a", 4, 20.0, None, None), ("b", 5, 3.0, None, None)],
        "k string, id int, t double, v double, w double",
    )
    targets = spark.createDataFrame(
        [("a", 1, -5.0), ("a", 2, 5.0), ("a", 3, 10.0), ("a", 4, 30.0), ("b", 5, 3.0), ("c", 6, 1.0)], "k string, pos int, t double"
    )
    out = align.interpolate_to(source, targets, ("k",), "t", ["v", "w"], bucket, ["id"], "pos")
    assert rows(out.select("pos", "v", "w")) == [
        (1, 0.0, 5.0), (2, 50.0, 5.0), (3, 100.0, 5.0), (4, 100.0, 5.0), (5, None, None), (6, None, None)
    ]


@pytest.mark.parametrize("bucket", BUCKETS)
def test_interpolation_against_numpy(spark, bucket):
    rng = np.random.default_rng(1)
    t, v = np.sort(rng.uniform(0, 40, 25)), rng.normal(size=25)
    at = rng.uniform(-5, 50, 120)
    source = spark.createDataFrame([("a", i, float(x), float(y)) for i, (x, y) in enumerate(zip(t, v))], "k string, id int, t double, v double")
    targets = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(at)], "k string, pos int, t double")
    out = align.interpolate_to(source, targets, ("k",), "t", ["v"], bucket, ["id"], "pos")
    for (_, got), want in zip(rows(out.select("pos", "v")), np.interp(at, t, v)):
        assert close(got, float(want))


def test_intervals_are_open_at_the_ends(spark):
    from strandline.sequence import Sequence

    frames = spark.createDataFrame([(1, 1, 0.0), (1, 2, 4.0), (1, 3, 6.0)], "k int, frame int, t double")
    for bucket in BUCKETS:
        out = align.frame_intervals(frames, Sequence(("k",), ("t", "frame"), bucket), "t")
        inf = float("inf")
        assert rows(out.select("frame", "lower", "upper")) == [(1, -inf, 2.0), (2, 2.0, 5.0), (3, 5.0, inf)]


def _score(a, b):
    ta, tb = set(a.split("_")), set(b.split("_"))
    overlap = len(ta & tb)
    if a == b:
        return 3, len(a), len(b)
    if a in b or b in a:
        return 2, overlap, -abs(len(a) - len(b))
    return (1 if overlap else 0), overlap, -abs(len(ta) - len(tb))


def test_match_sources_against_all_pairs(spark):
    random.seed(5)
    parts = ["fr", "we", "5m", "20mm", "10m", "1", "2", "a", "ab"]
    name = lambda: "_".join(random.choice(parts) for _ in range(random.randint(1, 4)))
    left, right = sorted({name() for _ in range(60)} | {"zz", "r_5"}), sorted({name() for _ in range(40)})
    frame = lambda v: spark.createDataFrame([(x,) for x in v], "name string")
    got = {r["name"]: (r["match"], r["score_class"]) for r in align.match_sources(frame(left), frame(right), "name").collect()}
    for a in left:
        (cls, _, _), best = max((_score(a, b), b) for b in right)
        assert got[a] == ((best, cls) if cls else (None, 0)), a


def plain_match(left, right):
    """The best of all pairs by the published order; stems are given as normalised."""
    out = {}
    for a in left:
        best = (0,)
        for b in right:
            ta, tb = set(a.split("_")), set(b.split("_"))
            both = len(ta & tb)
            if a == b:
                score = (3, len(a), len(b))
            elif a in b or b in a:
                score = (2, both, -abs(len(a) - len(b)))
            else:
                score = (1 if both else 0, both, -abs(len(ta) - len(tb)))
            if score[0]:
                best = max(best, (*score, b))
        out[a] = (best[-1] if best[0] else None, best[0])
    return out


@pytest.mark.parametrize("frequent", [0, 2, 1000])
def test_matching_equals_all_pairs(spark, frequent):
    """Names of up to 40 tokens, very short ones, and tokens that most names share, rare or frequent by the limit."""
    r = random.Random(frequent)
    pool = [f"{c}{i}" for c in "abq" for i in range(25)] + ["fr", "we", "x"]
    made = lambda: "_".join(["fr"] * (r.random() < 0.5) + r.sample(pool, r.choice([1, 2, 3, 8, 40])))
    right = list({made() for _ in range(120)} | {"x", "a", "fr", "q1_q2"})
    left = list({made() for _ in range(80)} | {right[0], right[1][1:-1].strip("_"), right[2] + "_tail", "zz", "r", "fr", "nothing-else".replace("-", "")})
    frame = lambda names: spark.createDataFrame([(n,) for n in names], "name string")
    got = {n: (m, c) for n, m, c in align.match_sources(frame(left), frame(right), "name", frequent).collect()}
    assert got == plain_match(left, right)


def test_matching_an_empty_side(spark):
    some, none = spark.createDataFrame([("a_b",), ("",)], "name string"), spark.createDataFrame([], "name string")
    assert rows(align.match_sources(some, none, "name")) == [("", None, 0), ("a_b", None, 0)]
    assert align.match_sources(none, some, "name").count() == 0


def test_match_sources_broadcasts_no_names(spark):
    """A small file can hold many names, so its size must not choose a broadcast (only the frequent tokens are one)."""
    left = spark.createDataFrame([(f"fr_{i % 7}_m_{i}mm",) for i in range(60)], "name string")
    right = spark.createDataFrame([(f"we_{i % 5}_m_{i * 3}mm_x",) for i in range(60)], "name string")
    plan = align.match_sources(left, right, "name", frequent=5)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") <= 1


def test_contained_names_of_every_length(spark):
    wholes = ["abcdefghijklmnopqrst", "abcxyz", "aab", "x_y", "aaaaaaaaaaaaaaaa", "b"]
    subs = ["", "a", "ab", "abc", "cdefgh", "cdefghijklmn", "defghijklmnopqrs", "aaaaaaaaaaaa", "zzz", "abcxyz", "x_y", "bc", "éa"]
    make = lambda v: spark.createDataFrame([(x,) for x in v], "stem string")
    got = {tuple(r) for r in align._contained(make(subs), make(wholes)).collect()}
    assert got == {(s, w) for s in subs for w in wholes if s in w and s != w}


def test_sets_of_frequent_tokens_meet_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(align, "LEFT_SETS", 7)
    monkeypatch.setattr(align, "RIGHT_SETS", 5)
    mine = [(sorted({f"t{(i * k) % 11}" for k in range(1, 5)}), 4 + i % 3) for i in range(30)]
    theirs = [(sorted({f"t{(i * k + 3) % 13}" for k in range(1, 6)}), 3 + i % 4, f"n{i}") for i in range(40)]
    out = align._best_sets(spark.createDataFrame(mine, "set array<string>, n int").distinct(), spark.createDataFrame(theirs, "set array<string>, n int, best string"))
    got = {}
    for r in out.collect():
        key = (tuple(r["set_l"]), r["n_l"])
        got[key] = max(got.get(key, (0, 0, "")), (r["a"], r["b"], r["best"]))
    for s, n in mine:
        want = max((len(set(s) & set(t)), -abs(n - m), b) for t, m, b in theirs)
        assert got[(tuple(s), n)] == want
