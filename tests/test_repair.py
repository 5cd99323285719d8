import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import anomaly, repair
from strandline.sequence import Sequence
from tests.conftest import close, rows

SPECS = [Sequence(("k",), ("i",), None), Sequence(("k",), ("i",), "floor(i / 4)", segment_rows=3)]


def table(spark, values, schema="k int, i int, f int, v double, w double"):
    return spark.createDataFrame(values, schema)


@pytest.mark.parametrize("seq", SPECS)
def test_run_at_either_end_becomes_missing_and_stays_flagged(spark, seq):
    df = table(spark, [(1, 0, 1, 9.0, 9.0), (1, 1, 0, 1.0, 1.0), (1, 2, 0, 2.0, 2.0), (1, 3, 1, 9.0, 9.0)])
    out = rows(repair.repair_runs(df, seq, "f", ["v"], 2).select("i", "v", "f"))
    assert out == [(0, None, 1), (1, 1.0, 0), (2, 2.0, 0), (3, None, 1)]


@pytest.mark.parametrize("seq", SPECS)
def test_long_run_untouched_short_run_on_a_line(spark, seq):
    flags = [0, 1, 1, 0, 1, 1, 1, 0]
    df = table(spark, [(1, i, f, 30.0 if i == 3 else 0.0 if i == 0 else 99.0, None) for i, f in enumerate(flags)])
    out = rows(repair.repair_runs(df, seq, "f", ["v"], 2).select("i", "v", "f"))
    assert [(v, f) for _, v, f in out] == [(0.0, 0), (10.0, 0), (20.0, 0), (30.0, 0), (99.0, 1), (99.0, 1), (99.0, 1), (99.0, 0)]


@pytest.mark.parametrize("seq", SPECS)
def test_missing_neighbour_in_one_column(spark, seq):
    df = table(spark, [(1, 0, 0, 0.0, None), (1, 1, 1, 9.0, 9.0), (1, 2, 0, 2.0, 2.0)])
    assert rows(repair.repair_runs(df, seq, "f", ["v", "w"], 3).select("i", "v", "w", "f")) == [
        (0, 0.0, None, 0), (1, 1.0, None, 0), (2, 2.0, 2.0, 0)
    ]


def brute_repair(flags, values, limit):
    out, f, i = list(values), list(flags), 0
    while i < len(flags):
        if not flags[i]:
            i += 1
            continue
        j = i
        while j < len(flags) and flags[j]:
            j += 1
        if j - i <= limit:
            a = values[i - 1] if i else None
            b = values[j] if j < len(flags) else None
            for k in range(i, j):
                ok = a is not None and b is not None
                out[k] = a + (b - a) / (j - i + 1) * (k - i + 1) if ok else None
                f[k] = 0 if ok else 1
        i = j
    return out, f


@pytest.mark.parametrize("seq", SPECS)
def test_repair_against_brute_force(spark, seq):
    random.seed(11)
    flags = [int(random.random() < 0.5) for _ in range(150)]
    values = [float(random.randint(0, 90)) if random.random() < 0.9 else None for _ in flags]
    df = table(spark, [(1, i, f, v, None) for i, (f, v) in enumerate(zip(flags, values))])
    want_v, want_f = brute_repair(flags, values, 3)
    for (i, v, f), a, b in zip(rows(repair.repair_runs(df, seq, "f", ["v"], 3).select("i", "v", "f")), want_v, want_f):
        assert close(v, a) and f == b, i


@pytest.mark.parametrize("seq", SPECS)
def test_gaps_per_column(spark, seq):
    v = [None, 1.0, None, None, 4.0, None, None, None, 8.0, None]
    df = table(spark, [(1, i, 0, x, None) for i, x in enumerate(v)])
    got = [x for _, x in rows(repair.repair_gaps(df, seq, ["v"], 2).select("i", "v"))]
    assert got == [None, 1.0, 2.0, 3.0, 4.0, None, None, None, 8.0, None]


@pytest.mark.parametrize("seq", SPECS)
def test_jump_needs_five_prior_values(spark, seq):
    df = table(spark, [(1, i, 0, 1.0 if i != 4 and i != 5 else 100.0, None) for i in range(6)])
    assert [r[1] for r in rows(anomaly.jump_flags(df, seq, "v", 30, 0.2).select("i", "jump"))] == [False] * 5 + [True]


@pytest.mark.parametrize("seq", SPECS)
def test_transient_against_brute_force(spark, seq):
    random.seed(2)
    on = [random.random() < 0.15 for _ in range(200)]
    window, limit, want, i = 3, 2, [False] * 200, 0
    while i < 200:
        if not on[i]:
            i += 1
            continue
        j = i
        while j < 200 and on[j]:
            j += 1
        if j - i <= limit and not any(on[max(0, i - window):i]) and not any(on[j:j + window]):
            want[i:j] = [True] * (j - i)
        i = j
    df = spark.createDataFrame([(1, i, bool(x)) for i, x in enumerate(on)], "k int, i int, p boolean")
    got = [r[1] for r in rows(anomaly.transient_flags(df, seq, F.col("p"), window, limit).select("i", "transient"))]
    assert got == want and any(want)


def test_score_ignores_absent_columns_and_uses_transients_on_request(spark):
    df = table(spark, [(1, i, int(i == 9), None if i == 7 else 10.0, None) for i in range(20)])
    rules = anomaly.AnomalyRules(use_transient=True, window=3)
    out = rows(anomaly.anomaly_score(df, SPECS[0], ["v", "w"], rules, {"f": F.col("f") == 1}).select("i", "anomaly_score", "anomaly_reasons"))
    assert [(i, s, r) for i, s, r in out if s] == [(7, 1.0, ["missing:v"]), (9, 2.0, ["transient:f"])]
