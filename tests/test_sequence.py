"""The bucketed plan and the one-window plan must agree row for row, hot key or not."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from strandline.sequence import Sequence, carry, framed, join_stats, measured, ordered_fold, running_sum, with_position
from tests.conftest import rows

WIDE = Sequence(("k",), ("t", "id"), "floor(t / 7)", segment_rows=5)
PLAIN = replace(WIDE, bucket=None)


@pytest.fixture(scope="module")
def data(spark):
    random.seed(3)
    out = []
    for i in range(400):
        key = 1 if random.random() < 0.6 else random.randint(2, 12)  # one hot key
        t = float(random.randint(0, 150)) if random.random() < 0.97 else None
        v = float(random.randint(0, 50)) if random.random() < 0.4 else None
        out.append((key, t, i, v, random.random() < 0.3))
    return spark.createDataFrame(out, "k int, t double, id int, v double, f boolean").repartition(7)


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    columns = sorted(a.columns)
    assert rows(a.select(columns), "id") == rows(b.select(columns), "id")


def test_position_and_running_sum(data):
    a, b = with_position(data, WIDE, "p"), with_position(data, PLAIN, "p")
    same(a, b)
    assert a.count() == 400
    same(running_sum(data, WIDE, {"s": F.col("v"), "n": F.lit(1)}), running_sum(data, PLAIN, {"s": F.col("v"), "n": F.lit(1)}))


@pytest.mark.parametrize("backward", [False, True])
@pytest.mark.parametrize("exclusive", [False, True])
def test_carry(data, backward, exclusive):
    values = {"c": F.col("v"), "d": F.when(F.col("f"), F.struct("t", "v"))}
    same(carry(data, WIDE, values, backward=backward, exclusive=exclusive), carry(data, PLAIN, values, backward=backward, exclusive=exclusive))


def test_framed_reaches_across_segments(data):
    stages = (
        lambda w: {"lag3": F.lag("v", 3).over(w.order), "sum4": F.sum("v").over(w.rows(-4, -1)), "next": F.sum("v").over(w.rows(0, 11))},
        lambda w: {"again": F.max("lag3").over(w.rows(-2, 0))},
    )
    a = framed(data, WIDE, *stages, before=6, after=11)
    assert a.count() == 400
    same(a, framed(data, PLAIN, *stages, before=6, after=11))


def test_stored_position_is_used(data):
    stored = with_position(data, PLAIN, "pos").cache()
    seq = replace(WIDE, position="pos")
    stage = lambda w: {"lag": F.lag("v").over(w.order)}
    same(framed(stored, seq, stage, before=1), framed(stored, PLAIN, stage, before=1))


def test_measured_picks_by_group_size(data):
    assert measured(data, WIDE, limit=1000).bucket is None
    assert measured(data, WIDE, limit=100).bucket == WIDE.bucket
    sized = measured(data, Sequence(("k",), ("t", "id"), axis="t"), limit=100)
    assert sized.bucket.startswith("floor((t) / ")
    counts = data.filter("t is not null").groupBy("k", F.expr(sized.bucket)).count().agg(F.max("count")).first()[0]
    assert counts <= 100
    same(with_position(data, sized, "p"), with_position(data, PLAIN, "p"))


def test_join_stats_keeps_every_row_once(data):
    totals = data.groupBy("k").agg(F.sum("v").alias("s"))
    same(join_stats(data, totals, ["k"], ["id"]), data.join(totals, "k", "left"))
    big = data.groupBy("k").count().filter("count > 20").select("k")
    same(join_stats(data, big, ["k"], ["id"], "left_semi"), data.join(big, "k", "left_semi"))


def test_ordered_fold_keeps_state_across_batches(spark, data):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        def step(state, part):
            seen = list(range(state["n"], state["n"] + len(part)))
            state["n"] += len(part)
            return part.assign(n=seen)[["k", "id", "n"]]

        out = ordered_fold(data.filter("t is not null"), ["k"], ["t", "id"], lambda: {"n": 0}, step, "k int, id int, n long")
        expected = with_position(data.filter("t is not null"), PLAIN, "n").select("k", "id", "n")
        same(out, expected)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_result_does_not_depend_on_partitioning(spark, data):
    stage = lambda w: {"s": F.sum("v").over(w.rows(-3, 0))}
    one = rows(framed(data.coalesce(1), WIDE, stage, before=3).select("id", "s"), "id")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        assert rows(framed(data.repartition(20, "v"), WIDE, stage, before=3).select("id", "s"), "id") == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
