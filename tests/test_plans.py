"""The physical plans are the ones we want."""

import re
import pytest
from pyspark.sql import functions as F

from strandline.operators import align, features
from strandline.plans import catalogue, stand_ins
from strandline.sequence import framed

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(catalogue.QUERIES["d5_e1_nearest_frame_mean"](spark, SF))
    assert "EqualTo(event_type,view)" in text
    scans = re.findall(r"ReadSchema: (struct<[^\n]*?>)", text)
    assert scans and all("props" not in s or "value" in s for s in scans)


def test_first_per_key_trims_before_the_shuffle(spark):
    text = plan(align.first_per_key(stand_ins.lines(spark, SF), ["l_suppkey"], ["l_shipdate", "l_orderkey"]))
    assert text.count("WindowGroupLimit") == 2


def test_all_window_features_share_one_shuffle_and_sort(spark):
    out = features.rolling_summary(stand_ins.lines(spark, SF), stand_ins.LINE_SEQ, ["l_quantity", "l_tax"], [5, 10, 25])
    text = plan(out)
    assert text.count("Exchange hashpartitioning") == 1 and text.count("Sort [") == 1


def test_hot_key_plan_never_partitions_rows_by_key_alone(spark):
    out = framed(stand_ins.lines(spark, SF), stand_ins.LINE_SEQ.sized(30.0), lambda w: {"x": F.lag("l_tax").over(w.order)}, before=1)
    text = plan(out)
    wide = [line for line in text.splitlines() if "Exchange hashpartitioning(l_suppkey" in line]
    assert wide and any("__segment" in line for line in wide) and any("__bucket" in line for line in wide)


@pytest.mark.parametrize("name", sorted(n for n in catalogue.QUERIES if n[0] in "defhi" and n in catalogue.ORACLES))
def test_no_cross_products(spark, name):
    text = plan(catalogue.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
