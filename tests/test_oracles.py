"""Every registered query runs; those with an oracle equal it."""

from dataclasses import replace

import pytest

from strandline import sequence
from strandline.plans import catalogue, stand_ins
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    fn = catalogue.QUERIES[name]
    if name in catalogue.ORACLES:
        assert difference(spark, con, fn, catalogue.ORACLES[name], SF) is None
    else:
        assert fn(spark, SF).limit(1).count() == 1


BUCKETED = [
    n for n in sorted(catalogue.ORACLES)
    if n.startswith(("d3", "d5", "d6", "align", "f1_", "f2", "f4", "f5", "f6", "f7", "f8", "f9", "f10", "f12", "f13", "f14", "f15", "f18",
                     "e9", "i1_", "i5", "k11", "b17", "b24", "c13", "a10", "j1", "j2"))
]


@pytest.mark.parametrize("name", BUCKETED)
def test_query_with_every_key_hot(spark, con, name, monkeypatch):
    """The same oracles with the size limit lowered, so that every sequence takes the bucketed plan."""
    monkeypatch.setattr(sequence, "ROWS_PER_WINDOW", 24)
    for spec in ("EVENT_SEQ", "LINE_SEQ"):
        monkeypatch.setattr(stand_ins, spec, replace(getattr(stand_ins, spec), segment_rows=16))
    assert stand_ins.event_seq(spark, SF).bucket and stand_ins.line_seq(spark, SF).bucket
    assert difference(spark, con, catalogue.QUERIES[name], catalogue.ORACLES[name], SF) is None
