"""Trees are parsed where their lines lie."""

import pytest
from pyspark.sql import functions as F

from pathloom.operators import adapters, forest
from pathloom.plans import catalogue
from pathloom.sinks import text as sink
from tests.conftest import SF_SMALL
from tests.test_dealt_once import exchanges


@pytest.mark.parametrize("held", [20_000, 1])
def test_trees_with_their_flags(monkeypatch, spark, held):
    monkeypatch.setattr(forest, "LINES", held)
    lines = spark.createDataFrame([(1, 1, "(C(C[O])(N))"), (1, 2, "(A)(B{C})"), (2, 1, "(C(C[O])(N))"), (2, 2, None), (2, 3, ""), (2, 4, "(Cl()[Br])")], "entry long, tree long, line string")
    tree = [(0, None, "(", "C", 1, False, True), (1, 0, "(", "C", 2, False, False), (2, 1, "[", "O", 3, True, True), (3, 0, "(", "N", 2, True, True)]
    two = [(0, None, "(", "A", 1, True, False), (1, None, "(", "B", 1, False, True), (2, 1, "{", "C", 2, True, True)]
    odd = [(0, None, "(", "Cl", 1, False, True), (1, 0, "(", "", 2, True, False), (2, 0, "[", "Br", 2, True, True)]
    want = [(e, t, *n) for e, t, nodes in ((1, 1, tree), (1, 2, two), (2, 1, tree), (2, 4, odd)) for n in nodes]
    found = forest.parse_trees(lines)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert "Exchange" not in forest.parse_trees(lines)._jdf.queryExecution().executedPlan().toString()


def test_a_roundtrip_shuffles_lines_and_sums(spark):
    assert exchanges(catalogue.QUERIES["sequence_roundtrip"](spark, SF_SMALL)) == 2


def test_tries_of_equal_graphs_are_equal(monkeypatch, spark):
    graphs = adapters.order_graphs(spark, SF_SMALL, closed=True)
    once = sorted(map(tuple, sink.sequences(*graphs).collect()))
    monkeypatch.setattr(sink, "FORM_NODES", 0)
    assert once == sorted(map(tuple, sink.sequences(*graphs).collect())) and len(once) > 100
    assert sink.sequences(*adapters.order_ring(spark, SF_SMALL)).where(F.col("line").isNull()).count() == 0
