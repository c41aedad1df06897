"""Nodes of product graphs: copies are shuffled, and core flags are keys of the join."""

from pathloom.operators import graphs, walks
from tests.test_searches import random_graphs, tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_copies_of_nodes_are_not_broadcast(spark):
    n, _ = tables(spark, *random_graphs(15, 4))
    assert "Broadcast" not in plan(walks.product_nodes(n))


def test_core_nodes_meet_core_nodes_by_a_key(spark):
    n, e = tables(spark, *random_graphs(15, 4))
    core = graphs.core_distance(n, e)
    want = sorted(map(tuple, walks.reduced(walks.product_nodes(n), core).collect()))
    found = walks.product_nodes(n, core=core)
    assert sorted(map(tuple, found.collect())) == want and want
    assert "c1" not in plan(found)
    both = walks.product_nodes(n, match_labels=False, core=core)
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, walks.reduced(walks.product_nodes(n, match_labels=False), core).collect()))
