"""Paths of a graph that are passed on in parts."""

import random
from collections import Counter

from pathloom.operators import kernels, paths


def chain(n, seed=3):
    rng = random.Random(seed)
    return list(range(n)), [rng.choice("ABC") for _ in range(n)], list(range(n - 1)), list(range(1, n)), [rng.choice((-1, 0, 1)) for _ in range(n - 1)]


def test_parts_hold_few_paths_and_add_up():
    graph = chain(300)
    whole = paths.walk_graph(*graph, 20)
    parts = list(paths.walk_parts(*graph, 20, 500))
    assert len(whole) > 5_000 and max(map(len, parts)) <= 501
    assert sum(parts, Counter()) == whole


def test_parts_give_the_table_of_graphs(spark, monkeypatch):
    monkeypatch.setattr(paths, "HELD", 50)
    ids, syms, src, dst, chg = chain(60)
    nodes = spark.createDataFrame([(g, i, s) for g in range(3) for i, s in zip(ids, syms)], "g long, id int, sym string")
    edges = spark.createDataFrame([(g, *e) for g in range(3) for e in zip(src, dst, chg)], "g long, src int, dst int, chg int")
    table = lambda strategy: sorted(tuple(r) for r in paths.path_table(nodes, edges, 9, strategy).collect())
    assert table("parts") == table("graphs")


def test_products_move_no_text(spark):
    table = spark.createDataFrame([(1, "(A{B", 2, 2), (2, "(A[B", 2, 3), (2, "(A", 1, 1), (1, "(A", 1, 5)], "g long, path string, len int, freq long")
    facts = kernels.hashed(table)
    assert "string" not in dict(facts.dtypes).values()
    found = {(r.dir, r.i, r.j, r.len): (r.float, r.ind, r.core) for r in kernels.path_products(facts).collect()}
    assert found["fb", 1, 2, 2] == (6, 1, True) and found["ff", 1, 2, 1] == (5, 1, False) and ("ff", 1, 2, 2) not in found
