"""Products over labels of shortest paths, held against labels written out."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from pathloom.operators import shortest, subgraphs


def graphs_of(seed, count, size, symbols):
    rng = random.Random(seed)
    nodes, edges = [], []
    for g in range(count):
        nodes += [(g, 3 * i, rng.choice(symbols)) for i in range(size)]
        edges += [(g, 3 * i, 3 * rng.randrange(i), rng.choice((-1, 0, 1))) for i in range(1, size)] + [(g, 0, 3 * rng.randrange(1, size), 0) for _ in range(3)]
    return nodes, edges


def tables(spark, nodes, edges):
    return spark.createDataFrame(nodes, "g long, id int, sym string"), spark.createDataFrame(edges, "g long, src int, dst int, chg int")


@pytest.mark.parametrize("symbols", [["A", "B"], ["C", "Cl", "N"]])
@pytest.mark.parametrize("strategy", ["graphs", "joins"])
def test_products_equal_labels_written_out(spark, symbols, strategy):
    n, e = tables(spark, *graphs_of(5, 5, 30, symbols))
    n, e = n.union(n.where("g = 0").selectExpr("g + 9", "id", "sym")), e.union(e.where("g = 0").selectExpr("g + 9", "src", "dst", "chg"))  # a copy shares all labels
    by = defaultdict(Counter)
    for r in subgraphs.shortest_path_features(n, e).collect():
        by[r.g][r.feature, r.size] += r.n
    want = {(i, j, size): 0 for i in by for j in by for _, size in by[i] if j <= i}
    for i, j, size in want:
        want[i, j, size] = sum(k * by[j][f] for f, k in by[i].items() if f[1] == size)
    found = shortest.shortest_path_products(n, e, 1.0, strategy == "joins").groupBy("i", "j", "size").sum("p").collect()
    assert {tuple(r)[:3]: r[3] for r in found} == {k: v for k, v in want.items() if v}


def test_long_chains_write_no_labels(spark):
    """A chain of 1,500 nodes has 2,248,500 labels of up to 3,000 characters; few of them are rows here."""
    rng = random.Random(2)
    nodes = [(g, i, rng.choice("ABCDE")) for g in range(2) for i in range(1500)]
    n, e = tables(spark, nodes, [(g, i, i + 1, 0) for g in range(2) for i in range(1499)])
    found = shortest.shortest_path_products(n, e, 1.0, False)
    assert {r.size: r.p for r in found.where("i = 1 and j = 1 and size > 40").collect()} == {s: 2 * (1501 - s) for s in range(41, 1501)}
    graph = shortest._Graph(range(1500), [s for g, _, s in nodes if g == 0], range(1499), range(1, 1500), [0] * 1499)
    none = np.array([], "V16")
    rows = sum(b.num_rows for b in shortest._walked(0, graph, np.arange(1500), none, 8, 1500, True))
    assert rows == 1500 - 8


def test_wide_rounds_are_cut_by_starts(monkeypatch):
    nodes, edges = graphs_of(8, 1, 80, ["A", "B"])
    graph = shortest._Graph([i for _, i, _ in nodes], [s for *_, s in nodes], *zip(*(r[1:] for r in edges)))

    def counted():
        found = Counter()
        for batch in shortest._walked(0, graph, np.arange(80), np.array([], "V16"), 1, 80, True):
            for _, size, a, b, n in zip(*(c.to_pylist() for c in batch.columns)):
                found[size, a, b] += n
        return found

    whole = counted()
    monkeypatch.setattr(shortest, "WIDE", 500)
    assert counted() == whole


def test_later_sizes_leave_the_sum_as_it_is():
    """Two graphs of one label each size: all further terms together are added one by one and change nothing."""
    last = shortest.last_size(0.9, 200_000)
    total = sum(0.9**s * 200_000**4 for s in range(2, last + 1))
    low = 0.9**2
    for s in range(last + 1, last + 2_000):
        assert low + 0.9**s * 200_000**4 == low and total + 0.9**s * 200_000**4 == total
    assert shortest.last_size(1.0, 200_000) == 200_000 and shortest.last_size(0.9, 50) == 50
