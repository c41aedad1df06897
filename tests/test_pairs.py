import math
import random

import pytest
from pyspark.sql import functions as F

from pathloom.operators import pairs, subgraphs, walks
from tests.test_searches import random_graphs, tables


def cells(kernel):
    return {(r.i, r.j): r.k for r in kernel.collect() if r.k}


@pytest.mark.parametrize("block", [64, 1])
def test_blocks_agree_with_labels_and_joins(spark, monkeypatch, block):
    monkeypatch.setattr(pairs, "BLOCK_GRAPHS", block)
    n, e = tables(spark, *random_graphs(17, 9))
    w = n.select("g", "id", (0.5 + 0.1 * n["id"]).alias("w"))
    for kernel in (walks.walk_kernel, walks.marginal_kernel):
        want = cells(kernel(n, e, w, 0.7, 4, "joins"))
        assert cells(kernel(n, e, w, 0.7, 4, "blocks")) == pytest.approx(want) == cells(kernel(n, e, w, 0.7, 4, "features"))
    counts = lambda s: {(r.i, r.j, r.len): r.n for r in walks.walk_counts(n, e, 5, s).collect()}
    assert counts("blocks") == counts("features")


def test_straight_walks_agree_with_labels(spark, monkeypatch):
    n, e = tables(spark, *random_graphs(4, 6))
    w = n.select("g", "id", (0.5 + 0.1 * n["id"]).alias("w"))
    for kernel in (walks.nontottering_kernel, walks.nontottering_marginal_kernel):
        want = cells(kernel(n, e, w, 0.6, 5))
        with monkeypatch.context() as m:
            m.setattr(walks, "SHORT_WALKS", 0)
            assert cells(kernel(n, e, w, 0.6, 5)) == pytest.approx(want)


def test_convergence_equals_a_long_run(spark):
    n, e = tables(spark, *random_graphs(11, 6))
    ones = walks.constant_weights(n)
    assert cells(walks.marginal_kernel(n, e, ones, 0.8, 10_000, epsilon=1e-12)) == pytest.approx(cells(walks.marginal_kernel(n, e, ones, 0.8, 300)))
    rounds = pairs.to_kernel(walks.marginal_levels(n, e, ones, 0.8, 10_000, epsilon=1e-12))
    assert 10 < rounds.agg(F.max("rounds")).first()[0] < 300


def test_state_does_not_grow_with_length(spark):
    """The label walks of random chains double with each step; the rows of ``blocks`` are the levels alone."""
    chain = [(g, k, "ab"[(k * k + g * k) % 7 % 2]) for g in range(3) for k in range(40)]
    n = spark.createDataFrame(chain, "g long, id int, sym string")
    e = spark.createDataFrame([(g, k, k + 1, (k * g) % 3 - 1) for g in range(3) for k in range(39)], "g long, src int, dst int, chg int")
    one = F.lit(1)
    own, arcs = n.select("*", one.alias("a"), one.alias("s"), one.alias("q")), walks._plain_arcs(e)
    labels = [walks.walk_features(own, arcs, k).where(F.col("len") == k).count() for k in (4, 8)]
    assert labels[1] > 4 * labels[0]
    found = walks.walk_counts(n, e, 30)
    assert found.count() <= 6 * 30 and found.agg(F.max("len")).first()[0] == 30


def test_odd_graphs(spark):
    n = spark.createDataFrame([(1, 0, "x"), (2, 5, "x"), (2, 7, "y"), (3, 1, "z")], "g long, id int, sym string")
    e = spark.createDataFrame([(2, 5, 7, 1)], "g long, src int, dst int, chg int")
    got = {(r.i, r.j, r.len): r.n for r in walks.walk_counts(n, e, 9).collect()}
    assert {k: v for k, v in got.items() if k[2] == 1} == {(1, 1, 1): 1, (2, 1, 1): 1, (2, 2, 1): 2, (3, 3, 1): 1}
    assert all(v == 2 for k, v in got.items() if k[:2] == (2, 2)) and len(got) == 12
    assert walks.walk_counts(n.limit(0), e.limit(0), 9).collect() == []


def test_spread_shortest_paths_agree(spark):
    n, e = tables(spark, *random_graphs(23, 6))
    assert cells(subgraphs.shortest_path_kernel(n, e, 0.9, "joins")) == pytest.approx(cells(subgraphs.shortest_path_kernel(n, e, 0.9)))
    sizes = lambda f: {(r.g, r.size): r.n for r in f.groupBy("g", "size").agg(F.sum("n").alias("n")).collect()}
    assert sizes(subgraphs.spread_shortest_path_features(n, e)) == sizes(subgraphs.shortest_path_features(n, e))
    assert subgraphs.spread_shortest_path_features(n.limit(0), e.limit(0)).collect() == []


def written(n, e):
    """Symbols by (graph, node) and neighbours with their change by (graph, node)."""
    sym = {(r.g, r.id): r.sym for r in n.collect()}
    near: dict = {}
    for r in e.collect():
        near.setdefault((r.g, r.src), []).append((r.dst, r.chg))
        near.setdefault((r.g, r.dst), []).append((r.src, r.chg))
    return sym, near


def product_walks(sym, near, length):
    """All walks of product graphs: lists of points (i, j, a1, a2), j <= i."""
    now = [[(g, h, a, b)] for g, a in sym for h, b in sym if h <= g and sym[g, a] == sym[h, b]]
    yield from now
    for _ in range(length - 1):
        now = [
            [*w, (i, j, x, y)] for w in now for i, j, a, b in [w[-1]]
            for x, c in near.get((i, a), ()) for y, d in near.get((j, b), ()) if c == d and sym[i, x] == sym[j, y]
        ]
        yield from now


def test_path_levels_equal_walks_written_out(spark):
    n, e = tables(spark, *random_graphs(29, 6))
    sym, near = written(n, e)
    w = {(g, a): 0.5 + 0.1 * a for g, a in sym}
    point = lambda p: 0.7 * w[p[0], p[2]] * w[p[1], p[3]]
    want, heavy = {}, {}
    for walk in product_walks(sym, near, 5):
        key = (*walk[0][:2], len(walk))
        turns = list(zip(walk, walk[2:]))
        if all(x != y for x, y in turns):
            n_, c = want.get(key, (0, 0))
            kept = all(x[2] != y[2] and x[3] != y[3] for x, y in turns)
            want[key] = (n_ + 1, c + kept)
            if kept:
                heavy[key] = heavy.get(key, 0) + math.prod(point(p) for p in walk)
    assert {(r.i, r.j, r.len): (r.n, r.corrected) for r in walks.path_counts(n, e, 5).collect()} == want
    assert any(a != b for a, b in want.values())
    weights = n.select("g", "id", (0.5 + 0.1 * n["id"]).alias("w"))
    got = {(r.i, r.j, r.len): r.k for r in walks.path_levels(n, e, 5, True, weights, 0.7).collect()}
    assert got == pytest.approx(heavy)


def test_distance_kernel_equals_walks_written_out(spark):
    n, e = tables(spark, *random_graphs(31, 5))
    sym, near = written(n, e)
    far = {(g, a): (7 * a + g) % 4 for g, a in sym if (a + g) % 5}
    distance = spark.createDataFrame([(g, a, far.get((g, a))) for g, a in sym], "g long, id int, dist int")
    logistic = lambda mean: 1 / (1 + math.exp(1.5 * (mean - 0.5)))
    sums, alone, ends = {}, {}, {}
    now = [(g, [a]) for g, a in far]
    for k in range(1, 5):
        for g, walk in now:
            total = sum(far[g, a] for a in walk)
            sums[g, walk[0], k, total] = sums.get((g, walk[0], k, total), 0) + 1
            alone[g, k] = alone.get((g, k), 0) + logistic(total / k) / (2 if k > 1 else 1)
        now = [(g, [*walk, b]) for g, walk in now for b, _ in near.get((g, walk[-1]), ()) if (g, b) in far]
    for walk in product_walks(sym, near, 4):
        if all((i, a) in far and (j, b) in far for i, j, a, b in walk):
            one, two = ends.setdefault((len(walk), walk[0]), [0, 0])
            ends[len(walk), walk[0]] = [one + logistic(sum(far[p[0], p[2]] for p in walk) / len(walk)), two + logistic(sum(far[p[1], p[3]] for p in walk) / len(walk))]
    want = {}
    for (k, p), (one, two) in ends.items():
        want[p[:2]] = want.get(p[:2], 0) + 0.8**k * one * two / (2 if k > 1 else 1) / (alone[p[0], k] * alone[p[1], k])
    assert {(r.g, r.id, r.len, r.total): r.n for r in walks.distance_sums(n, e, distance, 4).collect()} == sums
    assert cells(walks.distance_kernel(n, e, distance, 1.5, 0.8, 4)) == pytest.approx(want)


def test_odd_path_levels(spark):
    n = spark.createDataFrame([(1, 0, "x"), (2, 5, "x"), (2, 7, "y"), (3, 1, "z")], "g long, id int, sym string")
    e = spark.createDataFrame([(2, 5, 7, 1)], "g long, src int, dst int, chg int")
    got = {(r.i, r.j, r.len): (r.n, r.corrected) for r in walks.path_counts(n, e, 9).collect()}
    assert got == {(1, 1, 1): (1, 1), (2, 1, 1): (1, 1), (2, 2, 1): (2, 2), (3, 3, 1): (1, 1), (2, 2, 2): (2, 2)}
    none = n.select("g", "id", F.lit(None).cast("int").alias("dist"))
    assert walks.distance_sums(n, e, none, 3).collect() == [] == walks.distance_kernel(n, e, none, 1.0, 0.8, 3).collect()
    assert walks.path_counts(n.limit(0), e.limit(0), 3).collect() == [] == walks.distance_kernel(n.limit(0), e.limit(0), none.limit(0), 1.0, 0.8, 3).collect()


@pytest.mark.parametrize("straight", [False, True])
def test_pieces_of_a_large_graph_give_its_levels(monkeypatch, straight):
    """A chain with side branches, cut to pieces of five starts: what a task holds is a piece, and the sums are the same."""
    monkeypatch.setattr(pairs, "PIECE_NODES", 5)
    monkeypatch.setattr(pairs, "PIECES_OVER", 4.0)

    def packed(g, size):
        links = [(k, k + 1) for k in range(size - 1)] + [(k, size + k) for k in range(0, size, 4)]
        arcs = sorted(links + [(b, a) for a, b in links])
        ids = list(range(size + size))
        own = {c: [1.0 + (k * m) % 7 / 7 for k in ids] for c, m in (("a", 2), ("s", 3), ("q", 5))}
        ways = {c: [1.0 + (a + m * b) % 3 / 3 for a, b in arcs] for c, m in (("p", 1), ("first", 2), ("out", 3), ("into", 4), ("e", 5))}
        return {"g": g, "ids": ids, "syms": ["AAB"[k % 3] for k in ids], **own, "src": [a for a, _ in arcs], "dst": [b for _, b in arcs], "chg": [0] * len(arcs), **ways}

    def levels(x, y):
        codes = {}
        x, y = pairs.Graph(x, codes), pairs.Graph(y, codes)
        product = pairs.Product(x, y, len(codes), 0.5)
        return [k for k, _ in zip(product.straight_levels() if straight else product.walk_levels(), range(5))]

    one, two = packed(1, 17), packed(2, 23)
    parts = [pairs._pieces(row, 4, "a" if straight else "q") for row in (one, two)]
    assert all(len(p) > 3 and max(len(x["ids"]) for x in p) < len(row["ids"]) for p, row in zip(parts, (one, two)))
    sums = [sum(at) for at in zip(*(k + [0.0] * (5 - len(k)) for x in parts[0] for y in parts[1] for k in [levels(x, y)]))]
    assert sums == pytest.approx(levels(one, two))


def test_a_factor_is_no_product_of_roots(spark):
    """Half of a tenth of what is counted: a root's square is not quite 0.2, and the sum is no more what it is rounded from."""
    n = spark.createDataFrame([(1, 0, "x")], "g long, id int, sym string")
    e = spark.createDataFrame([], "g long, src int, dst int, chg int")
    for options in ({}, {"epsilon": 1e-13}):
        assert walks.walk_kernel(n, e, walks.constant_weights(n), 0.2, 4, **options).first().k == 0.2


def test_distance_sums_shuffle_graphs_and_not_their_walks(spark):
    from pathloom.operators import paths

    n, e = tables(spark, *random_graphs(15, 4))
    distance = n.select("g", "id", F.col("id").alias("dist"))
    count = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    dealt = paths.as_graphs(n.join(distance, ["g", "id"]).select("g", "id", F.col("dist").alias("sym")), e)
    assert count(walks.distance_sums(n, e, distance, 4)) == count(dealt)


def test_nodes_of_one_symbol_meet_in_many_tasks(spark):
    n = spark.createDataFrame([(g, i, "x") for g in range(3) for i in range(200)], "g long, id int, sym string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = walks.product_nodes(n)
        assert found.where("rand() >= 0").count() == 6 * 200 * 200
        sizes = [r[1] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(sizes) > 1 and max(sizes) < 240_000 * 0.6


@pytest.mark.parametrize("whole", [True, False])
def test_walks_counted_by_their_middle(monkeypatch, spark, whole):
    """Odd and even lengths, uncut and in pieces, with loops, double edges and lone arcs, against the product graphs as tables."""
    monkeypatch.setattr(pairs, "COUNTED_NODES", 100 if whole else 6)
    rnd = random.Random(4)
    nodes = [(g, i, rnd.choice("ab")) for g, size in ((1, 40), (2, 25), (3, 2), (4, 1)) for i in range(size)]
    edges = [(g, i, i + 1, rnd.choice((0, 0, 1))) for g, size in ((1, 40), (2, 25), (3, 2)) for i in range(size - 1)] + [(1, 3, 3, 0), (2, 4, 5, 0)]
    n, e = spark.createDataFrame(nodes, "g long, id int, sym string"), spark.createDataFrame(edges, "g long, src int, dst int, chg int")
    for length in (7, 8):
        got, want = ({(r.i, r.j, r.len): r.n for r in walks.walk_counts(n, e, length, s).collect()} for s in (None, "joins"))
        assert got == want


def test_a_round_gives_two_levels_of_counts(monkeypatch):
    row = dict(g=1, ids=list(range(50)), syms=["a"] * 50, a=[1.0] * 50, s=[1.0] * 50, q=[1.0] * 50, src=[*range(49), *range(1, 50)], dst=[*range(1, 50), *range(49)], chg=[0] * 98, p=[1.0] * 98)
    graph = pairs.Graph(row, codes := {})
    want = [k for k, _ in zip(pairs.Product(graph, graph, len(codes)).walk_levels(), range(20))]
    sums, real = [], pairs.np.bincount

    def counted(*args, **kw):
        sums.append(len(args))
        return real(*args, **kw)

    monkeypatch.setattr(pairs.np, "bincount", counted)
    assert [k for k, _ in zip(pairs.Product(graph, graph, len(codes)).count_levels(), range(20))] == want
    assert sum(n == 3 for n in sums) <= 11 + 2
