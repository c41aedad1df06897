import random
from itertools import combinations, islice, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.functions import matrices
from pathloom.operators import graphs, kernels, mapping, subgraphs, textindex, walks
from pathloom.plans import catalogue
from tests.conftest import SF_TEST
from tests.test_paths import random_graphs, tables


def side(rng, n):
    return [rng.choice("CCN") for _ in range(n)], [(a, b) for a in range(n) for b in range(a) if rng.random() < 0.4]


@pytest.mark.parametrize("seed", range(12))
def test_mappings(seed):
    rng = random.Random(seed)
    lhs = side(rng, 6)
    order = list(range(6))
    rng.shuffle(order)
    rhs = ([lhs[0][k] for k in order], side(rng, 6)[1])
    best = min(mapping.cost(lhs, rhs, dict(enumerate(p))) for p in permutations(range(6)) if all(lhs[0][i] == rhs[0][j] for i, j in enumerate(p)))
    for search in (mapping.astar, mapping.dfs):
        image, price, status = search(lhs, rhs)
        assert price == best == mapping.cost(lhs, rhs, image) and status == "optimal" and sorted(image.values()) == list(range(6))
    assert mapping.bond_bound(lhs, rhs) <= best
    for name in ("greedy", "hungarian", "cliques"):
        image, price, _ = mapping.ALGORITHMS[name](lhs, rhs)
        assert price == mapping.cost(lhs, rhs, image) and all(lhs[0][a] == rhs[0][b] for a, b in image.items())
        assert len(set(image.values())) == len(image)
        if len(image) == 6:
            assert price >= best


def longest_orders(spark, lines):
    sides = catalogue._line_reactions(spark, SF_TEST).where(f"size(syms1) >= {lines}")
    pairs = lambda edges: [(e["a"], e["b"]) for e in edges]
    return {r["reaction"]: ((r["syms1"], pairs(r["edges1"])), (r["syms2"], pairs(r["edges2"]))) for r in sides.collect()}


def test_mappings_of_the_longest_orders(spark):
    got = {r.reaction: (r.cost, r.status) for r in catalogue.QUERIES["atom_mapping_astar"](spark, SF_TEST).collect()}
    assert {status for _, status in got.values()} == {"optimal"}
    for reaction, (lhs, rhs) in longest_orders(spark, 11).items():
        assert mapping.dfs(lhs, rhs)[1] == got[reaction][0]


def test_largest_common_subgraphs(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(mapping, "map_reactions", lambda sides, algorithm, **options: asked.append(options) or sides.selectExpr("reaction", "0 AS cost", "'' AS status"))
    catalogue.QUERIES["atom_mapping_cliques"](spark, SF_TEST)
    assert asked == [{}]  # nothing ends the search early
    for lhs, rhs in longest_orders(spark, 12).values():
        one, two = ((list(range(len(s))), s, [a for a, _ in e], [b for _, b in e], [0] * len(e)) for s, e in (lhs, rhs))
        pairs, near = subgraphs.association_graph(one, two)
        found = subgraphs.common_subgraph(one, two)
        assert len(found) >= max(map(len, islice(subgraphs.maximal_cliques(near), 2_000)))
    rng = random.Random(9)
    for _ in range(60):
        one, two = graph(rng, 7), graph(rng, 7)
        pairs, near = subgraphs.association_graph(one, two)
        found = subgraphs.common_subgraph(one, two)
        places = [pairs.index(p) for p in found]
        assert all(b in near[a] for a, b in combinations(places, 2))
        assert len(found) == max(map(len, subgraphs.maximal_cliques(near)))


@pytest.mark.parametrize("seed", range(5))
def test_assignment(seed):
    rng = random.Random(seed)
    w = [[rng.random() for _ in range(6)] for _ in range(5)]
    found = mapping.assignment(w)
    assert len(set(found)) == 5
    assert sum(w[i][j] for i, j in enumerate(found)) == pytest.approx(max(sum(w[i][j] for i, j in enumerate(p)) for p in permutations(range(6), 5)))


def graph(rng, n, p=0.45):
    edges = [(a, b) for a in range(n) for b in range(a) if rng.random() < p]
    return list(range(n)), [rng.choice("CN") for _ in range(n)], [a for a, _ in edges], [b for _, b in edges], [rng.choice([0, 1]) for _ in edges]


@pytest.mark.parametrize("seed", range(10))
def test_isomorphism_and_cliques(seed):
    rng = random.Random(seed)
    one = graph(rng, 6)
    order = list(range(6))
    rng.shuffle(order)
    two = (list(range(6)), [one[1][order.index(i)] for i in range(6)], [order[a] for a in one[2]], [order[b] for b in one[3]], one[4])
    image = subgraphs.isomorphism(one, two)
    assert image is not None and all(one[1][a] == two[1][b] for a, b in image.items())
    other = graph(rng, 6)
    links = lambda g: {frozenset(e): c for *e, c in zip(g[2], g[3], g[4])}
    exists = any(all(one[1][i] == other[1][p[i]] for i in range(6)) and {frozenset(p[x] for x in e): c for e, c in links(one).items()} == links(other) for p in permutations(range(6)))
    assert (subgraphs.isomorphism(one, other) is not None) == exists
    part = [0, 1, 2]
    small = (part, one[1][:3], *map(list, zip(*[(a, b, c) for a, b, c in zip(*one[2:]) if a < 3 and b < 3]))) if any(a < 3 and b < 3 for a, b in zip(one[2], one[3])) else (part, one[1][:3], [], [], [])
    assert subgraphs.isomorphism(small, two) is not None

    near = {i: set() for i in range(6)}
    for a, b in zip(one[2], one[3]):
        near[a].add(b)
        near[b].add(a)
    full = lambda s: all(b in near[a] for a, b in combinations(s, 2))
    every = [set(c) for k in range(1, 7) for c in combinations(range(6), k) if full(c)]
    assert sorted(map(sorted, subgraphs.maximal_cliques(near))) == sorted(sorted(c) for c in every if not any(c < d for d in every))
    assert sorted(subgraphs.connected_sets({k: sorted(v) for k, v in near.items()}, 4), key=str) and len({frozenset(s) for s in subgraphs.connected_sets({k: sorted(v) for k, v in near.items()}, 4)}) == sum(1 for k in range(1, 5) for c in combinations(range(6), k) if connected(c, near))


def connected(nodes, near):
    seen, open_ = set(), [nodes[0]]
    while open_:
        x = open_.pop()
        if x not in seen:
            seen.add(x)
            open_ += [y for y in near[x] if y in nodes]
    return len(seen) == len(nodes)


def test_common_subgraph():
    rng = random.Random(1)
    one = graph(rng, 5)
    assert len(subgraphs.common_subgraph(one, one)) == 5


def dense(kernel, n):
    k = np.zeros((n, n))
    for r in kernel.collect():
        k[r.i, r.j] = k[r.j, r.i] = r.k
    return k


def test_kernels_are_positive_semidefinite(spark):
    n, e = tables(spark, *random_graphs(21, 8))
    ones = walks.constant_weights(n)
    for kernel in (walks.walk_kernel(n, e, ones, 0.4, 3), subgraphs.shortest_path_kernel(n, e, 0.9), subgraphs.subgraph_kernel(n, e, 3), walks.marginal_kernel(n, e, ones, 0.8, 3)):
        k = dense(kernels.normalized(kernel), 8)
        d = np.diag(k)  # a graph of one node has no path between two
        assert np.allclose(d * (1 - d), 0) and matrices.is_kernel(k)


def test_walk_probabilities_add_up(spark):
    n, e = tables(spark, *random_graphs(5, 6))
    ends, moves = walks.walk_probabilities(n, e, walks.constant_weights(n), 0.7)
    left = {}
    for r in moves.collect():
        left[r.g, r.src] = left.get((r.g, r.src), 0) + r.pt
    starts = {}
    for r in ends.collect():
        assert r.pe + left.get((r.g, r.id), 0) == pytest.approx(1)
        starts[r.g] = starts.get(r.g, 0) + r.ps
    assert all(v == pytest.approx(1) for v in starts.values())


def test_strategies_of_walk_kernels_agree(spark):
    n, e = tables(spark, *random_graphs(17, 9))
    w = n.select("g", "id", (0.5 + 0.1 * n["id"]).alias("w"))
    for kernel in (lambda s: walks.walk_kernel(n, e, w, 0.7, 4, s), lambda s: walks.marginal_kernel(n, e, w, 0.7, 4, s)):
        got, want = ({(r.i, r.j): r.k for r in kernel(s).collect() if r.k} for s in ("features", "joins"))
        assert got == pytest.approx(want)
    got, want = ({(r.i, r.j, r.len): r.n for r in walks.walk_counts(n, e, 4, s).collect()} for s in ("features", "joins"))
    assert got == want
    sizes = {(r.i, r.j): (r.nodes, r.edges) for r in walks.product_sizes(n, e).collect()}
    count = lambda t: {(r.i, r.j): r["count"] for r in t.groupBy("i", "j").count().collect()}
    points, links = count(walks.product_nodes(n)), count(walks.product_edges(n, e))
    assert sizes == {k: (v, links.get(k, 0)) for k, v in points.items()}


def test_second_order_walks_by_enumeration(spark):
    nodes, edges = random_graphs(8, 3)
    n, e = tables(spark, nodes, edges)
    lam, length = 0.6, 4
    near, label = {}, {(g, i): s for g, i, s in nodes}
    for g, i, _ in nodes:
        near[g, i] = {}
    for g, a, b, c in edges:
        near[g, a][b] = near[g, b][a] = c

    def all_walks(g):
        size = sum(x == g for x, *_ in nodes)
        out = []

        def go(walk, p):
            g_, at = g, walk[-1]
            choice = [x for x in near[g_, at] if len(walk) < 2 or x != walk[-2]]
            out.append((tuple(walk), p * ((1 - lam) if choice else 1)))
            if len(walk) < length:
                for x in choice:
                    go([*walk, x], p * lam / len(choice))

        for i in range(size):
            go([i], 1 / size)
        return out

    told = lambda g, w: (tuple(label[g, i] for i in w), tuple(near[g, a][b] for a, b in zip(w, w[1:])))
    got = {(r.i, r.j): r.k for r in walks.nontottering_marginal_kernel(n, e, walks.constant_weights(n), lam, length).collect()}
    for i in range(3):
        for j in range(i + 1):
            want = sum(p * q for w, p in all_walks(i) for v, q in all_walks(j) if told(i, w) == told(j, v))
            assert got.get((i, j), 0) == pytest.approx(want)


def test_partial_normalisation_and_reaction_graphs(spark):
    n, e = tables(spark, *random_graphs(13, 5))
    levels = walks.marginal_levels(n, e, walks.constant_weights(n), 0.8, 3)
    k = dense(walks.partially_normalized(levels), 5)
    assert np.all(np.diag(k) <= 3 + 1e-9)
    same = spark.createDataFrame([(a, b, 1.0 if a == b else 0.0) for a in "CNO" for b in "CNO"], "a string, b string, k double")
    plain = dense(walks.marginal_kernel(n, e, walks.constant_weights(n), 0.8, 3), 5)
    assert np.allclose(dense(walks.reaction_graph_kernel(n, e, same, 0.8, 3), 5), plain)


def test_diffusion(spark):
    h = matrices.diffusion_matrix(3, [(0, 1), (1, 2)], 0.5)
    assert np.allclose(h.sum(axis=0), 1) and matrices.is_kernel(h / h.max())
    n, e = tables(spark, [(0, 0, "C"), (0, 1, "C"), (0, 2, "O")], [(0, 0, 1, 0), (0, 1, 2, 1)])
    w = {r.id: r.w for r in matrices.diffusion_weights(n, e, 0.5).collect()}
    assert w[1] == pytest.approx(max(h[1, 1], h[2, 1])) and w[0] == pytest.approx(max(h[1, 0], h[2, 0]))
    assert {r.id: r.w for r in matrices.diffusion_weights(n, e, -0.5).collect()}[0] == pytest.approx(1 - w[0])


def test_reaction_graph_of_a_mapping(spark):
    lhs = spark.createDataFrame([(1, 0, 1, 1), (1, 1, 2, 2)], "reaction long, a int, b int, type int")
    rhs = spark.createDataFrame([(1, 0, 1, 1), (1, 0, 2, 1)], "reaction long, a int, b int, type int")
    image = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (1, 2, 2)], "reaction long, lhs_atom int, rhs_atom int")
    got = {(r.a, r.b): (r.old, r.new, r.chg) for r in mapping.reaction_graph(lhs, rhs, image).collect()}
    assert got == {(0, 1): (1, 1, 0), (1, 2): (2, 1, 0)}
    moved = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 2, 2)], "reaction long, lhs_atom int, rhs_atom int")
    got = {(r.a, r.b): (r.old, r.new, r.chg) for r in mapping.reaction_graph(lhs, rhs, moved).collect()}
    assert got == {(0, 1): (1, 1, 0), (1, 2): (2, 0, -1), (0, 2): (0, 1, 1)}
    assert graphs.least_cost(spark.createDataFrame([(1, 3), (1, 2), (1, 2), (2, 5)], "reaction long, cost int")).count() == 3


def test_text_index_against_plain_search(spark, tmp_path):
    rng = random.Random(6)
    texts = {i: "".join(rng.choice("abé\n\x00") for _ in range(rng.randrange(0, 80))) for i in range(60)} | {99: "ab" * 3000, 100: "x"}
    docs = spark.createDataFrame([*texts.items(), (101, None)], "doc_id long, text string")
    one = textindex.build_index(docs.where("doc_id < 50"), f"{tmp_path}/one")
    index = textindex.merge_indexes(one, textindex.build_index(docs.where("doc_id >= 50"), f"{tmp_path}/two"), f"{tmp_path}/all")
    for pattern in ("a", "ab", "abab", "ababa", "abé", "aéb\na", "bababababab", "zz", "x", "éé\x00"):
        want = sorted((i, k) for i, t in texts.items() for k in range(len(t)) if t.startswith(pattern, k))
        assert sorted((r.doc_id, r.pos) for r in textindex.index_locate(index, pattern).collect()) == want
        assert sorted((r.doc_id, r.pos) for r in textindex.locate(docs, pattern).collect()) == want


def test_suffixes_by_sorting(spark):
    rng = random.Random(7)
    texts = {i: "".join(rng.choice("abé") for _ in range(rng.randrange(0, 60))) for i in range(40)} | {99: "a" * 500, 100: "ab" * 300, 101: ""}
    docs = spark.createDataFrame([*texts.items(), (102, None)], "doc_id long, text string")
    runs = {r.doc_id: (r.length, r.runs) for r in textindex.transform_runs(docs).collect()}
    shared, back = {}, {}
    for r in textindex.common_prefixes(docs).collect():
        shared[r.doc_id, r.pos] = r.lcp
    for r in textindex.steps_back(docs).collect():
        back[r.doc_id, r.place] = r.back
    for i, t in texts.items():
        order = sorted(range(len(t) + 1), key=lambda k: t[k:] + "\x00")
        bwt = [t[k - 1] if k else "\x00" for k in order]
        assert runs[i] == (len(t) + 1, 1 + sum(a != b for a, b in zip(bwt, bwt[1:])))
        for a, b in zip(order, order[1:]):
            assert shared[i, b] == next(k for k in range(len(t) + 2) if t[a : a + k + 1] != t[b : b + k + 1] or k == len(t) - max(a, b))
        place, out = 0, []
        for _ in t:
            out.append(bwt[place])
            place = back[i, place]
        assert "".join(reversed(out)) == t
    assert set(runs) == set(texts)


def test_equal_reactions_are_searched_once(spark):
    asked = []

    def search(forms):
        asked.append(sorted(len(r.syms1) for r in forms.collect()))
        return forms.select("reaction", F.size("syms1").alias("n"))

    rows = [(1, ["A"], [], ["A"], []), (2, ["A"], [], ["A"], []), (3, ["A", "B"], [(0, 1)], ["B", "A"], []), (4, ["A"], None, ["A"], []), (4, ["A"], None, ["A"], [])]
    sides = spark.createDataFrame(rows, "reaction long, syms1 array<string>, edges1 array<struct<a:int,b:int>>, syms2 array<string>, edges2 array<struct<a:int,b:int>>")
    assert sorted(map(tuple, mapping.by_form(sides, search).collect())) == [(1, 1), (2, 1), (3, 2), (4, 1), (4, 1)]
    assert asked == [[1, 1, 2]]  # null edges are a form of their own
    assert {r.reaction: r.cost for r in mapping.map_reactions(sides, "dfs").collect()} == {1: 0, 2: 0, 3: 1, 4: 0}


def test_depth_first_search_leaves_hopeless_branches():
    """Two chains of like nodes: without a bound and a memory of states this takes factorially many of them."""
    chain, turned = [(k, k + 1) for k in range(8)], [(0, 3), (3, 6), (6, 1), (1, 4), (4, 7), (7, 2), (2, 5), (5, 8)]
    lhs, rhs = (list("AABAAAABA"), chain), (list("AABAAAABA"), turned)
    image, price, status = mapping.dfs(lhs, rhs, 500)
    assert status == "optimal" and price == mapping.astar(lhs, rhs)[1] == mapping.cost(lhs, rhs, image)
