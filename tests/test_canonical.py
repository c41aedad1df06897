import random
from itertools import combinations, permutations

import pytest
from pyspark.sql import functions as F

from pathloom.operators import canonical, mapping, subgraphs
from tests.test_searches import graph


def shuffled(rng, g):
    ids, syms, src, dst, chg = g
    order = list(ids)
    rng.shuffle(order)
    name = dict(zip(ids, order))
    rows = list(zip(*(([name[a] for a in src], [name[b] for b in dst], chg)))) or []
    rng.shuffle(rows)
    flip = [(b, a, c) if rng.random() < 0.5 else (a, b, c) for a, b, c in rows]
    back = sorted(range(len(ids)), key=lambda k: order[k])
    return [order[k] for k in back], [syms[k] for k in back], [a for a, *_ in flip], [b for _, b, _ in flip], [c for *_, c in flip]


@pytest.mark.parametrize("p", [0.15, 0.45, 0.8])
def test_forms_are_equal_just_for_isomorphic_graphs(p):
    rng = random.Random(p)
    some = [graph(rng, rng.choice([4, 5, 6]), p) for _ in range(40)]
    forms = [canonical.canonical_form(*g) for g in some]
    for g, form in zip(some, forms):
        assert all(canonical.canonical_form(*shuffled(rng, g)) == form for _ in range(3))
    for (a, x), (b, y) in combinations(zip(some, forms), 2):
        assert (x == y) == (len(a[0]) == len(b[0]) and subgraphs.isomorphism(a, b) is not None)


def test_symmetric_graphs_do_not_take_all_orders():
    rng = random.Random(1)
    n = 40
    alike = list(range(n)), ["C"] * n
    for edges in ([], list(combinations(range(n), 2)), [(i, (i + 1) % n) for i in range(n)], [(0, i) for i in range(1, n)], [(i, j) for i in range(20) for j in range(20, n)]):
        g = (*alike, [a for a, _ in edges], [b for _, b in edges], [0] * len(edges))
        assert canonical.canonical_form(*g) == canonical.canonical_form(*shuffled(rng, g))
    two_rings = [(i, (i + 1) % 3) for i in range(3)] + [(3 + i, 3 + (i + 1) % 3) for i in range(3)]
    one_ring = [(i, (i + 1) % 6) for i in range(6)]
    forms = [canonical.canonical_form(list(range(6)), ["C"] * 6, [a for a, _ in e], [b for _, b in e], [0] * 6) for e in (two_rings, one_ring)]
    assert forms[0] != forms[1]  # refinement alone can't tell these apart


def test_classes(spark):
    rng = random.Random(7)
    base = [graph(rng, 5) for _ in range(12)]
    graphs = [base[k % 12] if k < 12 else shuffled(rng, base[k % 12]) for k in range(48)] + [([], [], [], [], [])]
    nodes = [(g, i, s) for g, (ids, syms, *_) in enumerate(graphs) for i, s in zip(ids, syms)]
    edges = [(g, a, b, c) for g, (_, _, *e) in enumerate(graphs) for a, b, c in zip(*e)]
    n = spark.createDataFrame(nodes, "g long, id int, sym string")
    e = spark.createDataFrame(edges, "g long, src int, dst int, chg int")
    want = {g: next(h for h in range(g + 1) if subgraphs.isomorphism(graphs[h], graphs[g]) is not None) for g in range(48)}
    assert {r.g: r["class"] for r in canonical.isomorphism_classes(n, e).collect()} == want
    assert canonical.isomorphism_classes(n.limit(0), e.limit(0)).collect() == []


def brute_optima(lhs, rhs, context):
    unlike = mapping.difference(lhs, rhs, context)
    found = {}
    for images in permutations(range(len(rhs[0])), len(lhs[0])):
        if all(lhs[0][i] == rhs[0][j] for i, j in enumerate(images)):
            price = mapping.cost(lhs, rhs, dict(enumerate(images))), sum(unlike[i][j] for i, j in enumerate(images))
            found.setdefault(price, set()).add(images)
    return min(found.items()) if found else None


@pytest.mark.parametrize("seed", range(12))
def test_every_optimum(seed):
    rng = random.Random(seed)
    n = rng.choice([3, 5, 6])
    syms = [rng.choice("CCN") for _ in range(n)]
    side = lambda s: (s, [(a, b) for a, b in combinations(range(len(s)), 2) if rng.random() < 0.5])
    lhs, rhs = side(syms), side(rng.sample(syms + ["O"] * (seed % 2), n + seed % 2))
    for context in (0, 1, 2):
        for order in ("far", "bfs", "plain"):
            bonds, unlike, found = mapping.optima(lhs, rhs, context, order)
            found = list(found)
            (price, want) = brute_optima(lhs, rhs, context)
            assert (bonds, unlike) == price and set(found) == want and len(found) == len(want)


def test_no_optimum_without_a_whole_mapping():
    assert list(mapping.optima((["C", "N"], []), (["C", "O"], []))[2]) == []
    assert list(mapping.optima(([], []), ([], []))[2]) == [()]


def test_order_from_the_farthest():
    star = (["C"] * 6, [(0, 1), (0, 2), (0, 3), (3, 4), (4, 5)])
    assert mapping.order_of(star, "far")[0] == 1 and mapping.order_of(star)[0] == 0


def test_mappings_with_equal_reaction_graphs_are_one(spark):
    side = lambda e: [(a, b) for a, b in e]
    rows = [(1, ["C"] * 3, side([(0, 1), (1, 2)]), ["C"] * 3, side([(0, 1), (1, 2)])), (2, ["C", "N"], side([(0, 1)]), ["C", "N"], [])]
    kind = "array<struct<a:int,b:int>>"
    sides = spark.createDataFrame(rows, f"reaction long, syms1 array<string>, edges1 {kind}, syms2 array<string>, edges2 {kind}")
    found = mapping.optimal_mappings(sides)
    assert sorted((r.reaction, tuple(r.images), r.bonds) for r in found.collect()) == [(1, (0, 1, 2), 0), (1, (2, 1, 0), 0), (2, (0, 1), 1)]
    assert sorted((r.reaction, r.mapping) for r in canonical.distinct_mappings(found, sides).collect()) == [(1, 0), (2, 0)]
    every = spark.createDataFrame([(1, k, list(p)) for k, p in enumerate(permutations(range(3)))], "reaction long, mapping int, images array<int>")
    kept = sorted(r.mapping for r in canonical.distinct_mappings(every, sides).collect())

    def changed(images):
        old, new = {(0, 1), (1, 2)}, {tuple(sorted((images.index(a), images.index(b)))) for a, b in ((0, 1), (1, 2))}
        both = sorted(old | new)
        return [0, 1, 2], ["C"] * 3, [a for a, _ in both], [b for _, b in both], [(e in new) - (e in old) for e in both]

    want = []
    for k, p in enumerate(permutations(range(3))):
        if not any(subgraphs.isomorphism(changed(p), changed(list(permutations(range(3)))[j])) for j in want):
            want.append(k)
    assert kept == want


@pytest.mark.parametrize("seed", range(12))
def test_common_bonds(seed):
    rng = random.Random(seed)
    one, two = graph(rng, rng.choice([3, 5, 6]), 0.5), graph(rng, rng.choice([4, 6]), 0.5)
    links = [{frozenset((a, b)): c for a, b, c in zip(*g[2:])} for g in (one, two)]
    slots = [*two[0], *[None] * len(one[0])]
    most = 0
    for images in set(permutations(slots, len(one[0]))) if len(one[0]) < 5 else _images(one, two):
        image = dict(zip(one[0], images))
        if all(j is None or one[1][i] == two[1][j] for i, j in image.items()):
            most = max(most, sum(None not in (p := [image[x] for x in e]) and links[1].get(frozenset(p)) == c for e, c in links[0].items()))
    size, found = subgraphs.common_bonds(one, two)
    assert size == most and len(set(found.values())) == len(found)
    assert all(one[1][i] == two[1][j] for i, j in found.items())
    assert sum(links[1].get(frozenset(found.get(x) for x in e)) == c for e, c in links[0].items()) == size


def _images(one, two):
    """All injective partial mappings that keep symbols."""

    def go(k, used):
        if k == len(one[0]):
            yield ()
            return
        for j in [None, *(t for t in two[0] if t not in used and two[1][t] == one[1][k])]:
            for rest in go(k + 1, used | {j} - {None}):
                yield (j, *rest)

    return go(0, frozenset())
