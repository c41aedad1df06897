"""Connected subgraphs, shortest label paths, isomorphism, cliques and common subgraphs.

Searches that are exponential in one graph run per graph on the map side; graphs
are first reduced to distinct forms, so equal graphs are searched once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pathloom.operators.kernels import feature_kernel
from pathloom.operators.paths import adjacency, as_graphs, bracket
from pathloom.operators.shortest import shortest_path_kernel  # noqa: F401  it stands with the other kernels
from pathloom.schema import BRACKETS
from pathloom.scratch import discard, materialise, numbered


def neighbours_of(ids, src, dst) -> dict[int, list[int]]:
    near: dict[int, list[int]] = {i: [] for i in ids}
    for a, b in zip(src or (), dst or ()):
        near[a].append(b)
        near[b].append(a)
    return near


def connected_sets(near: dict[int, list[int]], size: int) -> Iterator[tuple[int, ...]]:
    """Every connected set of at most ``size`` nodes once: a set grows from its least node by nodes that no earlier
    choice has offered."""

    def grow(chosen: tuple[int, ...], offered: list[int], seen: frozenset) -> Iterator[tuple[int, ...]]:
        yield chosen
        if len(chosen) == size:
            return
        for k, node in enumerate(offered):
            fresh = [x for x in dict.fromkeys(near[node]) if x > chosen[0] and x not in seen]
            yield from grow((*chosen, node), offered[k + 1 :] + fresh, seen | set(fresh))

    for start in near:
        offered = [x for x in dict.fromkeys(near[start]) if x > start]
        yield from grow((start,), offered, frozenset([start, *offered]))


def _per_graph(nodes: DataFrame, edges: DataFrame, ddl: str, schema: pa.Schema, one) -> DataFrame:
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for g, *graph in zip(*(c.to_pylist() for c in batch.columns)):
                for row in one(*graph):
                    for values, v in zip(out, (g, *row)):
                        values.append(v)
                    if len(out[0]) == 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema)], schema=schema)
                        out = [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema)], schema=schema)

    return as_graphs(nodes, edges).mapInArrow(walk, ddl)


_FEATURES = pa.schema([("g", pa.int64()), ("feature", pa.string()), ("size", pa.int32()), ("n", pa.int64())])
_FEATURES_DDL = "g long, feature string, size int, n long"


def subgraph_features(nodes: DataFrame, edges: DataFrame, size: int) -> DataFrame:
    """(g, feature, size, n): connected induced subgraphs by their sorted symbols and number of edges."""

    def one(ids, syms, src, dst, chg):
        near, label = neighbours_of(ids, src, dst), dict(zip(ids, syms))
        found: Counter = Counter()
        for members in connected_sets(near, size):
            inside = set(members)
            n_edges = sum(b in inside for a in members for b in near[a]) // 2
            found["".join(sorted(label[m] for m in members)) + f":{n_edges}", len(members)] += 1
        return ((f, n, k) for (f, n), k in found.items())

    return _per_graph(nodes, edges, _FEATURES_DDL, _FEATURES, one)


def subgraph_count(nodes: DataFrame, edges: DataFrame, size: int) -> DataFrame:
    """(g, n): the number of connected induced subgraphs of at most ``size`` nodes."""
    return subgraph_features(nodes, edges, size).groupBy("g").agg(F.sum("n").alias("n"))


def subgraph_kernel(nodes: DataFrame, edges: DataFrame, size: int, how: str = "dot") -> DataFrame:
    return feature_kernel(subgraph_features(nodes, edges, size), how)


def shortest_path_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, feature, size, n): for each ordered pair of connected nodes the label of a shortest path, the least label
    where there are several; size is the number of nodes."""
    sign = lambda c: BRACKETS[(c > 0) - (c < 0)]

    def one(ids, syms, src, dst, chg):
        label = dict(zip(ids, syms))
        near: dict[int, list[tuple[int, str]]] = {i: [] for i in ids}
        for a, b, c in zip(src or (), dst or (), chg or ()):
            near[a].append((b, sign(c) + label[b]))
            near[b].append((a, sign(c) + label[a]))
        found: Counter = Counter()
        for start in ids:
            level, seen, n = {start: BRACKETS[0] + label[start]}, {start}, 1
            while level:
                after: dict[int, str] = {}
                for node, path in level.items():
                    for other, step in near[node]:
                        if other not in seen and (other not in after or path + step < after[other]):
                            after[other] = path + step
                seen |= after.keys()
                level, n = after, n + 1
                for path in level.values():
                    found[path, n] += 1
        return ((f, n, k) for (f, n), k in found.items())

    return _per_graph(nodes, edges, _FEATURES_DDL, _FEATURES, one)


def spread_shortest_path_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """As ``shortest_path_features`` for graphs that no task may hold, with numbers in place of labels.

    All pairs of all graphs advance by one node a round, in equi-joins. A label is the number of the label before its
    last step, and the step; each round numbers the distinct pairs of these in their order (``scratch.numbered``), so the
    least label is the least number, equal labels have equal numbers in all graphs, and no path is ever written out.
    Labels are compared step by step, which for symbols of one character is the order of their text.
    """
    held: list[str] = []
    to = nodes.select("g", F.col("id").alias("dst"), F.col("sym").alias("to"))
    steps = adjacency(edges).join(to, ["g", "dst"]).select("g", F.col("src").alias("id"), "dst", F.concat(bracket(F.col("chg")), "to").alias("step"))
    steps = materialise(steps, "steps", held)
    first = numbered(nodes.select("sym").distinct(), "r", "sym").select(F.col("sym").alias("s"), "r")
    front = nodes.join(first, F.col("sym") == F.col("s")).select("g", F.col("id").alias("source"), "id", "r")
    front = materialise(front, "front", held)
    last, out, size = front.limit(0), None, 1
    while not front.isEmpty():
        size += 1
        met = front.join(steps, ["g", "id"]).groupBy("g", "source", F.col("dst").alias("id")).agg(F.min(F.struct("r", "step")).alias("label"))
        known = front.select("g", "source", "id").union(last.select("g", "source", "id"))
        new = materialise(met.join(known, ["g", "source", "id"], "left_anti").select("g", "source", "id", "label.r", "label.step"), "reached", held)
        names = numbered(new.select("r", "step").distinct(), "next", "r", "step").select(F.col("r").alias("before"), F.col("step").alias("by"), "next")
        named = new.join(names, (F.col("r") == F.col("before")) & (F.col("step") == F.col("by"))).select("g", "source", "id", F.col("next").alias("r"))
        last, front = front, materialise(named, "front", held)
        found = front.groupBy("g", F.concat_ws(":", F.lit(size), "r").alias("feature"), F.lit(size).alias("size")).agg(F.count("*").alias("n"))
        found = materialise(found, "path-features", held)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return nodes.sparkSession.createDataFrame([], "g long, feature string, size int, n long")
    out = materialise(out, "shortest-paths")
    discard(edges.sparkSession, held)
    return out


# Isomorphism.


def isomorphism(one: tuple, two: tuple, induced: bool = True, bonds: bool = True) -> dict[int, int] | None:
    """A mapping of graph ``one`` (ids, syms, src, dst, chg) into ``two`` that keeps symbols and changes, or null.

    With equally many nodes and ``induced`` it is an isomorphism, with fewer nodes in ``one`` a subgraph isomorphism.
    The next node is the one with most mapped neighbours; candidates are neighbours of an image.
    """
    (ids1, syms1, *_), (ids2, syms2, *_) = one, two
    if len(ids1) > len(ids2):
        return None
    label1, label2 = dict(zip(ids1, syms1)), dict(zip(ids2, syms2))
    need, have = Counter(syms1), Counter(syms2)
    if any(have[s] < n for s, n in need.items()):
        return None

    def links(graph):
        near: dict[int, dict[int, int]] = {i: {} for i in graph[0]}
        for a, b, c in zip(graph[2] or (), graph[3] or (), graph[4] or ()):
            near[a][b] = near[b][a] = c if bonds else 0
        return near

    near1, near2 = links(one), links(two)
    exact = induced and len(ids1) == len(ids2)
    if exact and sorted(map(len, near1.values())) != sorted(map(len, near2.values())):
        return None
    order: list[int] = []
    left = set(ids1)
    while left:
        node = max(left, key=lambda i: (sum(x not in left for x in near1[i]), len(near1[i]), -i))
        order.append(node)
        left.discard(node)
    image: dict[int, int] = {}
    used: set[int] = set()

    def fits(a: int, b: int) -> bool:
        if label1[a] != label2[b] or b in used or len(near1[a]) > len(near2[b]) or exact and len(near1[a]) != len(near2[b]):
            return False
        for x, c in near1[a].items():
            if x in image and near2[b].get(image[x]) != c:
                return False
        return not induced or sum(y in used for y in near2[b]) == sum(x in image for x in near1[a])

    def search(k: int) -> bool:
        if k == len(order):
            return True
        a = order[k]
        placed = next((x for x in near1[a] if x in image), None)
        for b in near2[image[placed]] if placed is not None else ids2:
            if fits(a, b):
                image[a] = b
                used.add(b)
                if search(k + 1):
                    return True
                del image[a]
                used.discard(b)
        return False

    return dict(image) if search(0) else None


def contains(nodes: DataFrame, edges: DataFrame, pattern: tuple, induced: bool = False) -> DataFrame:
    """(g, found): whether the pattern (ids, syms, src, dst, chg) is a subgraph of a graph."""

    def one(*graph):
        return ((int(isomorphism(pattern, graph, induced) is not None),),)

    found = _per_graph(nodes, edges, "g long, found int", pa.schema([("g", pa.int64()), ("found", pa.int32())]), one)
    return found.select("g", (F.col("found") == 1).alias("found"))


# Cliques and common subgraphs.


def maximal_cliques(near: dict[int, set[int]]) -> Iterator[set[int]]:
    """Maximal cliques by branch and bound with a pivot."""

    def expand(chosen: set, candidates: set, done: set) -> Iterator[set]:
        if not candidates and not done:
            yield set(chosen)
            return
        pivot = max(candidates | done, key=lambda x: len(near[x] & candidates))
        for node in sorted(candidates - near[pivot]):
            yield from expand(chosen | {node}, candidates & near[node], done & near[node])
            candidates = candidates - {node}
            done = done | {node}

    yield from expand(set(), set(near), set())


def clique_sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, size, n): how many maximal cliques of each size a graph has."""

    def one(ids, syms, src, dst, chg):
        near = {i: set(x) for i, x in neighbours_of(ids, src, dst).items()}
        return Counter(len(c) for c in maximal_cliques(near)).items()

    return _per_graph(nodes, edges, "g long, size int, n long", pa.schema([("g", pa.int64()), ("size", pa.int32()), ("n", pa.int64())]), one)


def association_graph(one: tuple, two: tuple) -> tuple[list[tuple[int, int]], dict[int, set[int]]]:
    """Pairs of nodes with equal symbols, and which pairs go together: different nodes, adjacent in both graphs by the
    same change or in neither."""

    def links(graph):
        out: dict[tuple[int, int], int] = {}
        for a, b, c in zip(graph[2] or (), graph[3] or (), graph[4] or ()):
            out[a, b] = out[b, a] = c
        return out

    l1, l2 = links(one), links(two)
    pairs = [(a, b) for a, s in zip(one[0], one[1]) for b, t in zip(two[0], two[1]) if s == t]
    near: dict[int, set[int]] = {k: set() for k in range(len(pairs))}
    for x, (a, b) in enumerate(pairs):
        for y in range(x):
            c, d = pairs[y]
            if a != c and b != d and l1.get((a, c)) == l2.get((b, d)):
                near[x].add(y)
                near[y].add(x)
    return pairs, near


def largest_clique(near: dict[int, set[int]], most: int, group: dict[int, int]) -> set[int]:
    """A largest clique, by branch and bound; nodes of one group are never together, so the groups left bound what can
    come. The search may end at ``most`` nodes, which no clique exceeds."""
    best: list[int] = []

    def expand(chosen: list[int], candidates: set[int]) -> None:
        nonlocal best
        if len(chosen) > len(best):
            best = chosen
        left: dict[int, list[int]] = {}
        for node in candidates:
            left.setdefault(group[node], []).append(node)
        # From the group with the fewest nodes: one of them is in the clique, or none is.
        while left and len(best) < most and len(chosen) + len(left) > len(best):
            own = min(left, key=lambda g: (len(left[g]), g))
            for node in sorted(left.pop(own)):
                expand([*chosen, node], candidates & near[node])
                candidates = candidates - {node}

    expand([], set(near))
    return set(best)


def common_subgraph(one: tuple, two: tuple, limit: int | None = None) -> list[tuple[int, int]]:
    """A largest common induced subgraph as pairs of nodes; given a ``limit``, the best so far after as many cliques."""
    pairs, near = association_graph(one, two)
    most = min(len(one[0]), len(two[0]))
    if limit is None:
        return sorted(pairs[k] for k in largest_clique(near, most, {k: a for k, (a, _) in enumerate(pairs)}))
    best: set[int] = set()
    for k, clique in enumerate(maximal_cliques(near)):
        if len(clique) > len(best):
            best = clique
        if len(best) == most or k >= limit:
            break
    return sorted(pairs[k] for k in best)


def common_bonds(one: tuple, two: tuple) -> tuple[int, dict[int, int]]:
    """(size, mapping): a common subgraph with most *edges*, of equal symbols at the ends and equal changes, by backtracking.

    A matrix of edge pairs that are still possible is kept: giving a node its image strikes out, at each of its edges, the
    edges of the other graph that don't touch the image. Edges that have a possible partner, counted by the kinds that
    both graphs still have, bound what can come; a branch that can't beat the best is left. Nodes may stay unmapped, and
    the common part need not be connected.
    """
    (ids1, syms1, *_), (ids2, syms2, *_) = one, two
    label1, label2 = dict(zip(ids1, syms1)), dict(zip(ids2, syms2))
    links1, links2 = ([(a, b, c) for a, b, c in zip(g[2] or (), g[3] or (), g[4] or ()) if a != b] for g in (one, two))
    kind = lambda label, e: (*sorted((label[e[0]], label[e[1]])), e[2])
    kinds1, kinds2 = [kind(label1, e) for e in links1], [kind(label2, e) for e in links2]
    touch1, touch2 = ({i: {k for k, e in enumerate(links) if i in e[:2]} for i in ids} for ids, links in ((ids1, links1), (ids2, links2)))
    every = [sum(1 << y for y, t in enumerate(kinds2) if s == t) for s in kinds1]
    masks = {i: sum(1 << y for y in touch2[i]) for i in ids2}
    of_kind = {t: sum(1 << y for y, s in enumerate(kinds2) if s == t) for t in set(kinds2)}
    # Nodes with most edges first, each next to one before where there is one.
    order: list[int] = []
    left = [i for i in ids1 if touch1[i]]
    near = {i: {x for k in touch1[i] for x in links1[k][:2]} for i in ids1}
    while left:
        node = max(left, key=lambda i: (sum(x in order for x in near[i]), len(touch1[i]), -i))
        order.append(node)
        left.remove(node)
    best: tuple[int, dict[int, int]] = 0, {}

    def bound(possible: list[int]) -> int:
        have: dict[tuple, list[int]] = {}
        for t, mask in zip(kinds1, possible):
            if mask:
                n = have.setdefault(t, [0, 0])
                n[0] += 1
                n[1] |= mask
        return sum(min(n, (mask & of_kind[t]).bit_count()) for t, (n, mask) in have.items())

    def search(k: int, possible: list[int], image: dict[int, int]) -> None:
        nonlocal best
        most = bound(possible)
        if most <= best[0]:
            return
        if k == len(order):
            best = most, dict(image)
            return
        node = order[k]
        used = set(image.values())
        choices = []
        for target in ids2:
            if target not in used and label2[target] == label1[node]:
                after = [mask & masks[target] if e in touch1[node] else mask & ~masks[target] for e, mask in enumerate(possible)]
                choices.append((sum(after[e] > 0 for e in touch1[node]), target, after))
        for kept, target, after in sorted(choices, key=lambda c: (-c[0], c[1])):
            if kept:
                search(k + 1, after, {**image, node: target})
        search(k + 1, [0 if e in touch1[node] else mask for e, mask in enumerate(possible)], image)

    search(0, every, {})
    return best


def common_bond_sizes(nodes: DataFrame, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(g1, g2, bonds): the most edges that a common subgraph of each pair (g1, g2) has; a search for each pair, map side."""
    packed = as_graphs(nodes, edges)
    columns = ["ids", "syms", "src", "dst", "chg"]
    side = lambda n: packed.select(F.col("g").alias(f"g{n}"), *(F.col(c).alias(f"{c}{n}") for c in columns))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            sizes = [common_bonds(tuple(r[f"{c}1"] for c in columns), tuple(r[f"{c}2"] for c in columns))[0] for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("g1"), batch.column("g2"), pa.array(sizes, pa.int32())], ["g1", "g2", "bonds"])

    return pairs.join(side(1), "g1").join(side(2), "g2").mapInArrow(search, "g1 long, g2 long, bonds int")
