"""Atom mappings between two sides of a reaction: A*, greedy, exhaustive, assignment and common-subgraph searches.

A mapping is a bijection that keeps symbols; its cost is the number of edges that
exist on one side only. Every choice is broken by ids, so results are the same on
every run. A search given a ``max_states`` that it passes ends with the best known
mapping and status ``capped``.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pathloom.operators.subgraphs import common_subgraph
from pathloom.scratch import materialise, sent

#: syms, edges as pairs of places
Side = tuple[list[str], list[tuple[int, int]]]


def _edges(side: Side) -> set[tuple[int, int]]:
    return {(min(a, b), max(a, b)) for a, b in side[1]}


def cost(lhs: Side, rhs: Side, image: dict[int, int]) -> int:
    """Edges of mapped nodes that are on one side only."""
    right, back = _edges(rhs), {b: a for a, b in image.items()}
    left = _edges(lhs)
    moved = {(min(image[a], image[b]), max(image[a], image[b])) for a, b in left if a in image and b in image}
    return len(moved ^ {(a, b) for a, b in right if a in back and b in back})


def bond_bound(lhs: Side, rhs: Side) -> int:
    """Edges by end symbols that one side has more of than the other: none of these can be kept."""
    kinds = lambda s: Counter(tuple(sorted((s[0][a], s[0][b]))) for a, b in _edges(s))
    a, b = kinds(lhs), kinds(rhs)
    return sum(((a - b) + (b - a)).values())


def twins(side: Side) -> list[int]:
    """For each node a bin: nodes of one neighbour only share a bin with their like at the same neighbour."""
    near: list[list[int]] = [[] for _ in side[0]]
    for a, b in _edges(side):
        near[a].append(b)
        near[b].append(a)
    first: dict = {}
    return [first.setdefault((near[i][0], s), i) if len(near[i]) == 1 else i for i, s in enumerate(side[0])]


def order_of(side: Side, how: str = "bfs") -> list[int]:
    """Nodes in their own order, breadth- or depth-first from a node of greatest degree, or (``far``) breadth-first from the
    node with the greatest distance to another one."""
    if how == "plain":
        return list(range(len(side[0])))
    near: list[list[int]] = [[] for _ in side[0]]
    for a, b in sorted(_edges(side)):
        near[a].append(b)
        near[b].append(a)
    out: list[int] = []
    seen: set[int] = set()
    rank = [-max(d.values()) for d in _rings(near)] if how == "far" else [-len(x) for x in near]
    for start in sorted(range(len(near)), key=lambda i: (rank[i], i)):
        open_ = [start]
        while open_:
            node = open_.pop(-1 if how == "dfs" else 0)
            if node not in seen:
                seen.add(node)
                out.append(node)
                open_ += [x for x in near[node] if x not in seen]
    return out


def _rings(near: list[list[int]]) -> list[dict[int, int]]:
    """For each node the distances to all that it reaches."""
    out = []
    for start in range(len(near)):
        known, front = {start: 0}, [start]
        while front:
            reached = {x: known[n] + 1 for n in front for x in near[n] if x not in known}
            known |= reached
            front = list(reached)
        out.append(known)
    return out


def difference(lhs: Side, rhs: Side, context: int = 1) -> list[list[int]]:
    """How unlike the surroundings of two nodes are: symbols, by distance up to ``context``, that one has more of."""

    def around(side: Side) -> list[Counter]:
        near: list[list[int]] = [[] for _ in side[0]]
        for a, b in _edges(side):
            near[a].append(b)
            near[b].append(a)
        return [Counter((d, side[0][x]) for x, d in known.items() if 0 < d <= context) for known in _rings(near)]

    n1, n2 = around(lhs), around(rhs)
    return [[sum(((a - b) + (b - a)).values()) for b in n2] for a in n1]


def optima(lhs: Side, rhs: Side, context: int = 1, order: str = "far") -> tuple[int, int, Iterator[tuple[int, ...]]]:
    """(bonds, difference, images): *every* mapping of all left nodes with the least cost in two parts: edges that are on one
    side only, and then the nodes' differences. Images are by left node, in no order.

    Best first, as ``astar``, with both parts in one number. What is still to pay is at least the edges that the rest
    must lose by their kinds, and each open node's least difference to a free image. States that are equal in the
    images taken and in where nodes with open edges went pay the same from there on, so for each only the cheapest
    ways to it are kept, all of them; the search goes on until nothing cheaper or as cheap is open, and the mappings
    are read backwards from the end.
    """
    nodes = order_of(lhs, order)
    left, right = _edges(lhs), _edges(rhs)
    unlike = difference(lhs, rhs, context)
    unit = 1 + sum(max(row, default=0) for row in unlike)  # an edge outweighs all differences
    place = {a: k for k, a in enumerate(nodes)}
    kind = lambda s, a, b: (s[a], s[b]) if s[a] <= s[b] else (s[b], s[a])
    last = [max((place[b if a == node else a] for a, b in left if node in (a, b)), default=-1) for node in nodes]
    held = [[j for j in range(k) if last[j] >= k] for k in range(len(nodes) + 1)]
    lefts = [Counter(kind(lhs[0], x, y) for x, y in left if place[x] >= k or place[y] >= k) for k in range(len(nodes) + 1)]
    targets = [[t for t, s in enumerate(rhs[0]) if s == lhs[0][node]] for node in nodes]
    bounds: dict[frozenset, int] = {}
    whole = len(lhs[0]) == len(rhs[0])

    def bound(k: int, used: frozenset) -> int:
        if used not in bounds:
            b = Counter(kind(rhs[0], x, y) for x, y in right if x not in used or y not in used)
            least = [min((unlike[nodes[j]][t] for t in targets[j] if t not in used), default=0) for j in range(k, len(nodes))]
            bounds[used] = unit * sum(((lefts[k] - b) + (b - lefts[k] if whole else Counter())).values()) + sum(least)
        return bounds[used]

    first = (frozenset(), ())
    paid: dict[tuple, int] = {first: 0}
    ways: dict[tuple, list[tuple[tuple, int]]] = {first: []}  # the states before, with the image that was chosen
    where: dict[tuple, dict[int, int]] = {first: {}}  # images of the nodes with open edges
    tick = count()
    open_ = [(bound(0, frozenset()), 0, next(tick), 0, first)]
    best = None
    ends: list[tuple] = []
    while open_ and (best is None or open_[0][0] <= best):
        _, _, _, g, state = heapq.heappop(open_)
        if g > paid[state]:
            continue
        used = state[0]
        k = len(used)
        if k == len(nodes):
            best = g
            ends.append(state)
            continue
        node, images = nodes[k], where[state]
        for target in targets[k]:
            if target in used:
                continue
            lost = 0
            for x in range(len(lhs[0])):
                if (min(x, node), max(x, node)) in left and place[x] < k:
                    y = images[place[x]]
                    lost += (min(y, target), max(y, target)) not in right
            # Edges of the right side to images whose node has no edge to this one.
            made = sum((min(y, target), max(y, target)) in right for y in used)
            kept = sum((min(x, node), max(x, node)) in left and place[x] < k for x in range(len(lhs[0]))) - lost
            now = g + unit * (lost + made - kept) + unlike[node][target]
            taken = used | {target}
            seen = {**images, k: target}
            after = (taken, tuple(seen[j] for j in held[k + 1]))
            f = now + bound(k + 1, taken)
            if best is not None and f > best or now > paid.get(after, now):
                continue
            if now < paid.get(after, now + 1):
                paid[after], ways[after], where[after] = now, [], {j: seen[j] for j in held[k + 1]}
                heapq.heappush(open_, (f, -k, next(tick), now, after))
            ways[after].append((state, target))

    def backwards(state: tuple, k: int, images: dict[int, int]) -> Iterator[tuple[int, ...]]:
        if k == 0:
            yield tuple(images[node] for node in range(len(nodes)))
            return
        for before, target in ways[state]:
            yield from backwards(before, k - 1, {**images, nodes[k - 1]: target})

    found = (m for end in ends for m in backwards(end, len(nodes), {}))
    return ((best or 0) // unit, (best or 0) % unit, found) if best is not None else (0, 0, iter(()))


def optimal_mappings(sides: DataFrame, context: int = 1) -> DataFrame:
    """(reaction, mapping, images, bonds, difference): every optimum of each reaction by ``optima``, numbered from 0 in the
    order of their images; none where the left side can't be mapped whole. Sides as for ``map_reactions``."""
    return by_form(sides, lambda forms: optima_of(forms, context))


def optima_of(sides: DataFrame, context: int = 1) -> DataFrame:
    """``optimal_mappings`` with a search for each row of ``sides``."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("reaction", pa.int64()), ("images", pa.list_(pa.int32())), ("bonds", pa.int32()), ("difference", pa.int32())])
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                lhs, rhs = ((r[f"syms{k}"] or [], [(e["a"], e["b"]) for e in r[f"edges{k}"] or ()]) for k in (1, 2))
                bonds, unlike, found = optima(lhs, rhs, context)
                for images in found:
                    out.append((r["reaction"], images, bonds, unlike))
                    if len(out) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    chosen = sides.select("reaction", *_FORM)
    found = chosen.mapInArrow(search, "reaction long, images array<int>, bonds int, difference int")
    number = F.row_number().over(Window.partitionBy("reaction").orderBy("images")) - 1
    return found.select("reaction", number.alias("mapping"), "images", "bonds", "difference")


def astar(lhs: Side, rhs: Side, max_states: int | None = None) -> tuple[dict[int, int], int, str]:
    """The least cost, best first: edges decided so far, plus the edges that the rest must lose by their kinds.

    What is still to pay rests on the images taken and on where the nodes with open edges went; of states equal in
    these only the cheapest goes on. ``max_states`` is for callers who want an early end; without it the search ends with the least cost.
    """
    order, bins = order_of(lhs), twins(rhs)
    left, right = _edges(lhs), _edges(rhs)
    place = {a: k for k, a in enumerate(order)}
    kind = lambda s, a, b: (s[a], s[b]) if s[a] <= s[b] else (s[b], s[a])
    tick = count()
    last = [max((place[b if a == node else a] for a, b in left if node in (a, b)), default=-1) for node in order]
    open_places = [[j for j in range(k) if last[j] >= k] for k in range(len(order) + 1)]
    lefts = [Counter(kind(lhs[0], x, y) for x, y in left if place[x] >= k or place[y] >= k) for k in range(len(order) + 1)]
    bounds: dict[frozenset, int] = {}  # as many images are used as nodes are placed
    whole = len(lhs[0]) == len(rhs[0])  # if not, edges of the right side may touch nodes that are no image, and cost nothing

    def bound(k: int, used: frozenset) -> int:
        if used not in bounds:
            b = Counter(kind(rhs[0], x, y) for x, y in right if x not in used or y not in used)
            bounds[used] = sum(((lefts[k] - b) + (b - lefts[k] if whole else Counter())).values())
        return bounds[used]

    best = greedy(lhs, rhs)
    limit = cost(lhs, rhs, best)
    if whole and len(best) == len(order) and limit == bond_bound(lhs, rhs):  # no mapping can cost less
        return best, limit, "optimal"
    open_ = [(bound(0, frozenset()), 0, next(tick), 0, ())]
    cheapest: dict[tuple, int] = {}
    states = 0
    while open_:
        f, _, _, g, images = heapq.heappop(open_)
        if f >= limit:
            return best, limit, "optimal"
        k = len(images)
        used = frozenset(images)
        if cheapest.get((used, *(images[j] for j in open_places[k])), g) < g:
            continue
        states += 1
        if max_states is not None and states > max_states:
            return best, limit, "capped"
        node = order[k]
        tried: set[int] = set()
        for target in range(len(rhs[0])):
            if target in used or rhs[0][target] != lhs[0][node] or bins[target] in tried:
                continue
            tried.add(bins[target])
            more = 0
            for j, other in enumerate(images):
                a, b = order[j], node
                x, y = other, target
                more += ((min(a, b), max(a, b)) in left) != ((min(x, y), max(x, y)) in right)
            now, after = g + more, (*images, target)
            if len(after) == len(order):
                if now < limit:
                    best, limit = dict(zip(order, after)), now
                continue
            taken = used | {target}
            h = now + bound(k + 1, taken)
            state = (taken, *(after[j] for j in open_places[k + 1]))
            if h < limit and now < cheapest.get(state, now + 1):
                cheapest[state] = now
                heapq.heappush(open_, (h, -k, next(tick), now, after))
    return best, limit, "optimal"


def dfs(lhs: Side, rhs: Side, max_states: int | None = None) -> tuple[dict[int, int], int, str]:
    """The least cost, by exhaustive search that leaves a branch when its cost, with the edges that the rest must lose by
    their kinds, reaches the best, or when its state (``astar``) was met before at no more cost: neither can end below the
    best, so the first least mapping in the order of the search is found as without them."""
    order = order_of(lhs, "dfs")
    left, right = _edges(lhs), _edges(rhs)
    best, limit, states = greedy(lhs, rhs), 0, 0
    limit = cost(lhs, rhs, best)
    images: list[int] = []
    place = {a: k for k, a in enumerate(order)}
    kind = lambda s, a, b: (s[a], s[b]) if s[a] <= s[b] else (s[b], s[a])
    last = [max((place[b if a == node else a] for a, b in left if node in (a, b)), default=-1) for node in order]
    open_places = [[j for j in range(k) if last[j] >= k] for k in range(len(order) + 1)]
    lefts = [Counter(kind(lhs[0], x, y) for x, y in left if place[x] >= k or place[y] >= k) for k in range(len(order) + 1)]
    whole = len(lhs[0]) == len(rhs[0])
    bounds: dict[frozenset, int] = {}
    met: dict[tuple, int] = {}
    if whole and len(best) == len(order) and limit == bond_bound(lhs, rhs):  # no mapping can cost less
        return best, limit, "optimal"

    def hopeless(g: int) -> bool:
        used = frozenset(images)
        if used not in bounds:
            b, a = Counter(kind(rhs[0], x, y) for x, y in right if x not in used or y not in used), lefts[len(images)]
            bounds[used] = sum(((a - b) + (b - a if whole else Counter())).values())
        state = (used, *(images[j] for j in open_places[len(images)]))
        if g + bounds[used] >= limit or met.get(state, g + 1) <= g:
            return True
        met[state] = g
        return False

    def search(g: int) -> bool:
        nonlocal best, limit, states
        states += 1
        if max_states is not None and states > max_states:
            return False
        if len(images) == len(order):
            if g < limit:
                best, limit = dict(zip(order, images)), g
            return True
        node = order[len(images)]
        for target in range(len(rhs[0])):
            if target not in images and rhs[0][target] == lhs[0][node]:
                more = sum(((min(order[j], node), max(order[j], node)) in left) != ((min(x, target), max(x, target)) in right) for j, x in enumerate(images))
                if g + more < limit:
                    images.append(target)
                    going = hopeless(g + more) or search(g + more)
                    images.pop()
                    if not going:
                        return False
        return True

    return (best, limit, "optimal") if search(0) else (best, limit, "capped")


def greedy(lhs: Side, rhs: Side) -> dict[int, int]:
    """Nodes in breadth-first order, each to the free node that costs least now, then by environment, then by id."""
    left, right = _edges(lhs), _edges(rhs)
    similar = similarities(lhs, rhs)
    image: dict[int, int] = {}
    for node in order_of(lhs):
        free = [t for t in range(len(rhs[0])) if t not in image.values() and rhs[0][t] == lhs[0][node]]
        if free:
            price = lambda t: sum(((min(a, node), max(a, node)) in left) != ((min(b, t), max(b, t)) in right) for a, b in image.items())
            image[node] = min(free, key=lambda t: (price(t), -similar[node][t], t))
    return image


def similarities(lhs: Side, rhs: Side) -> list[list[float]]:
    """How alike the neighbourhoods of nodes of equal symbol are: shared neighbour symbols over all; -1 for others."""

    def around(side: Side) -> list[Counter]:
        near: list[Counter] = [Counter() for _ in side[0]]
        for a, b in _edges(side):
            near[a][side[0][b]] += 1
            near[b][side[0][a]] += 1
        return near

    n1, n2 = around(lhs), around(rhs)
    return [[-1.0 if s != t else (1 + 2 * sum((n1[i] & n2[j]).values())) / (1 + sum(n1[i].values()) + sum(n2[j].values())) for j, t in enumerate(rhs[0])] for i, s in enumerate(lhs[0])]


def assignment(weights: list[list[float]]) -> list[int]:
    """The column of each row with the greatest total weight, by shortest augmenting paths; rows <= columns."""
    n, m = len(weights), len(weights[0]) if weights else 0
    u, v, match, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = [float("inf")] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    now = -weights[i0 - 1][j - 1] - u[i0] - v[j]
                    if now < least[j]:
                        least[j], way[j] = now, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [0] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def hungarian(lhs: Side, rhs: Side) -> tuple[dict[int, int], int, str]:
    """The bijection with the most similar neighbourhoods."""
    weights = [[w if w >= 0 else -1e6 for w in row] for row in similarities(lhs, rhs)]
    image = {i: j for i, j in enumerate(assignment(weights)) if lhs[0][i] == rhs[0][j]} if weights and len(weights) <= len(weights[0]) else {}
    return image, cost(lhs, rhs, image), "heuristic"


def cliques(lhs: Side, rhs: Side, limit: int | None = None) -> tuple[dict[int, int], int, str]:
    """Largest common subgraphs, one after another, of what is not mapped yet."""
    image: dict[int, int] = {}

    def graph(side: Side, kept: list[int]) -> tuple:
        inside = [(x, y) for x, y in sorted(_edges(side)) if x in kept and y in kept]
        return kept, [side[0][k] for k in kept], [x for x, _ in inside], [y for _, y in inside], [0] * len(inside)

    while True:
        a = [i for i in range(len(lhs[0])) if i not in image]
        b = [j for j in range(len(rhs[0])) if j not in image.values()]
        found = common_subgraph(graph(lhs, a), graph(rhs, b), limit) if a and b else []
        if not found:
            return image, cost(lhs, rhs, image), "heuristic"
        image |= dict(found)


ALGORITHMS = {"astar": astar, "dfs": dfs, "hungarian": hungarian, "cliques": cliques, "greedy": lambda a, b: (m := greedy(a, b), cost(a, b, m), "heuristic")}


_FORM = ("syms1", "edges1", "syms2", "edges2")


#: A task searches about so many forms.
FORMS_IN_TASK = 5_000


def forms_of(sides: DataFrame) -> DataFrame:
    """(form, first, members, syms1, edges1, syms2, edges2): what reactions are, each form once, with its least reaction and how many there
    are. A search takes its time and a form few bytes, so forms are dealt by their number."""
    forms = sides.groupBy(*_FORM).agg(F.min("reaction").alias("first"), F.count("*").alias("members"))
    forms = materialise(forms.withColumn("form", F.monotonically_increasing_id()), "forms")
    tasks = max(4 * sides.sparkSession.sparkContext.defaultParallelism, forms.count() // FORMS_IN_TASK)
    return forms.repartition(tasks)


def by_form(sides: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``search`` finds for reactions, by reaction. Reactions of one form, equal in all that a search reads, are
    searched once, under the form's number in place of theirs, and each takes what was found for it."""
    sides = materialise(sides.select("reaction", *_FORM), "sides")
    forms = forms_of(sides)
    # Forms of many reactions are few and are sent to all tasks, so that no task gets all reactions of a form.
    often, seldom = sent(forms.where("members > 1000").select("form", *_FORM)), forms.where("members between 2 and 1000").select("form", *_FORM)
    own = [sides.join(known, [sides[c].eqNullSafe(known[c]) for c in _FORM]).select("reaction", "form") for known in (often, seldom)]
    alone = forms.where("members = 1").select(F.col("first").alias("reaction"), "form")
    found = search(forms.select(F.col("form").alias("reaction"), *_FORM))
    return own[0].union(own[1]).union(alone).join(found.withColumnRenamed("reaction", "form"), "form").select(*found.columns)


def compared(sides: DataFrame, algorithms: tuple[str, ...]) -> DataFrame:
    """(form, members, size, <algorithm>_cost, <algorithm>_mapped ..) for each form of reactions with an atom on the left: what each of
    ``algorithms`` finds, all in one pass over the forms, for so many reactions."""
    fields = [("form", pa.int64()), ("members", pa.int64()), ("size", pa.int32()), *((f"{name}_{c}", pa.int32()) for name in algorithms for c in ("cost", "mapped"))]
    schema = pa.schema(fields)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = []
            for r in batch.to_pylist():
                lhs, rhs = ((r[f"syms{k}"] or [], [(e["a"], e["b"]) for e in r[f"edges{k}"] or ()]) for k in (1, 2))
                ends = [ALGORITHMS[name](lhs, rhs)[:2] for name in algorithms]
                out.append([r["form"], r["members"], len(lhs[0]), *(v for image, price in ends for v in (price, len(image)))])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * len(schema), schema)], schema=schema)

    forms = forms_of(sides.select("reaction", *_FORM)).where(F.size("syms1") > 0)
    return forms.select("form", "members", *_FORM).mapInArrow(search, ", ".join(f"{n} {'long' if t == pa.int64() else 'int'}" for n, t in fields))


def map_reactions(sides: DataFrame, algorithm: str = "astar", **options) -> DataFrame:
    """(reaction, lhs_atom, rhs_atom, cost, status) for reactions (reaction, syms1, edges1, syms2, edges2), edges being
    arrays of structs (a, b); one search per form of reactions (``by_form``), on the map side."""
    schema = pa.schema([("reaction", pa.int64()), ("atoms", pa.list_(pa.struct([("lhs_atom", pa.int32()), ("rhs_atom", pa.int32())]))), ("cost", pa.int32()), ("status", pa.string())])
    solve = ALGORITHMS[algorithm]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for r in batch.to_pylist():
                lhs, rhs = ((r[f"syms{k}"] or [], [(e["a"], e["b"]) for e in r[f"edges{k}"] or ()]) for k in (1, 2))
                image, price, status = solve(lhs, rhs, **options)
                for values, v in zip(out, (r["reaction"], [{"lhs_atom": a, "rhs_atom": b} for a, b in sorted(image.items())], price, status)):
                    values.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema)], schema=schema)

    found = by_form(sides, lambda forms: forms.mapInArrow(search, "reaction long, atoms array<struct<lhs_atom:int,rhs_atom:int>>, cost int, status string"))
    return found.select("reaction", F.explode("atoms").alias("p"), "cost", "status").select("reaction", "p.lhs_atom", "p.rhs_atom", "cost", "status")


def reaction_graph(lhs: DataFrame, rhs: DataFrame, image: DataFrame) -> DataFrame:
    """(reaction, a, b, old, new, chg): edges of both sides under a mapping, a full outer join: an edge on the left only
    is cleaved, on the right only formed. ``lhs`` and ``rhs`` are (reaction, a, b, type), ``image`` (reaction, lhs_atom, rhs_atom)."""
    back = lambda end: image.select("reaction", F.col("rhs_atom").alias(end), F.col("lhs_atom").alias(f"{end}0"))
    new = rhs.join(back("a"), ["reaction", "a"]).join(back("b"), ["reaction", "b"])
    new = new.select("reaction", F.least("a0", "b0").alias("a"), F.greatest("a0", "b0").alias("b"), F.col("type").alias("new"))
    old = lhs.select("reaction", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("type").alias("old"))
    both = old.join(new, ["reaction", "a", "b"], "full_outer")
    chg = F.when(F.col("old").isNull(), 1).when(F.col("new").isNull(), -1).otherwise(0)
    return both.select("reaction", "a", "b", F.coalesce("old", F.lit(0)).alias("old"), F.coalesce("new", F.lit(0)).alias("new"), chg.alias("chg"))


def completeness(sides: DataFrame, image: DataFrame) -> DataFrame:
    """(reaction, mapped, total): mapped and all left-hand atoms."""
    mapped = image.groupBy("reaction").agg(F.count("*").alias("mapped"))
    return sides.select("reaction", F.size("syms1").cast("long").alias("total")).join(mapped, "reaction", "left").na.fill(0, ["mapped"])


def dictionaries(nodes: DataFrame) -> DataFrame:
    """(sym, code): symbols numbered from 0 in sorted order; a table of one row per symbol."""
    return nodes.select("sym").distinct().withColumn("code", F.dense_rank().over(Window.orderBy("sym")) - 1)


def unmapped(nodes: DataFrame, image: DataFrame) -> DataFrame:
    """Left-hand nodes (reaction, id, ..) that a mapping leaves out."""
    return nodes.join(image.select("reaction", F.col("lhs_atom").alias("id")), ["reaction", "id"], "left_anti")


def assign_pairs(pairs: DataFrame) -> DataFrame:
    """(reaction, lhs_atom, rhs_atom) from ordered pairs (reaction, ord, lhs, rhs) of atom lists.

    A pair names a kind of atom on either side, and compounds that occur twice share it: pair after pair, each left atom
    that is not mapped yet goes to the first right atom that is not. What a pair may still take depends on all before
    it, so a reaction's pairs are folded in their order; reactions are independent of each other.
    """
    ordered = F.array_sort(F.collect_list(F.struct("ord", "lhs", "rhs")))
    none = F.array().cast("array<int>")
    start = F.struct(none.alias("left"), none.alias("right"))

    def step(state: Column, pair: Column) -> Column:
        left, right = F.array_except(pair["lhs"], state["left"]), F.array_except(pair["rhs"], state["right"])
        n = F.least(F.size(left), F.size(right))
        return F.struct(F.concat(state["left"], F.slice(left, F.lit(1), n)).alias("left"), F.concat(state["right"], F.slice(right, F.lit(1), n)).alias("right"))

    known = pairs.where("lhs is not null and rhs is not null").groupBy("reaction").agg(F.aggregate(ordered, start, step).alias("s"))
    return known.select("reaction", F.explode(F.arrays_zip(F.col("s.left").alias("lhs_atom"), F.col("s.right").alias("rhs_atom"))).alias("p")).select("reaction", "p.lhs_atom", "p.rhs_atom")
