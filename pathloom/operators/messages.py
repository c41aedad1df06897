"""Node features by message passing: synchronous messages on directed edges, and what is built from them."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pathloom.operators.graphs import _bfs, all_pairs, by_form, by_graph, neighbours_in
from pathloom.operators.paths import adjacency
from pathloom.scratch import discard, materialise


#: Aggregates by name; a caller may give a function from a column to an aggregate in place of a name.
COMBINE = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "all": lambda m: F.array_sort(F.collect_list(m)), "distinct": lambda m: F.array_sort(F.collect_set(m))}


def aggregate(how: str | Callable[[Column], Column]) -> Callable[[Column], Column]:
    return COMBINE[how] if isinstance(how, str) else how


def until_stable(
    nodes: DataFrame, edges: DataFrame, start: DataFrame, message: Callable[[Column, Column], Column], combine: str | Callable[[Column], Column],
    update: Callable[[Column, Column], Column], within: int | None = None,
) -> tuple[DataFrame, int]:
    """((g, id, m), rounds): node states passed along edges until none changes, or for ``within`` rounds.

    ``start`` (g, id, m) has a state for each node, which may be null. In a round a node with a state sends ``message(m, chg)``
    along each of its edges, what reaches a node is combined by an aggregate (a name of ``COMBINE`` or a caller's own),
    and its next state is ``update(m, combined)``, where ``combined`` is null if nothing reached it. Every round is written to
    the scratch folder. An update that never settles goes on for ever without ``within``.
    """
    held: list[str] = []
    steps = materialise(adjacency(edges).select("g", "src", F.col("dst").alias("id"), "chg"), "steps", held)
    now = materialise(nodes.select("g", "id").join(start.select("g", "id", "m"), ["g", "id"], "left"), "states", held)
    rounds = 0
    while within is None or rounds < within:
        sent_ = steps.join(now.where("m is not null").select("g", F.col("id").alias("src"), "m"), ["g", "src"])
        met = sent_.groupBy("g", "id").agg(aggregate(combine)(message(F.col("m"), F.col("chg"))).alias("met"))
        after = now.join(met, ["g", "id"], "left").withColumn("next", update(F.col("m"), F.col("met")))
        after = materialise(after.select("g", "id", F.col("next").alias("m"), (~F.col("next").eqNullSafe(F.col("m"))).alias("changed")), "states", held)
        now = after.select("g", "id", "m")
        if after.where("changed").isEmpty():
            break
        rounds += 1
    out = materialise(now, "stable-states")
    discard(edges.sparkSession, held)
    return out, rounds


#: So many rounds of a graph are made before states are written.
ROUNDS = 32


def settled(
    graphs: DataFrame, start: Callable[[Column], Column], message: Callable[[Column, Column], Column], combine: Callable[[Column], Column],
    update: Callable[[Column, Column], Column], within: int | None = None,
) -> tuple[DataFrame, int]:
    """As ``until_stable``, for rows of graphs (``paths.as_graphs``) that are each handled on the map side: nothing is shuffled.

    ``start`` gives a node's state from its symbol, and ``combine`` is a function from the array of what reaches a node to a
    column; null messages are not sent. A graph goes on until a round changes none of its states; states are written after up to ``ROUNDS``
    rounds, and only graphs that are not settled then go on. Time is quadratic in the nodes of a graph; large graphs take ``until_stable``.
    """
    ends = lambda a, b: F.filter(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b"), F.col("chg").alias("chg")), lambda e: e["a"].isNotNull())
    packed = graphs.select("g", "ids", "syms", F.coalesce(F.concat(ends("src", "dst"), ends("dst", "src")), F.array()).alias("steps"))
    place = lambda i: F.array_position("ids", i).cast("int")
    near = F.transform("ids", lambda i: F.transform(F.filter("steps", lambda e: e["b"] == i), lambda e: F.struct(place(e["a"]).alias("at"), e["chg"].alias("chg"))))
    now = packed.select("g", "ids", near.alias("near"), F.transform("syms", start).alias("ms"))
    done, rounds, made = [], 0, 0
    while within is None or made < within:
        block = ROUNDS if within is None else min(ROUNDS, within - made)

        def after(ms: Column) -> Column:
            def state(steps: Column, i: Column) -> Column:
                sent_ = F.filter(F.transform(steps, lambda e: F.when(F.get(ms, e["at"] - 1).isNotNull(), message(F.get(ms, e["at"] - 1), e["chg"]))), lambda m: m.isNotNull())
                return update(F.get(ms, i), F.when(F.size(sent_) > 0, combine(sent_)))

            return F.transform("near", state)

        first = F.struct(F.col("ms").alias("ms"), F.lit(None).cast(now.schema["ms"].dataType).alias("before"), F.lit(0).alias("n"))
        step = lambda s, _: F.when(s["before"].eqNullSafe(s["ms"]), s).otherwise(F.struct(after(s["ms"]).alias("ms"), s["ms"].alias("before"), (s["n"] + 1).alias("n")))
        end = now.select("g", "ids", "near", F.aggregate(F.sequence(F.lit(1), F.lit(block)), first, step).alias("end"))
        stable = F.col("end.before").eqNullSafe(F.col("end.ms"))
        written = materialise(end.select("g", "ids", F.when(~stable, F.col("near")).alias("near"), F.col("end.ms").alias("ms"), stable.alias("stable"), (F.col("end.n") - stable.cast("int")).alias("n")), "settled")
        last, moving = written.agg(F.max("n"), F.count_if(~F.col("stable"))).first()
        rounds, made = max(rounds, made + (last or 0)), made + block
        if not moving or made == within:
            done.append(written)
            break
        done.append(written.where("stable"))
        now = written.where("not stable").select("g", "ids", "near", "ms")
    parts = [d.select("g", F.explode(F.arrays_zip(F.col("ids").alias("id"), F.col("ms").alias("m"))).alias("x")) for d in done] or [now.select("g", F.explode(F.arrays_zip(F.col("ids").alias("id"), F.col("ms").alias("m"))).alias("x"))]
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out.select("g", "x.id", "x.m"), rounds


def messages(nodes: DataFrame, edges: DataFrame, rounds: int, start: DataFrame, how: str | Callable[[Column], Column] = "sum") -> DataFrame:
    """(g, src, dst, round, m): messages on directed edges; those of round 1 are the source's ``start`` (g, id, m), later
    ones combine what reached the source in the round before over all edges but the one back (``how``: a name of
    ``COMBINE``, or a function from a column to an aggregate)."""
    steps = adjacency(edges).select("g", "src", "dst")
    combine = aggregate(how)
    now = steps.join(start.select("g", F.col("id").alias("src"), "m"), ["g", "src"]).withColumn("round", F.lit(1))
    levels = [now.select("g", "src", "dst", "round", "m")]
    for k in range(2, rounds + 1):
        before = levels[-1].select("g", F.col("src").alias("from"), F.col("dst").alias("src"), "m")
        onward = steps.join(before, ["g", "src"]).where(F.col("from") != F.col("dst")).groupBy("g", "src", "dst").agg(combine(F.col("m")).alias("m"))
        levels.append(onward.select("g", "src", "dst", F.lit(k).alias("round"), "m"))
    out = levels[0]
    for more in levels[1:]:
        out = out.union(more)
    return out


#: Columns of values by node and context.
_TEXTS = [("id", pa.int32(), "int"), ("k", pa.int32(), "int"), ("value", pa.string(), "string")]
_NUMBERS = [*_TEXTS[:2], ("value", pa.int64(), "long")]


def _spelled(found: list[tuple[int, str | None]], low: int, high: int, sep: str = "") -> Iterator[tuple[int, str]]:
    """(k, text) for k up to ``high``: the sorted texts of ``found`` (k from which it counts, text), where it has any."""
    if found:
        first = max(low, min(k for k, _ in found))
        kept = sorted((t, k) for k, t in found if t is not None)
        for k in range(first, high + 1):
            yield k, sep.join(t for t, since in kept if since <= k)


def atom_distribution(nodes: DataFrame, edges: DataFrame | None, context: int, with_centre: bool = True) -> DataFrame:
    """(g, id, k, value): the sorted symbols within k hops, for k = 0..context."""

    def one(ids, syms, src, dst, chg):
        near, label = neighbours_in(ids, src, dst), dict(zip(ids, syms))
        for i in ids:
            found = [(k, label[b]) for b, k in _bfs([i], near, context).items() if with_centre or k]
            yield from ((i, k, text) for k, text in _spelled(found, 0, context))

    return by_form(nodes, edges, _TEXTS, one, changes=False)


def _bond_rows(context: int):
    def one(ids, syms, src, dst, chg):
        near, label = neighbours_in(ids, src, dst), dict(zip(ids, syms))
        bonds: dict[tuple, None] = {}
        for a, b, c in zip(src or (), dst or (), chg or ()):
            ends = sorted(x for x in (label[a], label[b]) if x is not None)
            bonds[a, b, f"{ends[0]}{c}{ends[-1]}" if ends and c is not None else None] = None
        at = defaultdict(list)
        for bond in bonds:
            for end in dict.fromkeys(bond[:2]):
                at[end].append(bond)
        for i in ids:
            first: dict[tuple, int] = {}
            for b, k in _bfs([i], near, context - 1).items():  # nearer ones come first
                for bond in at[b]:
                    first.setdefault(bond, k + 1)
            yield from ((i, k, text) for k, text in _spelled([(k, bond[2]) for bond, k in first.items()], 1, context, ","))

    return one


def bond_distribution(nodes: DataFrame, edges: DataFrame | None, context: int) -> DataFrame:
    """(g, id, k, value): the sorted bonds (symbols in order, change between) with an end within k - 1 hops, k = 1..context."""
    return by_form(nodes, edges, _TEXTS, _bond_rows(context))


def _wiener_rows(context: int):
    def one(ids, syms, src, dst, chg):
        near = neighbours_in(ids, src, dst)
        within = lru_cache(4096)(lambda i: _bfs([i], near, 2 * context))  # two nodes near a third are no farther apart
        for i in ids:
            own = sorted((x, k) for x, k in within(i).items() if k <= context)
            added = [0] * (context + 1)
            for n, (x, kx) in enumerate(own):
                far = within(x)
                for y, ky in own[n + 1 :]:
                    added[max(kx, ky, 1)] += far[y]
            total = 0
            for k in range(1, context + 1):
                total += added[k]
                yield i, k, total

    return one


def wiener_index(nodes: DataFrame, edges: DataFrame | None, context: int) -> DataFrame:
    """(g, id, k, value): the sum of distances between all pairs of nodes within k hops of a node, k = 1..context."""
    return by_form(nodes, edges, _NUMBERS, _wiener_rows(context), changes=False)


def morgan_index(nodes: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """(g, id, k, value): 1 for k = 0, then the sum of the neighbours' values of the round before."""
    steps = adjacency(edges).select("g", F.col("src").alias("id"), F.col("dst").alias("next"))
    now = nodes.select("g", "id", F.lit(1).cast("long").alias("value"))
    levels = [now.withColumn("k", F.lit(0))]
    for k in range(1, rounds + 1):
        summed = steps.join(now.select("g", F.col("id").alias("next"), "value"), ["g", "next"]).groupBy("g", "id").agg(F.sum("value").alias("value"))
        now = nodes.select("g", "id").join(summed, ["g", "id"], "left").select("g", "id", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
        levels.append(now.withColumn("k", F.lit(k)))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out.select("g", "id", "k", "value")


def _morgan_rows(rounds: int):
    def one(ids, syms, src, dst, chg):
        near = neighbours_in(ids, src, dst)
        now = dict.fromkeys(ids, 1)
        for k in range(rounds + 1):
            yield from ((i, k, v) for i, v in now.items())
            now = {i: sum(now[b] for b in near[i]) for i in ids}

    return one


def distance_extremes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, id, nearest, farthest): the least distance to another node and the greatest."""
    far = all_pairs(nodes, edges).where("dist > 0").groupBy("g", F.col("a").alias("id")).agg(F.min("dist").alias("nearest"), F.max("dist").alias("farthest"))
    return nodes.select("g", "id").join(far, ["g", "id"], "left")


def ring_membership(nodes: DataFrame, edges: DataFrame, size: int) -> DataFrame:
    """(g, id, in_ring): whether a node lies on a ring of exactly ``size`` nodes: a simple path of that many nodes
    whose ends are joined."""

    def one(ids, near, _):
        inside: set[int] = set()

        def extend(path: list[int]) -> None:
            if len(path) == size:
                if size > 2 and path[0] in near[path[-1]]:
                    inside.update(path)
                return
            for other in near[path[-1]]:
                if other > path[0] and other not in path:
                    extend([*path, other])

        for i in ids:
            extend([i])
        return ((i, int(i in inside)) for i in ids)

    return by_graph(nodes, edges, ("id", "in_ring"), one).withColumn("in_ring", F.col("in_ring") == 1)


def features(distribution: DataFrame, low: int = 0, high: int = 1000) -> DataFrame:
    """Feature facts of contexts low..high, as ``g:id:ATOM_DISTRIBUTION:k=value`` lines."""
    kept = distribution.where(F.col("k").between(low, high))
    return kept.select(F.concat_ws(":", "g", "id", F.lit("ATOM_DISTRIBUTION"), F.concat("k", F.lit("="), "value")).alias("value"))


def directions(nodes: DataFrame, edges: DataFrame, high: int = 1000, whole: bool = False) -> DataFrame:
    """(g, id, toward, member, first, last): what a node learns from each neighbour, and of all of them (``toward`` null).

    ``first`` is the context in which ``member`` comes in: from a neighbour, the length of the shortest walk that starts
    with the edge to it and never turns straight back, so on a ring a node hears of itself from both sides; of all, the
    distance. ``last`` is the last context of the graph: the first one in which nothing new comes in anywhere, unless
    ``whole`` asks for all up to ``high``. Edges that join the same nodes count as one.
    """

    return by_graph(nodes, edges, ("id", "toward", "member", "first", "last"), lambda ids, near, _: _heard(ids, near, high, whole))


def _heard(ids: list[int], near: dict[int, list[int]], high: int, whole: bool) -> Iterator[tuple]:
    heard: dict[tuple[int, int], dict[int, int]] = {}
    for v in ids:
        for u in sorted(set(near[v]) - {v}):
            seen, front, first, k = {(v, u)}, [(v, u)], {}, 1
            while front and k <= high:
                for _, b in front:
                    first.setdefault(b, k)
                front = list(dict.fromkeys((b, c) for a, b in front for c in near[b] if c not in (a, b) and (b, c) not in seen))
                seen.update(front)
                k += 1
            heard[v, u] = first
    last = high if whole else min(high, 1 + max((k for first in heard.values() for k in first.values()), default=0))
    for v in ids:
        own = {v: 0}
        for u in dict.fromkeys(near[v]):
            for b, k in heard.get((v, u), {}).items():
                own[b] = min(k, own.get(b, k))
                yield v, u, b, k, last
        yield from ((v, None, b, k, last) for b, k in own.items())


def _directed_rows(low: int, high: int, whole: bool, with_centre: bool):
    def one(ids, syms, src, dst, chg):
        label = dict(zip(ids, syms))
        told: dict[int, dict] = {i: {None: []} for i in ids}  # by node: (first, symbol) by the neighbour that tells it, or of all
        back: dict[int, dict] = {i: {} for i in ids}
        last = high
        for v, toward, member, first, last in _heard(ids, neighbours_in(ids, src, dst), high, whole):
            if toward is not None:
                told[v].setdefault(toward, []).append((first, label[member]))
                back[v][member] = min(first, back[v].get(member, first))
            elif with_centre:
                told[v][None].append((first, label[member]))
        for v, heard in told.items():
            if not with_centre:
                heard[None] = [(first, label[m]) for m, first in back[v].items()]
            texts = {u: dict(_spelled(found, low, last)) for u, found in heard.items()}
            own, by_neighbour = texts.pop(None), sorted(texts.items())
            for k in range(low, last + 1):
                yield v, k, own.get(k, ""), [(u, text[k]) for u, text in by_neighbour if k in text]

    return one


def directed_distribution(nodes: DataFrame, edges: DataFrame, low: int = 0, high: int = 1000, whole: bool = False, with_centre: bool = True) -> DataFrame:
    """(g, id, k, value, branches): the sorted symbols within k hops, and those heard of from each neighbour within k
    steps: (neighbour, symbols) by neighbour. Without the centre, a node counts among its own only where a ring brings
    it back."""
    told = pa.list_(pa.struct([("neighbour", pa.int32()), ("value", pa.string())]))
    return by_form(nodes, edges, [*_TEXTS, ("branches", told, "array<struct<neighbour: int, value: string>>")], _directed_rows(low, high, whole, with_centre), changes=False)


def ring_sizes(nodes: DataFrame, edges: DataFrame, high: int) -> DataFrame:
    """(g, id, size): the sizes, 3 to ``high``, of the simple rings on which a node lies; each once."""
    return by_graph(nodes, edges, ("id", "size"), lambda ids, near, _: _rings(ids, near, high))


def _rings(ids: list[int], near: dict[int, list[int]], high: int) -> list[tuple[int, int]]:
    found: set[tuple[int, int]] = set()
    for root in ids:
        stack = [[root]]
        while stack:
            path = stack.pop()
            if len(path) > 2 and root in near[path[-1]]:
                found.update((i, len(path)) for i in path)
            if len(path) < high:
                stack.extend([*path, c] for c in set(near[path[-1]]) if c > root and c not in path)
    return sorted(found)


# Names of features.
FEATURES = ("ATOM_DISTRIBUTION", "ATOM_DISTRIBUTION_EXCLUDE", "BOND_DISTRIBUTION", "WIENER", "MORGAN", "RING")


def feature_facts(nodes: DataFrame, edges: DataFrame, low: int = 0, high: int = 1000, kinds: tuple[str, ...] = FEATURES[:1], whole: bool = False) -> DataFrame:
    """(g, id, feature, context, value): the features ``kinds`` of every node in contexts ``low`` to ``high``.

    Atom distributions are written ``(symbols,neighbour=symbols,...)`` and end with the graph's last context
    (``directions``) unless ``whole``; bond distributions are sorted bonds without separators, from context 1; Wiener
    and Morgan indices are numbers, from contexts 1 and 0; a ring of exactly as many nodes as the context says is
    ``True`` or ``False``. An unknown kind is an error; no kinds or no nodes give no rows.
    """
    if unknown := set(kinds) - set(FEATURES):
        raise ValueError(f"no such features: {sorted(unknown)}")

    def atoms(with_centre: bool):
        rows = _directed_rows(low, high, whole, with_centre)
        spell = lambda value, branches: f"({value}{''.join(f',{u}={text}' for u, text in branches)})"
        return lambda *graph: ((i, k, spell(*told)) for i, k, *told in rows(*graph))

    def rings(ids, syms, src, dst, chg):
        met = set(_rings(ids, neighbours_in(ids, src, dst), high))
        return ((i, k, str((i, k) in met)) for i in ids for k in range(low, high + 1))

    made = {
        "ATOM_DISTRIBUTION": lambda: atoms(True),
        "ATOM_DISTRIBUTION_EXCLUDE": lambda: atoms(False),
        "BOND_DISTRIBUTION": lambda: lambda *graph: ((i, k, v.replace(",", "")) for i, k, v in _bond_rows(high)(*graph)),
        "WIENER": lambda: _wiener_rows(high),
        "MORGAN": lambda: _morgan_rows(high),
        "RING": lambda: rings,
    }
    asked = [(kind, made[kind]()) for kind in FEATURES if kind in kinds]
    if not asked:
        return nodes.sparkSession.createDataFrame([], "g long, id int, feature string, context int, value string")

    def one(*graph):
        return ((i, kind, k, str(v)) for kind, rows in asked for i, k, v in rows(*graph) if low <= k <= high)

    return by_form(nodes, edges, [_TEXTS[0], ("feature", pa.string(), "string"), ("context", pa.int32(), "int"), _TEXTS[2]], one, changes="BOND_DISTRIBUTION" in kinds)


def fact_lines(facts: DataFrame) -> DataFrame:
    """Facts as ``g:id:FEATURE:context=value`` lines, which ``flatfile.read_features`` reads."""
    return facts.select(F.concat_ws(":", "g", "id", "feature", F.concat("context", F.lit("="), "value")).alias("value"))
