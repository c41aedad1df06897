"""Product graphs and walk kernels.

Three strategies give the same kernels. ``features``: what a walk in a product graph
weighs is a factor of one graph times a factor of the other, and its nodes and
edges match exactly if both walks read alike; so a kernel is the dot product of the
graphs' weighted counts of label walks. These grow along a graph's own edges, one
join and one sum a step, and meet in one equi-join on the label: no pair of graphs
is looked at before its result. The number of label walks grows with each step until
all walks read differently, so this is the strategy for short walks. ``blocks``
(``pairs``) keeps a number for each node of a product graph, two blocks of graphs in a
task: its state is the same at every length, and it can end at convergence; it is the
default beyond ``SHORT_WALKS`` nodes. ``joins`` makes product graphs as tables and lets all
pairs advance together: the definition, word for word, for graphs that no task may hold.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pathloom.operators import pairs
from pathloom.operators.graphs import by_form
from pathloom.operators.paths import adjacency, bracket
from pathloom.scratch import materialise, sent

KEY = ["i", "j", "a1", "a2"]
#: Walks of at most so many nodes are compared by their labels.
SHORT_WALKS = 6
#: The same for walks of which pairs that start at one node are compared.
DISTANCE_WALKS = 4


def _labelled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    a = nodes.select("g", F.col("id").alias("src"), F.col("sym").alias("s1"))
    b = nodes.select("g", F.col("id").alias("dst"), F.col("sym").alias("s2"))
    return adjacency(edges).join(a, ["g", "src"]).join(b, ["g", "dst"])


#: Blocks in which the nodes of a symbol are dealt to meet others.
BLOCKS = 64


def product_nodes(nodes: DataFrame, match_labels: bool = True, core: DataFrame | None = None) -> DataFrame:
    """(i, j, a1, a2): pairs of nodes of graphs j <= i, with equal symbols unless told otherwise; with ``core`` (g, id, dist) both
    are core nodes (distance 0) or neither is, which is a key of the join: no pair is made that ``reduced`` would drop."""
    keys = ["sym"] if match_labels else []
    if core is not None:
        flags = core.select("g", "id", F.coalesce(F.col("dist") == 0, F.lit(False)).alias("inner"))
        nodes, keys = nodes.join(flags.hint("merge"), ["g", "id"]), [*keys, "inner"]
    one = nodes.select(F.col("g").alias("i"), F.col("id").alias("a1"), *keys)
    two = nodes.select(F.col("g").alias("j"), F.col("id").alias("a2"), *(F.col(k).alias(f"{k}_") for k in keys))
    if not keys:
        met = one.join(two, F.lit(True))
    else:  # keys are few, so the nodes of one are dealt in blocks, and each block meets all nodes of its key; the
        # copies are shuffled, however small the file that they are made of: broadcast, the driver would hold them all
        one = one.withColumn("block", F.pmod(F.xxhash64("i", "a1"), F.lit(BLOCKS)).cast("int"))
        two = two.withColumn("beside", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
        same = F.col("block") == F.col("beside")
        for k in keys:
            same &= F.col(k) == F.col(f"{k}_")
        met = one.join(two.hint("merge"), same)
    return met.where("j <= i").select(*KEY)


def product_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(i, j, a1, a2, b1, b2): directed product edges. Both ends' symbols and the change are join keys, so no pair is
    made that a filter would drop."""
    own = _labelled(nodes, edges)
    one = own.select(F.col("g").alias("i"), F.col("src").alias("a1"), F.col("dst").alias("b1"), "s1", "s2", "chg")
    two = own.select(F.col("g").alias("j"), F.col("src").alias("a2"), F.col("dst").alias("b2"), F.col("s1").alias("t1"), F.col("s2").alias("t2"), F.col("chg").alias("c"))
    met = one.join(two, (F.col("s1") == F.col("t1")) & (F.col("s2") == F.col("t2")) & (F.col("chg") == F.col("c")))
    return met.where("j <= i").select(*KEY, "b1", "b2")


def reduced(product: DataFrame, core: DataFrame) -> DataFrame:
    """Product nodes without pairs of a core node (distance 0) and another. Flags are sent to the pairs, which are many more."""
    core = materialise(core.select("g", "id", F.coalesce(F.col("dist") == 0, F.lit(False)).alias("c")), "core")
    flag = lambda g, a, n: sent(core.select(F.col("g").alias(g), F.col("id").alias(a), F.col("c").alias(n)))
    return product.join(flag("i", "a1", "c1"), ["i", "a1"]).join(flag("j", "a2", "c2"), ["j", "a2"]).where("c1 = c2").drop("c1", "c2").select(*product.columns)


def _met(left: DataFrame, right: DataFrame, keys: list[str], sums: dict[str, str]) -> DataFrame:
    """(i, j, ..): sums of products over pairs of rows of graphs j <= i that agree in ``keys``."""
    a = left.select(F.col("g").alias("i"), *keys, *(F.col(c).alias(f"{c}1") for c in sums.values()))
    b = right.select(F.col("g").alias("j"), *(F.col(k).alias(f"{k}_") for k in keys), *(F.col(c).alias(f"{c}2") for c in sums.values()))
    on = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    met = a.join(b, on).where("j <= i")
    return met.groupBy("i", "j", *(["len"] if "len" in keys else [])).agg(*(F.sum(F.col(f"{c}1") * F.col(f"{c}2")).alias(n) for n, c in sums.items()))


def product_sizes(nodes: DataFrame, edges: DataFrame, core: DataFrame | None = None) -> DataFrame:
    """(i, j, nodes, edges): sizes of the product graphs that have a node, from each graph's counts of symbols and of
    labelled arcs; with ``core`` (g, id, dist) the nodes of the reduced product graphs alone."""
    if core is not None:
        flagged = nodes.join(core, ["g", "id"]).select("g", "sym", F.coalesce(F.col("dist") == 0, F.lit(False)).alias("inner"))
        own = flagged.groupBy("g", "sym", "inner").agg(F.count("*").alias("n"))
        return _met(own, own, ["sym", "inner"], {"nodes": "n"})
    own = nodes.groupBy("g", "sym").agg(F.count("*").alias("n"))
    arcs = _labelled(nodes, edges).groupBy("g", "s1", "s2", "chg").agg(F.count("*").alias("n"))
    met = _met(own, own, ["sym"], {"nodes": "n"}).join(_met(arcs, arcs, ["s1", "s2", "chg"], {"edges": "n"}), ["i", "j"], "left")
    return met.na.fill(0, ["edges"])


def _step(change: Column, sym: str) -> Column:
    return F.concat(bracket(change), F.col(sym))


def walk_features(nodes: DataFrame, arcs: DataFrame, length: int) -> DataFrame:
    """(g, walk, len, f): weighted counts of label walks of 1..``length`` nodes.

    ``nodes`` (g, id, sym, a, s, q) and directed ``arcs`` (g, src, dst, chg, p): a walk of one node weighs ``a``; one
    that begins at a node and goes on along an arc weighs the node's ``s`` times ``p`` times what goes on; a node's walks
    are summed with its ``q``.
    """
    own = nodes.select("g", F.col("id").alias("src"), F.col("sym").alias("own"), "s", "q")
    steps = arcs.join(own, ["g", "src"]).select("g", "src", "dst", (F.col("p") * F.col("s")).alias("w"), _step(F.col("chg"), "own").alias("step"), "q")
    # A walk's label is read from its end, so that a step adds to it; of a pair both are read alike.
    now = nodes.select("g", F.col("id").alias("src"), F.concat(F.lit("("), "sym").alias("walk"), F.col("a").alias("f"), "q")
    levels = []
    for n in range(1, length + 1):
        levels.append(now.groupBy("g", "walk").agg(F.sum(F.col("q") * F.col("f")).alias("f")).select("g", "walk", F.lit(n).alias("len"), "f"))
        if n < length:
            before = now.select("g", F.col("src").alias("dst"), "walk", "f")
            moved = steps.join(before, ["g", "dst"]).select("g", "src", "q", F.concat("walk", "step").alias("walk"), (F.col("w") * F.col("f")).alias("f"))
            now = moved.groupBy("g", "src", "q", "walk").agg(F.sum("f").alias("f"))
    return _all(levels)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _levels(features: DataFrame) -> DataFrame:
    """(i, j, len, k): the dot products of walk features, by length. Features are written once and read by both sides."""
    features = materialise(features, "walk-features")
    return _met(features, features, ["walk", "len"], {"k": "f"})


def _pair_levels(nodes: DataFrame, arcs: DataFrame, length: int, strategy: str | None = None, epsilon: float | None = None, lam: float | None = None) -> DataFrame:
    """Levels by ``features`` for walks of a few nodes, by ``blocks`` for longer ones or where ``epsilon`` ends them; ``lam`` weighs each node."""
    if strategy == "features" or strategy is None and epsilon is None and length <= SHORT_WALKS:
        found = _levels(walk_features(nodes, arcs, length))
        return found if lam is None else found.withColumn("k", F.col("k") * F.pow(F.lit(lam), "len"))
    return pairs.levels(nodes, arcs, length, epsilon, lam=1.0 if lam is None else lam)


def _plain_arcs(edges: DataFrame) -> DataFrame:
    return adjacency(edges).withColumn("p", F.lit(1.0))


def walk_counts(nodes: DataFrame, edges: DataFrame, length: int, strategy: str | None = None) -> DataFrame:
    """(i, j, len, n): common walks of 1..``length`` nodes: D_1 = 1, D_l(v) = sum of D_(l-1) over the neighbours.

    Counts are whole; ``blocks`` adds in floating point, which is exact up to 2**53."""
    if strategy != "joins":
        one = F.lit(1).cast("long")
        arcs, points = adjacency(edges).withColumn("p", one), nodes.select("g", "id", "sym", one.alias("a"), one.alias("s"), one.alias("q"))
        if strategy == "features" or strategy is None and length <= SHORT_WALKS:
            levels = _pair_levels(points, arcs, length, strategy)
        else:
            levels = pairs.levels(points, arcs, length, how=pairs.Product.count_levels, masked="q", radius=length // 2, starts=pairs.COUNTED_NODES)
        return levels.select("i", "j", "len", F.col("k").cast("long").alias("n"))
    steps = product_edges(nodes, edges)
    now = product_nodes(nodes).withColumn("n", F.lit(1).cast("long"))
    levels = []
    for k in range(1, length + 1):
        levels.append(now.groupBy("i", "j").agg(F.sum("n").alias("n")).withColumn("len", F.lit(k)))
        if k < length:
            moved = steps.join(now.select("i", "j", F.col("a1").alias("b1"), F.col("a2").alias("b2"), "n"), ["i", "j", "b1", "b2"])
            now = moved.groupBy(*KEY).agg(F.sum("n").alias("n"))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out.select("i", "j", "len", "n")


# Node weights by the distance to the core.


def exponential(distance: Column, alpha: float) -> Column:
    return F.coalesce(F.pow(F.lit(alpha), -distance), F.lit(0.0 if alpha > 1 else 1.0))


def logistic(distance: Column, beta: float) -> Column:
    return F.coalesce(1.0 / (1.0 + F.exp(F.lit(beta) * (distance - 0.5))), F.lit(0.0 if beta > 0 else 1.0))


def _weighted(product: DataFrame, weights: DataFrame) -> DataFrame:
    side = lambda g, a, w: weights.select(F.col("g").alias(g), F.col("id").alias(a), F.col("w").alias(w))
    return product.join(side("i", "a1", "w1"), ["i", "a1"]).join(side("j", "a2", "w2"), ["j", "a2"]).select(*KEY, (F.col("w1") * F.col("w2")).alias("w"))


def walk_levels(nodes: DataFrame, edges: DataFrame, weights: DataFrame, lam: float, length: int = 50, strategy: str | None = None, epsilon: float | None = None) -> DataFrame:
    """(i, j, len, k): the parts of ``walk_kernel`` by the number of nodes of the walks."""
    # lam is a factor of the product and not its root one of each graph: the roots' product is not quite lam.
    own = nodes.join(weights, ["g", "id"]).select("g", "id", "sym", F.col("w").alias("a"), F.col("w").alias("s"), F.lit(1.0).alias("q"))
    return _pair_levels(own, _plain_arcs(edges), length, strategy, epsilon, lam)


def walk_kernel(nodes: DataFrame, edges: DataFrame, weights: DataFrame, lam: float, length: int = 50, strategy: str | None = None, epsilon: float | None = None) -> DataFrame:
    """(i, j, k): F_1(v) = lam w(v), F_l(v) = lam w(v) sum of F_(l-1) over neighbours, summed over nodes and lengths.

    ``weights`` is (g, id, w); all ones give the plain walk kernel. With ``epsilon`` a pair of graphs ends when a length
    adds at most that share of what it has so far.
    """
    if strategy != "joins":
        return walk_levels(nodes, edges, weights, lam, length, strategy, epsilon).groupBy("i", "j").agg(F.sum("k").alias("k"))
    own = _weighted(product_nodes(nodes), weights)
    steps = product_edges(nodes, edges)
    now = own.select(*KEY, (F.lit(lam) * F.col("w")).alias("f"))
    return _summed(own, steps, now, length, lambda own, moved: moved.join(own, KEY).select(*KEY, (F.lit(lam) * F.col("w") * F.col("f")).alias("f")))


def path_levels(
    nodes: DataFrame, edges: DataFrame, length: int, corrected: bool = False, weights: DataFrame | None = None, lam: float = 1.0, epsilon: float | None = None
) -> DataFrame:
    """(i, j, len, k): walks of product graphs that never return at once to the point before; with ``corrected`` to the node
    before of neither graph. A walk weighs ``lam`` times the weights of both its nodes a step (``weights`` (g, id, w); without
    them all are one, and k is a count, exact up to 2**53).

    Where product graphs have no cycle these are its simple paths, and with ``corrected`` pairs of simple paths of two
    graphs without cycles that read alike; a ring can be gone round. ``epsilon`` ends a pair as in ``walk_kernel``. Walks of a few
    nodes are compared by their labels and by where they turn back, longer ones in product graphs.
    """
    if epsilon is None and length <= SHORT_WALKS:
        weighed = nodes.select("g", "id", "sym", F.lit(1.0).alias("w")) if weights is None else nodes.join(weights, ["g", "id"]).select("g", "id", "sym", "w")
        found = materialise(_turning_features(weighed, edges, length), "turning-walks")
        found = found.where("turns = 0") if corrected else found
        a, b = found.withColumnRenamed("g", "i"), found.select(F.col("g").alias("j"), F.col("walk").alias("walk_"), F.col("turns").alias("turns_"), F.col("f").alias("f_"))
        met = a.join(b, F.col("walk") == F.col("walk_")).where((F.col("j") <= F.col("i")) & (F.col("turns").bitwiseAND(F.col("turns_")) == 0))
        return met.groupBy("i", "j", "len").agg(F.sum(F.col("f") * F.col("f_")).alias("k")).withColumn("k", F.col("k") * F.pow(F.lit(lam), "len"))
    own = nodes.select("g", "id", "sym", F.lit(1.0).alias("w")) if weights is None else nodes.join(weights, ["g", "id"])
    own = own.select("g", "id", "sym", (F.col("w") * math.sqrt(lam)).alias("a"), F.lit(1.0).alias("s"), F.lit(1.0).alias("q"))
    return pairs.levels(own, _plain_arcs(edges), length, epsilon, how=lambda product: product.path_levels(corrected))


def _turning_features(nodes: DataFrame, edges: DataFrame, length: int) -> DataFrame:
    """(g, walk, len, turns, f): label walks of 1..``length`` nodes by where they go back to the node before, a bit for each
    step but the first; a walk weighs the product of its nodes' ``w``. Of two walks that read alike one in each graph, the walk of
    the product graph turns back where both do."""
    to = nodes.select("g", F.col("id").alias("next"), "sym", "w")
    steps = adjacency(edges).select("g", F.col("src").alias("at"), F.col("dst").alias("next"), "chg").join(to, ["g", "next"])
    steps = steps.select("g", "at", "next", _step(F.col("chg"), "sym").alias("step"), "w")
    now = nodes.select("g", F.lit(None).cast("long").alias("from"), F.col("id").alias("at"), F.concat(F.lit("("), "sym").alias("walk"), F.lit(0).alias("turns"), F.col("w").alias("f"))
    levels = []
    for n in range(1, length + 1):
        levels.append(now.groupBy("g", "walk", F.lit(n).alias("len"), "turns").agg(F.sum("f").alias("f")))
        if n < length:
            back = F.coalesce(F.col("next") == F.col("from"), F.lit(False)).cast("int")
            moved = now.join(steps, ["g", "at"]).select("g", F.col("at").alias("from"), F.col("next").alias("at"), F.concat("walk", "step").alias("walk"), (F.col("turns") * 2 + back).alias("turns"), (F.col("f") * F.col("w")).alias("f"))
            now = moved.groupBy("g", "from", "at", "walk", "turns").agg(F.sum("f").alias("f"))
    return _all(levels)


def path_counts(nodes: DataFrame, edges: DataFrame, length: int) -> DataFrame:
    """(i, j, len, n, corrected): ``path_levels`` as whole numbers, by the point before and by the nodes before."""
    count = lambda corrected, name: path_levels(nodes, edges, length, corrected).select("i", "j", "len", F.col("k").cast("long").alias(name))
    return count(False, "n").join(count(True, "corrected"), ["i", "j", "len"], "left").na.fill(0, ["corrected"])


def distance_sums(nodes: DataFrame, edges: DataFrame, distance: DataFrame, length: int) -> DataFrame:
    """(g, id, len, total, n): how many walks of ``len`` nodes that start at a node have that sum of distances.

    ``distance`` is (g, id, dist), whole numbers; nodes without one, or with null, lie on no walk. A round moves the neighbours'
    histograms by a node's own distance and adds them up, on the map side: only the graphs are shuffled.
    """
    own = distance.where("dist is not null").select("g", "id", F.col("dist").cast("long").alias("sym"))

    def one(ids, dists, src, dst, chg):
        dist = dict(zip(ids, dists))
        near: dict[int, list[int]] = {i: [] for i in ids}
        for a, b in zip(src or (), dst or ()):
            if a in near and b in near:
                near[a].append(b)
                near[b].append(a)
        now = {i: {d: 1} for i, d in dist.items()}
        for k in range(1, length + 1):
            yield from ((i, k, total, n) for i, sums in now.items() for total, n in sums.items())
            if k < length:
                met: dict[int, Counter] = {i: Counter() for i in ids}
                for i, sums in met.items():
                    for b in near[i]:
                        for total, n in now[b].items():
                            sums[total + dist[i]] += n
                now = met

    fields = [("id", pa.int32(), "int"), ("len", pa.int32(), "int"), ("total", pa.int64(), "long"), ("n", pa.int64(), "long")]
    return by_form(nodes.select("g", "id").join(own, ["g", "id"]), edges, fields, one)


def distance_kernel(nodes: DataFrame, edges: DataFrame, distance: DataFrame, beta: float, lam: float, length: int) -> DataFrame:
    """(i, j, k): common walks weighed by the logistic of their mean distance, each length divided by what both graphs'
    own walks of that length weigh: the sum of lam^len z(i, j, len) / (z(i, len) z(j, len)).

    A weight by the mean is no product over nodes, so what is passed on is the histogram of sums (``distance_sums``). z(g, len)
    is the weight of all walks of a graph, and z(i, j, len) is summed over the points of the product graph, the weight
    of the walks from there by the distances of the one graph times that by the other's; both are halved beyond a
    single node, since a walk is met from both ends. Nodes without a distance lie on no walk; pairs without a common symbol have no row.
    """
    own = distance_sums(nodes, edges, distance, length).groupBy("g", "len", "total").agg(F.sum("n").alias("n"))
    twice = F.when(F.col("len") > 1, 2.0).otherwise(1.0)
    alone = own.groupBy("g", "len").agg(F.sum(logistic(F.col("total") / F.col("len"), beta) * F.col("n")).alias("z"))
    alone = materialise(alone.select("g", "len", (F.col("z") / twice).alias("z")), "distance-weights")
    points = nodes.join(distance.where("dist is not null"), ["g", "id"]).select("g", "id", "sym", F.col("dist").alias("a"), F.lit(1.0).alias("s"), F.lit(1.0).alias("q"))
    near = points.select("g", "id")
    arcs = _plain_arcs(edges).join(near.withColumnRenamed("id", "src"), ["g", "src"], "semi").join(near.withColumnRenamed("id", "dst"), ["g", "dst"], "semi")
    if length <= DISTANCE_WALKS:
        features = materialise(_distance_features(points, arcs, beta, length), "distance-features")
        a, b = features.withColumnRenamed("g", "i"), features.select(F.col("g").alias("j"), F.col("one").alias("two_"), F.col("two").alias("one_"), F.col("f").alias("f_"))
        met = a.join(b, (F.col("one") == F.col("one_")) & (F.col("two") == F.col("two_"))).where("j <= i")
        parts = met.groupBy("i", "j", "len").agg(F.sum(F.col("f") * F.col("f_")).alias("k"))
    else:
        parts = pairs.levels(points, arcs, length, how=lambda product: product.distance_levels(lambda mean: 1.0 / (1.0 + np.exp(beta * (mean - 0.5)))), masked="q")
    side = lambda g, z: alone.select(F.col("g").alias(g), "len", F.col("z").alias(z))
    met = parts.join(side("i", "z1"), ["i", "len"]).join(side("j", "z2"), ["j", "len"])
    met = met.where("z1 * z2 > 0")
    return met.groupBy("i", "j").agg(F.sum(F.pow(F.lit(lam), F.col("len")) * F.col("k") / twice / (F.col("z1") * F.col("z2"))).alias("k"))


def _distance_features(points: DataFrame, arcs: DataFrame, beta: float, length: int) -> DataFrame:
    """(g, len, one, two, f): for two labels of walks that start at one node, what the walks of the first weigh by their mean
    distance times how many the second has, summed over nodes.

    A point of a product graph weighs its walks by the one graph's distances, a sum over labels of the weight in the
    one times the number in the other, and again with the graphs changed over. Their product, summed over points, is a sum over pairs of
    labels of a factor of each graph: f(one, two) here times f(two, one) there.
    """
    own = points.select("g", F.col("id").alias("src"), F.col("sym").alias("own"), F.col("a").cast("long").alias("dist"))
    steps = arcs.join(own, ["g", "src"]).select("g", "src", "dst", _step(F.col("chg"), "own").alias("step"), "dist")
    now = own.select("g", "src", F.concat(F.lit("("), "own").alias("walk"), F.col("dist").alias("total"), F.lit(1).cast("long").alias("n"))
    levels = []
    for n in range(1, length + 1):
        told = now.groupBy("g", "src", "walk").agg(F.sum(logistic(F.col("total") / n, beta) * F.col("n")).alias("u"), F.sum("n").alias("n"))
        walks = told.groupBy("g", "src").agg(F.collect_list(F.struct("walk", "u", "n")).alias("walks"))
        both = walks.select("g", F.explode("walks").alias("x"), "walks").select("g", "x", F.explode("walks").alias("y"))
        both = both.select("g", F.lit(n).alias("len"), F.col("x.walk").alias("one"), F.col("y.walk").alias("two"), (F.col("x.u") * F.col("y.n")).alias("f"))
        levels.append(both.groupBy("g", "len", "one", "two").agg(F.sum("f").alias("f")))
        if n < length:
            near = now.withColumnRenamed("src", "dst")
            moved = steps.join(near, ["g", "dst"]).select("g", "src", F.concat("walk", "step").alias("walk"), (F.col("total") + F.col("dist")).alias("total"), "n")
            now = moved.groupBy("g", "src", "walk", "total").agg(F.sum("n").alias("n"))
    return _all(levels)


def _summed(own: DataFrame, steps: DataFrame, now: DataFrame, length: int, scale) -> DataFrame:
    levels = [now.select("i", "j", "f")]
    for _ in range(length - 1):
        moved = steps.join(now.select("i", "j", F.col("a1").alias("b1"), F.col("a2").alias("b2"), "f"), ["i", "j", "b1", "b2"])
        now = scale(own, moved.groupBy(*KEY).agg(F.sum("f").alias("f")))
        levels.append(now.select("i", "j", "f"))
    out = levels[0]
    for more in levels[1:]:
        out = out.union(more)
    return out.groupBy("i", "j").agg(F.sum("f").alias("k"))


def _nontottering(own: DataFrame, arcs: DataFrame, length: int, epsilon: float | None = None) -> DataFrame:
    """(i, j, k): dot products of label walks that never step straight back, by labels or by blocks as ``_pair_levels``.

    ``own`` (g, id, sym, b, e): a walk of one node weighs b e. ``arcs`` (g, src, dst, chg, first, out, into, e): the first
    step of a walk weighs b ``first``; going on from one arc along another weighs the ``out`` of the one times the
    ``into`` of the other, and a walk that ends with an arc weighs its ``e``.
    """
    if epsilon is not None or length > SHORT_WALKS:
        points = own.select("g", "id", "sym", F.col("b").alias("a"), F.lit(1.0).alias("s"), F.col("e").alias("q"))
        return pairs.levels(points, arcs, length, epsilon, straight=True).groupBy("i", "j").agg(F.sum("k").alias("k"))
    named = arcs.join(own.select("g", F.col("id").alias("dst"), F.col("sym").alias("to")), ["g", "dst"])
    steps = named.select("g", "src", "dst", "first", "out", "into", "e", _step(F.col("chg"), "to").alias("step"))
    features = [own.groupBy("g", F.concat(F.lit("("), "sym").alias("walk")).agg(F.sum(F.col("b") * F.col("e")).alias("f"))]
    begin = own.select("g", F.col("id").alias("src"), F.concat(F.lit("("), "sym").alias("walk"), "b")
    now = steps.join(begin, ["g", "src"]).select("g", "src", "dst", "out", "e", F.concat("walk", "step").alias("walk"), (F.col("b") * F.col("first")).alias("m"))
    for n in range(2, length + 1):
        features.append(now.groupBy("g", "walk").agg(F.sum(F.col("m") * F.col("e")).alias("f")))
        if n < length:
            before = now.select("g", F.col("src").alias("from"), F.col("dst").alias("src"), "walk", (F.col("m") * F.col("out")).alias("m"))
            onward = steps.join(before, ["g", "src"]).where(F.col("from") != F.col("dst"))
            now = onward.groupBy("g", "src", "dst", "out", "e", F.concat("walk", "step").alias("walk")).agg(F.sum(F.col("m") * F.col("into")).alias("m"))
    written = materialise(_all(features), "walk-features")
    return _met(written, written, ["walk"], {"k": "f"})


def nontottering_kernel(nodes: DataFrame, edges: DataFrame, weights: DataFrame, lam: float, length: int = 50, epsilon: float | None = None) -> DataFrame:
    """As ``walk_kernel`` over walks that never turn straight back in either graph: with messages on directed edges,
    M_1(u to v) = lam w(u), M_l(u to v) = lam w(u) sum of M_(l-1)(t to u), t unlike v, and ends by lam w(v)."""
    own = nodes.join(weights, ["g", "id"]).select("g", "id", "sym", F.lit(1.0).alias("b"), (F.col("w") * math.sqrt(lam)).alias("e"))
    at = own.select("g", F.col("id").alias("src"), F.col("e").alias("into"))
    to = own.select("g", F.col("id").alias("dst"), "e")
    arcs = adjacency(edges).join(at, ["g", "src"]).join(to, ["g", "dst"]).withColumns({"first": F.col("into"), "out": F.lit(1.0)})
    return _nontottering(own, arcs, length, epsilon)


def walk_probabilities(nodes: DataFrame, edges: DataFrame, weights: DataFrame, lam: float) -> tuple[DataFrame, DataFrame]:
    """Start and end probabilities (g, id, ps, pe) and transitions (g, src, dst, pt).

    A walk starts by weight, goes on with probability ``lam`` to a neighbour by weight, or ends; without neighbours
    it ends. For each node, transitions and end add up to 1.
    """
    w = weights.select("g", "id", "w")
    start = w.withColumn("ps", F.col("w") / F.sum("w").over(Window.partitionBy("g")))
    near = adjacency(edges).select("g", "src", "dst").join(w.select("g", F.col("id").alias("dst"), "w"), ["g", "dst"])
    total = F.sum("w").over(Window.partitionBy("g", "src"))
    moves = near.withColumn("t", total).where("t > 0").select("g", "src", "dst", (F.lit(lam) * F.col("w") / F.col("t")).alias("pt"))
    left = moves.groupBy("g", F.col("src").alias("id")).agg(F.sum("pt").alias("gone"))
    nodes_out = start.join(left, ["g", "id"], "left").select("g", "id", "ps", (1 - F.coalesce("gone", F.lit(0.0))).alias("pe"))
    return nodes_out, moves


def marginal_kernel(nodes: DataFrame, edges: DataFrame, weights: DataFrame, lam: float, length: int = 50, strategy: str | None = None, epsilon: float | None = None) -> DataFrame:
    """(i, j, k): the probability that random walks on both graphs have equal labels: F_1 = Ps Pe, F_l(v) = sum over
    neighbours u of F_(l-1)(u) Pt(v, u), summed over lengths, with starts by Ps."""
    if strategy != "joins":
        return marginal_levels(nodes, edges, weights, lam, length, strategy, epsilon).groupBy("i", "j").agg(F.sum("k").alias("k"))
    ends, moves = walk_probabilities(nodes, edges, weights, lam)
    side = lambda g, a, n: ends.select(F.col("g").alias(g), F.col("id").alias(a), F.col("ps").alias(f"ps{n}"), F.col("pe").alias(f"pe{n}"))
    own = product_nodes(nodes).join(side("i", "a1", 1), ["i", "a1"]).join(side("j", "a2", 2), ["j", "a2"])
    own = own.select(*KEY, (F.col("ps1") * F.col("ps2")).alias("ps"), (F.col("pe1") * F.col("pe2")).alias("pe"))
    one = moves.select(F.col("g").alias("i"), F.col("src").alias("a1"), F.col("dst").alias("b1"), F.col("pt").alias("p1"))
    two = moves.select(F.col("g").alias("j"), F.col("src").alias("a2"), F.col("dst").alias("b2"), F.col("pt").alias("p2"))
    steps = product_edges(nodes, edges).join(one, ["i", "a1", "b1"]).join(two, ["j", "a2", "b2"])
    steps = steps.select(*KEY, "b1", "b2", (F.col("p1") * F.col("p2")).alias("pt"))
    now, levels = own.select(*KEY, F.col("pe").alias("f")), []
    for k in range(1, length + 1):
        levels.append(now.join(own, KEY).select("i", "j", (F.col("ps") * F.col("f")).alias("f")))
        if k < length:
            nxt = now.select("i", "j", F.col("a1").alias("b1"), F.col("a2").alias("b2"), "f")
            now = steps.join(nxt, ["i", "j", "b1", "b2"]).groupBy(*KEY).agg(F.sum(F.col("pt") * F.col("f")).alias("f"))
    out = levels[0]
    for more in levels[1:]:
        out = out.union(more)
    return out.groupBy("i", "j").agg(F.sum("f").alias("k"))


def constant_weights(nodes: DataFrame, value: float = 1.0) -> DataFrame:
    return nodes.select("g", "id", F.lit(value).alias("w"))


def marginal_levels(nodes: DataFrame, edges: DataFrame, weights: DataFrame, lam: float, length: int = 50, strategy: str | None = None, epsilon: float | None = None) -> DataFrame:
    """(i, j, len, k): the parts of ``marginal_kernel`` by the number of nodes of the walks."""
    ends, moves = walk_probabilities(nodes, edges, weights, lam)
    own = nodes.join(ends, ["g", "id"]).select("g", "id", "sym", F.col("pe").alias("a"), F.lit(1.0).alias("s"), F.col("ps").alias("q"))
    arcs = adjacency(edges).join(moves, ["g", "src", "dst"]).select("g", "src", "dst", "chg", F.col("pt").alias("p"))
    return _pair_levels(own, arcs, length, strategy, epsilon)


def partially_normalized(levels: DataFrame) -> DataFrame:
    """(i, j, k): each level divided by the root of both graphs' own value at that level, then summed."""
    levels = materialise(levels, "levels")
    own = levels.where("i = j").select(F.col("i").alias("d"), F.col("len").alias("dl"), F.col("k").alias("z"))
    joined = levels
    for side in ("i", "j"):
        z = own.select(F.col("d").alias(side), F.col("dl").alias("len"), F.col("z").alias(f"z{side}"))
        joined = joined.join(z, [side, "len"])
    scale = F.sqrt(F.col("zi") * F.col("zj"))
    return joined.groupBy("i", "j").agg(F.sum(F.when(scale > 0, F.col("k") / scale).otherwise(0.0)).alias("k"))


def nontottering_marginal_kernel(nodes: DataFrame, edges: DataFrame, weights: DataFrame, lam: float, length: int = 50, epsilon: float | None = None) -> DataFrame:
    """As ``marginal_kernel`` for walks of second order that never step straight back in either graph: after u to v the
    next node is drawn by weight from the neighbours of v but u, or the walk ends; dead ends end it surely."""
    ends, moves = walk_probabilities(nodes, edges, weights, lam)
    w = weights.select("g", "id", "w")
    near = adjacency(edges).select("g", "src", "dst").join(w.select("g", F.col("id").alias("dst"), F.col("w").alias("wd")), ["g", "dst"]).join(w.select("g", F.col("id").alias("src"), F.col("w").alias("ws")), ["g", "src"])
    total = near.groupBy("g", F.col("src").alias("dst")).agg(F.sum("wd").alias("total"))
    # After src to dst: what is left to choose from.
    left = near.join(total, ["g", "dst"]).select("g", "src", "dst", (F.col("total") - F.col("ws")).alias("left"), F.col("wd").alias("into"))
    goes_on = F.col("left") > 1e-12
    left = left.withColumns({"out": F.when(goes_on, F.lit(lam) / F.col("left")).otherwise(0.0), "e": F.when(goes_on, 1 - F.lit(lam)).otherwise(1.0)})
    arcs = adjacency(edges).join(left, ["g", "src", "dst"]).join(moves.withColumnRenamed("pt", "first"), ["g", "src", "dst"])
    own = nodes.join(ends, ["g", "id"]).select("g", "id", "sym", F.col("ps").alias("b"), F.col("pe").alias("e"))
    return _nontottering(own, arcs, length, epsilon)


def path_pair_kernel(paths: DataFrame, lam: float) -> DataFrame:
    """(i, j, k): lam^length over all pairs of paths with equal labels, one of each graph."""
    a = paths.select(F.col("g").alias("i"), "path", "len", F.col("freq").alias("fa"))
    b = paths.select(F.col("g").alias("j"), F.col("path").alias("pb"), F.col("freq").alias("fb"))
    sums = a.join(b, F.col("path") == F.col("pb")).where("j <= i").groupBy("i", "j", "len").agg(F.sum(F.col("fa") * F.col("fb")).alias("n"))
    return sums.groupBy("i", "j").agg(F.sum(F.pow(F.lit(lam), "len") * F.col("n")).alias("k"))


def reaction_graph_kernel(nodes: DataFrame, edges: DataFrame, molecules: DataFrame, lam: float, length: int) -> DataFrame:
    """(i, j, k): a marginal walk kernel over graphs of molecules, where two nodes match by as much as their molecules
    are alike: ``molecules`` (a, b, k) is a normalised, symmetric kernel over the nodes' symbols."""
    ends, moves = walk_probabilities(nodes, edges, constant_weights(nodes), lam)
    named = materialise(nodes.select("g", "id", "sym").join(ends, ["g", "id"]), "ends")
    one = named.select(F.col("g").alias("i"), F.col("id").alias("a1"), F.col("sym").alias("a"), F.col("ps").alias("ps1"), F.col("pe").alias("pe1"))
    two = named.select(F.col("g").alias("j"), F.col("id").alias("a2"), F.col("sym").alias("b"), F.col("ps").alias("ps2"), F.col("pe").alias("pe2"))
    own = one.join(molecules, "a").join(two, "b").where("j <= i").select(*KEY, (F.col("ps1") * F.col("ps2")).alias("ps"), (F.col("pe1") * F.col("pe2")).alias("pe"), F.col("k").alias("w"))
    own = materialise(own, "product-nodes")
    moves = materialise(moves.join(adjacency(edges), ["g", "src", "dst"]), "moves")
    step = lambda g, a, b, n: moves.select(F.col("g").alias(g), F.col("src").alias(a), F.col("dst").alias(b), F.col("pt").alias(f"p{n}"), F.col("chg").alias(f"c{n}"))
    now, levels = own.select(*KEY, (F.col("pe") * F.col("w")).alias("f")), []
    for k in range(1, length + 1):
        levels.append(now.join(own.select(*KEY, "ps"), KEY).select("i", "j", (F.col("ps") * F.col("f")).alias("f")))
        if k < length:
            nxt = now.select("i", "j", F.col("a1").alias("b1"), F.col("a2").alias("b2"), "f")
            moved = nxt.join(step("i", "a1", "b1", 1), ["i", "b1"]).join(step("j", "a2", "b2", 2), ["j", "b2"]).where("c1 = c2")
            moved = moved.groupBy(*KEY).agg(F.sum(F.col("p1") * F.col("p2") * F.col("f")).alias("f"))
            now = materialise(moved.join(own.select(*KEY, "w"), KEY).select(*KEY, (F.col("w") * F.col("f")).alias("f")), "level")
    out = levels[0]
    for more in levels[1:]:
        out = out.union(more)
    return out.groupBy("i", "j").agg(F.sum("f").alias("k"))
