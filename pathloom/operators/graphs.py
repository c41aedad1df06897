"""Graph statistics and distances: formulas, spectra, core distance, breadth-first distances, reaction networks."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pathloom.operators.paths import adjacency, as_graphs
from pathloom.scratch import discard, materialise, numbered


def formula(nodes: DataFrame) -> DataFrame:
    """(g, key, n): how often each symbol occurs."""
    return nodes.groupBy("g", F.col("sym").alias("key")).agg(F.count("*").alias("n"))


def _with_symbols(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    a = nodes.select("g", F.col("id").alias("src"), F.col("sym").alias("a"))
    b = nodes.select("g", F.col("id").alias("dst"), F.col("sym").alias("b"))
    return edges.join(a, ["g", "src"]).join(b, ["g", "dst"])


def bond_spectrum(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, key, n): edges by their end symbols in order and their change between them."""
    key = F.concat(F.least("a", "b"), F.col("chg").cast("string"), F.greatest("a", "b"))
    return _with_symbols(nodes, edges).groupBy("g", key.alias("key")).agg(F.count("*").alias("n"))


def node_spectrum(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, key, n): nodes by their symbol and the sorted symbols of their neighbours."""
    near = _with_symbols(nodes, adjacency(edges)).groupBy("g", F.col("src").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("b")), "").alias("near"))
    key = F.concat("sym", F.lit(":"), F.coalesce("near", F.lit("")))
    return nodes.join(near, ["g", "id"], "left").groupBy("g", key.alias("key")).agg(F.count("*").alias("n"))


def neighbouring(nodes: DataFrame) -> DataFrame:
    """(g1, g2): each graph and the next one in the order of ids, of graphs numbered in ranges."""
    ids = numbered(nodes.select("g").distinct(), "n", "g")
    after = ids.select(F.col("g").alias("g2"), (F.col("n") - 1).alias("n"))
    return ids.join(after, "n").select(F.col("g").alias("g1"), "g2")


def spectrum_similarity(spectrum: DataFrame, pairs: DataFrame) -> DataFrame:
    """(g1, g2, sim): (total - sum of absolute differences) / total over the pairs' spectra."""
    one = pairs.join(spectrum, F.col("g1") == F.col("g")).select("g1", "g2", "key", F.col("n").alias("n1"), F.lit(0).cast("long").alias("n2"))
    two = pairs.join(spectrum, F.col("g2") == F.col("g")).select("g1", "g2", "key", F.lit(0).cast("long").alias("n1"), F.col("n").alias("n2"))
    both = one.union(two).groupBy("g1", "g2", "key").agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2"))
    total, apart = F.sum(F.col("n1") + F.col("n2")), F.sum(F.abs(F.col("n1") - F.col("n2")))
    return both.groupBy("g1", "g2").agg(((total - apart) / total).alias("sim"))


def distances(starts: DataFrame, edges: DataFrame, within: int | None = None) -> DataFrame:
    """(g, source, id, dist): breadth-first distances from (g, source, id), one join per hop, ``id`` at distance 0.

    A round extends only what the last one reached. Edges go both ways, so what it meets again lies in the last two
    rounds, and only these are removed. It ends when nothing new is met, or after ``within`` hops, if such are asked for.
    """
    held: list[str] = []
    steps = adjacency(edges).select("g", F.col("src").alias("id"), F.col("dst").alias("next")).distinct()
    steps = materialise(steps, "steps", held)
    front = materialise(starts.select("g", "source", "id", F.lit(0).alias("dist")).distinct(), "front", held)
    known, last, hop = [front], front, 0
    while not front.isEmpty() and (within is None or hop < within):
        hop += 1
        met = front.join(steps, ["g", "id"]).select("g", "source", F.col("next").alias("id")).distinct()
        new = met.join(front.unionByName(last), ["g", "source", "id"], "left_anti").withColumn("dist", F.lit(hop))
        last, front = front, materialise(new, "front", held)
        known.append(front)
        if len(known) == 32:  # a plan over hundreds of rounds would take longer than they
            known = [materialise(_together(known), "known", held)]
    out = materialise(_together(known), "distances")
    discard(edges.sparkSession, held)
    return out


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _bfs(starts: list[int], near: dict[int, list[int]], within: int | None = None) -> dict[int, int]:
    known = dict.fromkeys(starts, 0)
    open_ = deque(starts)
    while open_:
        at = open_.popleft()
        if known[at] == within:
            break
        for other in near[at]:
            if other not in known:
                known[other] = known[at] + 1
                open_.append(other)
    return known


def neighbours_in(ids: list[int], src: list[int] | None, dst: list[int] | None) -> dict[int, list[int]]:
    near: dict[int, list[int]] = {i: [] for i in ids}
    for a, b in zip(src or (), dst or ()):
        near[a].append(b)
        near[b].append(a)
    return near


#: Rows of equal graphs are made once by a task: of graphs up to so many nodes, and for so many forms at a time.
FORM_NODES, FORMS = 64, 20_000
_BATCH_ROWS = 50_000


def _lists(column: pa.ListArray) -> list[list | None]:
    """As ``to_pylist``, with one call for all values."""
    at, values, there = column.offsets.to_pylist(), column.values.to_pylist(), column.is_valid().to_pylist()
    return [values[a:b] if known else None for a, b, known in zip(at, at[1:], there)]


def by_form(nodes: DataFrame, edges: DataFrame | None, fields: list[tuple[str, pa.DataType, str]], one, changes: bool = True) -> DataFrame:
    """``one(ids, syms, src, dst, chg)`` gives the rows of a graph, columns ``fields`` (name, Arrow type, DDL) after g.

    Graphs are dealt once and handled on the map side, so what is shuffled is the graphs and never their rows. Small graphs that are equal
    in all that ``one`` reads are handled once in a task; of large ones the rows are passed on as they are made. Where it reads no ``changes``,
    graphs come without them (null), and many more are equal.
    """
    schema = pa.schema([("g", pa.int64()), *((n, t) for n, t, _ in fields)])

    def arrays(columns) -> list[pa.Array]:
        return [pa.array(c, t) for c, (_, t, _) in zip(columns, fields)]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[tuple, list[pa.Array]] = {}
        for batch in batches:
            owners, parts, rows = [], [], 0

            def joined() -> pa.RecordBatch:
                g = pa.array(owners, pa.int64()).take(pa.array(np.repeat(np.arange(len(owners)), [len(p[0]) for p in parts])))
                return pa.RecordBatch.from_arrays([g, *(pa.concat_arrays(c) for c in zip(*parts))], schema=schema)

            for g, *graph in zip(batch.column(0).to_pylist(), *map(_lists, batch.columns[1:])):
                if len(graph[0]) <= FORM_NODES:
                    form = tuple(tuple(c or ()) for c in graph)
                    if (own := made.get(form)) is None:
                        if len(made) == FORMS:
                            made.clear()
                        columns = list(zip(*one(*graph))) or [()] * len(fields)
                        own = made[form] = arrays(columns)
                    found = [own]
                else:
                    every = iter(one(*graph))
                    found = (arrays(zip(*some)) for some in iter(lambda: list(islice(every, _BATCH_ROWS)), []))
                for own in found:
                    owners.append(g)
                    parts.append(own)
                    rows += len(own[0])
                    if rows >= _BATCH_ROWS:
                        yield joined()
                        owners, parts, rows = [], [], 0
            if parts:
                yield joined()

    graphs = as_graphs(nodes, edges)
    if not changes:
        graphs = graphs.withColumn("chg", F.lit(None).cast(graphs.schema["chg"].dataType))
    return graphs.mapInArrow(walk, "g long, " + ", ".join(f"{n} {d}" for n, _, d in fields))


def by_graph(nodes: DataFrame, edges: DataFrame | None, names: tuple[str, ...], one) -> DataFrame:
    """``one(ids, near, changed edges)`` gives the rows of a graph, which is handled on the map side."""

    def rows(ids, _, src, dst, chg):
        return one(ids, neighbours_in(ids, src, dst), [(a, b) for a, b, c in zip(src or (), dst or (), chg or ()) if c])

    return by_form(nodes, edges, [(n, pa.int32(), "int") for n in names], rows)


def all_pairs(nodes: DataFrame, edges: DataFrame, strategy: str = "graphs") -> DataFrame:
    """(g, a, b, dist) for all connected pairs of nodes; ``joins`` spreads a graph that is too large for a task."""
    if strategy == "joins":
        starts = nodes.select("g", F.col("id").alias("source"), "id")
        return distances(starts, edges).select("g", F.col("source").alias("a"), F.col("id").alias("b"), "dist")
    return by_graph(nodes, edges, ("a", "b", "dist"), lambda ids, near, _: ((a, b, d) for a in ids for b, d in _bfs([a], near).items()))


def core_distance(nodes: DataFrame, edges: DataFrame, strategy: str = "graphs") -> DataFrame:
    """(g, id, dist): hops to the nearest end of a changed edge; null where there is none."""
    if strategy == "joins":
        core = edges.where("chg <> 0").select("g", F.explode(F.array("src", "dst")).alias("id")).distinct()
        reached = distances(core.select("g", F.lit(0).alias("source"), "id"), edges)
        return nodes.select("g", "id").join(reached.groupBy("g", "id").agg(F.min("dist").alias("dist")), ["g", "id"], "left")

    def one(ids, near, changed):
        known = _bfs(list(dict.fromkeys(x for edge in changed for x in edge)), near)
        return ((i, known.get(i)) for i in ids)

    return by_graph(nodes, edges, ("id", "dist"), one)


def farthest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, id, dist): the node with the greatest distance to another one, the least id first."""
    far = all_pairs(nodes, edges).groupBy("g", "a").agg(F.max("dist").alias("dist"))
    return far.groupBy("g").agg(F.max_by("a", F.struct("dist", -F.col("a"))).alias("id"), F.max("dist").alias("dist"))


def heavy_atoms(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without hydrogens and their edges; the rest is numbered anew from 0."""
    return induced(nodes, edges, nodes.where(~F.col("sym").isin("H", "H+")).select("g", "id"))


def induced(nodes: DataFrame, edges: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The subgraph on the nodes ``kept`` (g, id), renumbered from 0 in the order of ids."""
    from pyspark.sql import Window

    number = kept.distinct().withColumn("new", F.row_number().over(Window.partitionBy("g").orderBy("id")) - 1)
    left = nodes.join(number, ["g", "id"]).drop("id").withColumnRenamed("new", "id").select(*nodes.columns)
    a, b = (number.select("g", F.col("id").alias(end), F.col("new").alias(f"new_{end}")) for end in ("src", "dst"))
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    links = edges.join(a, ["g", "src"]).join(b, ["g", "dst"]).select(*rest, F.col("new_src").alias("src"), F.col("new_dst").alias("dst")).select(*edges.columns)
    return left, links


def reachable(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without nodes that no changed edge reaches."""
    return induced(nodes, edges, core_distance(nodes, edges).where("dist is not null").select("g", "id"))


def canonical_hash(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, size, hash): equal for isomorphic graphs; a hash of size, formula and spectra."""
    told = lambda t: t.groupBy("g").agg(F.array_join(F.array_sort(F.collect_list(F.concat("key", F.lit("="), "n"))), ",").alias("s"))
    size = nodes.groupBy("g").agg(F.count("*").alias("size"))
    a, b, c = (told(t).withColumnRenamed("s", n) for t, n in ((formula(nodes), "a"), (bond_spectrum(nodes, edges), "b"), (node_spectrum(nodes, edges), "c")))
    joined = size.join(a, "g").join(b, "g", "left").join(c, "g")
    return joined.select("g", "size", F.xxhash64("size", "a", F.coalesce("b", F.lit("")), "c").alias("hash"))


def shared_ligands(sides: DataFrame, side: str | None = None) -> DataFrame:
    """(r1, r2): reactions r1 < r2 that share a ligand, of any or of one side.

    A ligand of very many reactions makes many pairs by nature; pairs are combined on the map side.
    """
    own = (sides if side is None else sides.where(F.col("side") == side)).select("reaction", "ligand").distinct()
    other = own.select(F.col("reaction").alias("r2"), F.col("ligand").alias("l2"))
    return own.join(other, F.col("ligand") == F.col("l2")).where("reaction < r2").select(F.col("reaction").alias("r1"), "r2").distinct()


def neighbours(network: DataFrame, reaction: int) -> DataFrame:
    """The reactions next to one in a network (r1, r2)."""
    return network.where((F.col("r1") == reaction) | (F.col("r2") == reaction)).select(F.when(F.col("r1") == reaction, F.col("r2")).otherwise(F.col("r1")).alias("reaction")).distinct()


def pieces(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, id, piece): the least node that is connected with a node."""

    def one(ids, near, _):
        out: dict[int, int] = {}
        for i in sorted(ids):
            if i not in out:
                out |= dict.fromkeys(_bfs([i], near), i)
        return out.items()

    return by_graph(nodes, edges, ("id", "piece"), one)


def least_cost(results: DataFrame, key: str = "reaction", cost: str = "cost") -> DataFrame:
    """All results of least cost under each key."""
    best = results.groupBy(key).agg(F.min(cost).alias("__least"))
    return results.join(best, key).where(F.col(cost) == F.col("__least")).drop("__least")
