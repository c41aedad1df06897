"""Label paths of graphs: enumeration, frequencies, the path index and its queries.

A path is a sequence of nodes of one graph without a repeated node; its label is
each node's symbol after the bracket of the edge that led to it, ``(`` for the
first. Every undirected path counts once in each direction.

Four strategies give the same table. ``graphs`` walks one graph at a time on the
map side, graphs that are equal once in a task, and combines equal paths before anything is
shuffled: the fastest while a single graph's paths fit a task. ``parts`` walks likewise, but passes a graph's
paths on whenever many are held and adds them up after a shuffle, so a task holds
the graph only. ``joins`` extends all paths of all graphs by one node
per round with equi-joins, so one very large graph spreads over tasks. ``sql`` is
the recursive query.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pathloom.schema import BRACKETS
from pathloom.scratch import materialise, numbered


def adjacency(edges: DataFrame) -> DataFrame:
    """Edges in both directions."""
    return edges.select("g", "src", "dst", "chg").union(edges.select("g", F.col("dst").alias("src"), F.col("src").alias("dst"), "chg"))


def bracket(change: Column) -> Column:
    return F.when(change == 0, BRACKETS[0]).when(change < 0, BRACKETS[-1]).otherwise(BRACKETS[1])


def as_graphs(nodes: DataFrame, edges: DataFrame | None) -> DataFrame:
    """One row per graph: g, ids, syms, and the edges as arrays; both sides are dealt by g once. Without edges, ``nodes`` are such rows already."""
    if edges is None:
        return nodes
    own = nodes.groupBy("g").agg(F.collect_list(F.struct("id", "sym")).alias("n"))
    links = edges.groupBy("g").agg(F.collect_list(F.struct("src", "dst", "chg")).alias("e"))
    both = own.join(links, "g", "left")
    return both.select("g", F.col("n.id").alias("ids"), F.col("n.sym").alias("syms"), F.col("e.src").alias("src"), F.col("e.dst").alias("dst"), F.col("e.chg").alias("chg"))


#: So many different paths of a graph are held before they are passed on, where a graph is walked in parts.
HELD = 100_000


def walk_graph(ids: list[int], syms: list[str], src: list[int] | None, dst: list[int] | None, chg: list[int] | None, max_depth: int) -> Counter:
    """(path, length) -> frequency of one graph."""
    found: Counter = Counter()
    for part in walk_parts(ids, syms, src, dst, chg, max_depth, None):
        found = part
    return found


def walk_parts(ids: list[int], syms: list[str], src: list[int] | None, dst: list[int] | None, chg: list[int] | None, max_depth: int, held: int | None) -> Iterator[Counter]:
    """(path, length) -> frequency of one graph in parts that add up, each of up to about ``held`` paths; null: in one."""
    sign = lambda c: BRACKETS[(c > 0) - (c < 0)]
    label = dict(zip(ids, syms))
    near: dict[int, list[tuple[int, str]]] = {i: [] for i in ids}
    for a, b, c in zip(src or (), dst or (), chg or ()):
        near[a].append((b, sign(c) + label[b]))
        near[b].append((a, sign(c) + label[a]))
    found: Counter = Counter()
    for start in ids:
        first = BRACKETS[0] + label[start]
        found[first, 1] += 1
        seen = {start}
        open_ = [(start, first, iter(near[start]))]
        while open_:
            if held and len(found) >= held:
                yield found
                found = Counter()
            node, path, rest = open_[-1]
            for other, step in rest if len(open_) < max_depth else ():
                if other not in seen:
                    longer = path + step
                    found[longer, len(open_) + 1] += 1
                    seen.add(other)
                    open_.append((other, longer, iter(near[other])))
                    break
            else:
                open_.pop()
                seen.discard(node)
    yield found


def path_table(nodes: DataFrame, edges: DataFrame | None, max_depth: int = 50, strategy: str = "graphs") -> DataFrame:
    """(g, path, len, freq) of all simple paths of at most ``max_depth`` nodes."""
    if strategy == "joins":
        return _by_joins(nodes, edges, max_depth)
    if strategy == "sql":
        return _by_sql(nodes, edges, max_depth)
    if strategy != "parts":
        from pathloom.operators.graphs import by_form

        fields = [("path", pa.string(), "string"), ("len", pa.int32(), "int"), ("freq", pa.int64(), "long")]
        return by_form(nodes, edges, fields, lambda *graph: ((path, n, freq) for (path, n), freq in walk_graph(*graph, max_depth).items()))
    schema = pa.schema([("g", pa.int64()), ("path", pa.string()), ("len", pa.int32()), ("freq", pa.int64())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for row in range(batch.num_rows):
                g, *graph = (c[row].as_py() for c in batch.columns)
                for part in walk_parts(*graph, max_depth, HELD):
                    for (path, n), freq in part.items():
                        for values, v in zip(out, (g, path, n, freq)):
                            values.append(v)
                    if len(out[0]) >= 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema)], schema=schema)
                        out = [[], [], [], []]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema)], schema=schema)

    dealt = as_graphs(nodes, edges).repartition(max(200, nodes.sparkSession.sparkContext.defaultParallelism), "g")
    return dealt.mapInArrow(walk, "g long, path string, len int, freq long").groupBy("g", "path", "len").agg(F.sum("freq").alias("freq"))


def _by_joins(nodes: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """One join per length. Rounds end when no path grows; each is written to the scratch folder."""
    symbols = nodes.select("g", F.col("id").alias("dst"), "sym")
    steps = adjacency(edges).join(symbols, ["g", "dst"]).select("g", "src", "dst", F.concat(bracket(F.col("chg")), "sym").alias("step"))
    steps = materialise(steps, "steps")
    now = nodes.select("g", F.col("id").alias("at"), F.array("id").alias("seen"), F.concat(F.lit(BRACKETS[0]), "sym").alias("path"), F.lit(1).alias("len"))
    rounds = []
    for _ in range(max_depth):
        now = materialise(now, "paths")
        rounds.append(now.select("g", "path", "len"))
        if now.isEmpty():
            break
        longer = now.join(steps, (now["g"] == steps["g"]) & (F.col("at") == F.col("src"))).where(~F.array_contains("seen", F.col("dst")))
        now = longer.select(now["g"], F.col("dst").alias("at"), F.concat("seen", F.array("dst")).alias("seen"), F.concat("path", "step").alias("path"), (F.col("len") + 1).alias("len"))
    out = rounds[0]
    for more in rounds[1:]:
        out = out.union(more)
    return out.groupBy("g", "path", "len").agg(F.count("*").alias("freq"))


def _by_sql(nodes: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """The recursive query. It fails beyond the session's ``spark.sql.cteRecursionRowLimit``, a million rows if not set."""
    steps = adjacency(edges).select("g", "src", "dst", bracket(F.col("chg")).alias("b"))
    return nodes.sparkSession.sql(
        f"""
        WITH RECURSIVE w(g, cur, visited, path, len) MAX RECURSION LEVEL {max_depth + 1} AS (
          SELECT g, id, array(id), concat('(', sym), 1 FROM {{nodes}}
          UNION ALL
          SELECT w.g, s.dst, concat(w.visited, array(s.dst)), concat(w.path, s.b, n.sym), w.len + 1
          FROM w JOIN {{steps}} s ON s.g = w.g AND s.src = w.cur JOIN {{nodes}} n ON n.g = s.g AND n.id = s.dst
          WHERE w.len < {max_depth} AND NOT array_contains(w.visited, s.dst))
        SELECT g, path, len, count(*) AS freq FROM w GROUP BY g, path, len""",
        nodes=nodes,
        steps=steps,
    )


def is_core(path: Column) -> Column:
    """A path over an edge that is cleaved or formed."""
    return path.contains(BRACKETS[-1]) | path.contains(BRACKETS[1])


def shared_paths(paths: DataFrame, more_than: int) -> DataFrame:
    """Paths in more than ``more_than`` graphs."""
    return paths.groupBy("path", "len").agg(F.count("*").alias("n_graphs"), F.sum("freq").alias("total")).where(F.col("n_graphs") > more_than)


def of_length(paths: DataFrame, low: int, high: int) -> DataFrame:
    """Paths of ``low`` to ``high`` nodes."""
    return paths.where(F.col("len").between(low, high))


def core_paths(paths: DataFrame) -> DataFrame:
    return paths.where(is_core(F.col("path"))).groupBy("path", "len").agg(F.sum("freq").alias("freq"))


def length_histogram(paths: DataFrame) -> DataFrame:
    """Occurrences and distinct paths of each length; distinct paths are combined first, so one pass has no expansion."""
    return paths.groupBy("path", "len").agg(F.sum("freq").alias("f")).groupBy("len").agg(F.sum("f").alias("n_paths"), F.count("*").alias("n_distinct"))


def reverse_direction(paths: DataFrame) -> DataFrame:
    """The paths of graphs whose changes are reversed: cleaved and formed swap."""
    return paths.withColumn("path", F.translate("path", "{[", "[{"))


# The path index: the table sorted by path, so that a prefix is a range that Parquet statistics prune.


def write_index(paths: DataFrame, folder: str) -> None:
    paths.repartitionByRange("path", "g").sortWithinPartitions("path", "g").write.parquet(folder)


def read_index(spark, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def descend(index: DataFrame, prefix: str) -> DataFrame:
    """The rows at or below a path, at a label's boundary."""
    below = F.substring("path", len(prefix) + 1, 1).isin(*BRACKETS.values())
    return index.where(F.col("path").startswith(prefix) & ((F.col("path") == prefix) | below))


def subpath_count(index: DataFrame, patterns: list[str]) -> DataFrame:
    """Occurrences of each pattern; 0 if there is none."""
    asked = index.sparkSession.createDataFrame([(p,) for p in dict.fromkeys(patterns)], "path string")
    found = index.where(F.col("path").isin(*patterns)).groupBy("path").agg(F.sum("freq").alias("n"))
    return asked.join(F.broadcast(found), "path", "left").select("path", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def subpath_freq(index: DataFrame, patterns: list[str]) -> DataFrame:
    return index.where(F.col("path").isin(*patterns)).groupBy("path", "g").agg(F.sum("freq").alias("n"))


def child_symbols(index: DataFrame, prefix: str) -> DataFrame:
    """Distinct steps (bracket and symbol) right below a path."""
    step = F.regexp_extract(F.substring("path", len(prefix) + 1, 1 << 30), r"^[({\[][^({\[]*", 0)
    return descend(index, prefix).where(F.col("path") != prefix).select(step.alias("step")).distinct()


# Sparse features.


def feature_ids(paths: DataFrame) -> DataFrame:
    """(path, len, path_id): paths numbered from 1 by length, then label, in ranges."""
    return numbered(paths.select("len", "path").distinct(), "path_id", "len", "path").select("path", "len", "path_id")


def feature_triples(paths: DataFrame) -> DataFrame:
    """(path_id, graph_id, freq); graphs numbered from 1 by g. Paths are enumerated once and written."""
    paths = materialise(paths, "paths")
    graphs = numbered(paths.select("g").distinct(), "graph_id", "g")
    ids = feature_ids(paths).select("path", "path_id")
    return paths.join(ids, "path").join(graphs, "g").select("path_id", "graph_id", "freq")


def feature_pivot(paths: DataFrame, patterns: list[str]) -> DataFrame:
    """One row per graph, one column per pattern, 0 where it doesn't occur."""
    counts = [F.sum(F.when(F.col("path") == p, F.col("freq")).otherwise(0)).alias(f"f{k}") for k, p in enumerate(patterns, 1)]
    return paths.groupBy("g").agg(*counts)


def ngrams(chains: DataFrame, n: int) -> DataFrame:
    """(path, g, freq) of windows of 1..n consecutive labels of (g, id, sym), by one window and one explode."""
    w = Window.partitionBy("g").orderBy("id")
    steps = [F.concat(F.lit(BRACKETS[0]), F.lead("sym", k).over(w)) for k in range(n)]
    made = [F.concat(*steps[: k + 1]) for k in range(n)]
    rows = chains.select("g", F.array(*made).alias("paths")).select("g", F.explode("paths").alias("path")).where("path is not null")
    return rows.groupBy("path", "g").agg(F.count("*").alias("freq"))
