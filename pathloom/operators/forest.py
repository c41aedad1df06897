"""Forests: bracketed trees, upward ranks, siblings, and counts below a path."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pathloom.scratch import discard, materialise, numbered, running, sent


_TOKEN = re.compile(r"[\[({][^\[\](){}]*|[\])}]")
_PARSED = [
    ("node", pa.int64(), "long"), ("parent", pa.int64(), "long"), ("bracket", pa.string(), "string"), ("sym", pa.string(), "string"),
    ("depth", pa.int32(), "int"), ("is_leaf", pa.bool_(), "boolean"), ("is_last", pa.bool_(), "boolean"),
]
#: Equal lines are parsed once by a task: so many at a time, of up to so many characters.
LINES, LINE_LENGTH = 20_000, 1_000
_BATCH_ROWS = 50_000


def _parsed(line: str) -> list[list]:
    """Columns ``_PARSED`` of the nodes of a line, in their order."""
    nodes: list[int] = []
    parents: list[int | None] = []
    brackets, syms, depths, open_ = [], [], [], []
    latest: dict[int | None, int] = {}  # by parent the child that came last
    level = 0
    for token in _TOKEN.findall(line):
        if token[0] in "({[":
            level += 1
            del open_[max(level - 1, 0) :]
            parent, node = open_[-1] if open_ and len(open_) == level - 1 else None, len(nodes)
            open_.append(node)
            nodes.append(node)
            parents.append(parent)
            brackets.append(token[0])
            syms.append(token[1:])
            depths.append(level)
            latest[parent] = node
        else:
            level -= 1
    return [nodes, parents, brackets, syms, depths, [n not in latest for n in nodes], [latest[p] == n for n, p in zip(nodes, parents)]]


def parse_trees(lines: DataFrame) -> DataFrame:
    """Trees from rows (entry, tree, line), a line being one balanced bracket string like ``(C(C[O]))``; (entry, tree) tells rows apart.

    (entry, tree, node, parent, bracket, sym, depth, is_leaf, is_last): an opening bracket begins a node at the depth
    that the brackets so far leave; its parent is the last node before it one level up. A line is a tree, so each is parsed where it
    lies and nothing is shuffled; null lines have no nodes.
    """
    chosen = lines.select("entry", "tree", "line")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, list[pa.Array]] = {}
        for batch in batches:
            owners: list[int] = []
            parts: list[list[pa.Array]] = []
            rows = 0

            def joined() -> pa.RecordBatch:
                at = pa.array(np.repeat(np.array(owners, np.int64), [len(p[0]) for p in parts]))
                columns = [pa.concat_arrays(c) for c in zip(*parts)]
                return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *columns], ["entry", "tree", *(n for n, _, _ in _PARSED)])

            for row, line in enumerate(batch.column(2).to_pylist()):
                if line is None:
                    continue
                if (own := made.get(line)) is None:
                    own = [pa.array(c, t) for c, (_, t, _) in zip(_parsed(line), _PARSED)]
                    if len(line) <= LINE_LENGTH:
                        if len(made) == LINES:
                            made.clear()
                        made[line] = own
                owners.append(row)
                parts.append(own)
                rows += len(own[0])
                if rows >= _BATCH_ROWS:
                    yield joined()
                    owners, parts, rows = [], [], 0
            if parts:
                yield joined()

    kinds = dict(chosen.dtypes)
    return chosen.mapInArrow(parse, f"entry {kinds['entry']}, tree {kinds['tree']}, " + ", ".join(f"{n} {d}" for n, _, d in _PARSED))


def with_flags(nodes: DataFrame, order: str = "node") -> DataFrame:
    """``nodes`` with is_leaf (no children) and is_last (the last of its siblings)."""
    parents = nodes.where("parent is not null").select(F.col("entry").alias("pe"), F.col("tree").alias("pt"), F.col("parent").alias("p")).distinct()
    joined = nodes.join(parents, (F.col("entry") == F.col("pe")) & (F.col("tree") == F.col("pt")) & (F.col("node") == F.col("p")), "left")
    joined = joined.select(*nodes.columns, F.col("p").isNull().alias("is_leaf"))
    return joined.withColumn("is_last", F.lead("node").over(Window.partitionBy("entry", "tree", "parent").orderBy(order)).isNull())


def tree_text(nodes: DataFrame) -> DataFrame:
    """(entry, tree, line): trees (with ``bracket``) as bracket strings again; the inverse of ``parse_trees``.

    A node's closing brackets are as many as the depth falls to the next node, each matching what it closes; brackets
    on the way are found from the ancestors' brackets, carried as an array along the depth-first order.
    """
    rows = nodes.groupBy("entry", "tree").agg(F.array_sort(F.collect_list(F.struct("node", "depth", "bracket", "sym"))).alias("n"))
    start = F.struct(F.lit("").alias("text"), F.array().cast("array<string>").alias("open"))
    matching = lambda b: F.when(b == "(", ")").when(b == "{", "}").otherwise("]")
    closed = lambda s, depth: F.array_join(F.transform(F.reverse(F.slice(s["open"], depth, F.greatest(F.size(s["open"]) - depth + 1, F.lit(0)))), matching), "")
    step = lambda s, x: F.struct(
        F.concat(s["text"], closed(s, x["depth"]), x["bracket"], x["sym"]).alias("text"),
        F.concat(F.slice(s["open"], F.lit(1), x["depth"] - 1), F.array(x["bracket"])).alias("open"),
    )
    return rows.select("entry", "tree", F.aggregate("n", start, step, lambda s: F.concat(s["text"], closed(s, F.lit(1)))).alias("line"))


TREE = ["entry", "tree"]


def _dealt(side: DataFrame) -> DataFrame:
    """A side that has a row for each node: shuffled in every round of a doubling, never collected to be broadcast, however
    small its compressed file looks."""
    return side.hint("merge")


def _jump(now: DataFrame, held: DataFrame, *columns: str) -> DataFrame:
    """``now`` with what ``held`` (entry, tree, node, ...) has for each row's ``up``, under names with ``up_``; null without one."""
    other = _dealt(held.select(*(F.col(c).alias(f"u_{c}") for c in TREE), F.col("node").alias("u_node"), *(F.col(c).alias(f"up_{c}") for c in columns)))
    same = (F.col("up") == F.col("u_node")) & (F.col("entry") == F.col("u_entry")) & (F.col("tree") == F.col("u_tree"))
    return now.join(other, same, "left").drop("u_entry", "u_tree", "u_node")


def upward_rank(nodes: DataFrame) -> DataFrame:
    """(entry, tree, node, rank): dense rank, over the forest, of the labels from the node up to the root.

    Prefix doubling: round k ranks the first 2^k labels of every node by the pair of its own rank and the rank of the
    node 2^k above it (0 beyond the root), and doubles what it looks up to. A tree of depth d takes about log2(d)
    rounds whatever its shape; no label string is built, and pairs are numbered in ranges.
    """
    held: list[str] = []
    symbols = numbered(nodes.select("sym").distinct(), "rank", "sym").select(F.col("sym").alias("s"), "rank")
    now = materialise(nodes.join(symbols, F.col("sym") == F.col("s")).select(*TREE, "node", F.col("parent").alias("up"), "rank"), "upward", held)
    while not now.where("up is not null").isEmpty():
        both = _jump(now, now, "up", "rank").select(*TREE, "node", F.col("up_up").alias("up"), F.col("rank").alias("first"), F.coalesce("up_rank", F.lit(0)).alias("second"))
        both = materialise(both, "upward-pairs", held)
        pairs = numbered(both.select("first", "second").distinct(), "rank", "first", "second").select(F.col("first").alias("f"), F.col("second").alias("s"), "rank")
        ranked = both.join(sent(pairs), (F.col("first") == F.col("f")) & (F.col("second") == F.col("s"))).select(*TREE, "node", "up", "rank")
        after = materialise(ranked, "upward")
        discard(nodes.sparkSession, held)
        held[:] = []
        now = after
    return now.select(*TREE, "node", F.col("rank").cast("long").alias("rank"))


def intervals(nodes: DataFrame, order: str = "node") -> DataFrame:
    """(entry, tree, node, pre, size, leaves): the place of each node in its tree's depth-first order, from 0, and how many
    nodes and leaves its subtree has. The subtree of a node is the range of places ``pre`` to ``pre + size - 1``.

    By doubling, for any depth d in about log2(d) rounds: a node's sum over descendants less than 2^k below it plus those
    of the nodes exactly 2^k below it makes its sum for 2^(k+1). A place is the sum, over the node and its ancestors, of
    what the siblings before hold and of one for the parent; such sums are doubled upwards. Siblings are summed in
    ranges (``scratch.running``), so the children of one node may lie in many tasks.
    """
    held: list[str] = []
    parents = nodes.where("parent is not null").select(*TREE, F.col("parent").alias("node")).distinct().withColumn("inner", F.lit(True))
    start = nodes.select(*TREE, "node", "parent", F.col(order).alias("at")).join(_dealt(parents), [*TREE, "node"], "left")
    start = start.select(*TREE, "node", "parent", "at", F.lit(1).cast("long").alias("size"), F.when(F.col("inner"), 0).otherwise(1).cast("long").alias("leaves"))
    start = materialise(start, "intervals", held)
    now = start.select(*TREE, "node", F.col("parent").alias("up"), "size", "leaves")
    while not now.where("up is not null").isEmpty():
        below = now.where("up is not null").groupBy(*TREE, F.col("up").alias("node")).agg(F.sum("size").alias("more"), F.sum("leaves").alias("more_leaves"))
        sums = _jump(now, now, "up").join(_dealt(below), [*TREE, "node"], "left")
        sums = sums.select(*TREE, "node", F.col("up_up").alias("up"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"))
        now = materialise(sums, "subtree-sums", held)
    sized = materialise(start.drop("size", "leaves").join(_dealt(now.drop("up")), [*TREE, "node"]), "subtree-sizes", held)

    siblings = running(sized, "before", "size", *TREE, "parent", "at", "node")
    first = siblings.groupBy(*TREE, "parent").agg(F.min("before").alias("first")).select(*(F.col(c).alias(f"f_{c}") for c in (*TREE, "parent")), "first")
    mine = (F.col("entry") == F.col("f_entry")) & (F.col("tree") == F.col("f_tree")) & F.col("parent").eqNullSafe(F.col("f_parent"))
    offset = F.col("before") - F.col("first") + F.when(F.col("parent").isNull(), 0).otherwise(1)
    now = materialise(siblings.join(_dealt(first), mine).select(*TREE, "node", F.col("parent").alias("up"), offset.alias("pre")), "offsets", held)
    while not now.where("up is not null").isEmpty():
        sums = _jump(now, now, "up", "pre").select(*TREE, "node", F.col("up_up").alias("up"), (F.col("pre") + F.coalesce("up_pre", F.lit(0))).alias("pre"))
        now = materialise(sums, "places", held)
    out = materialise(now.drop("up").join(_dealt(sized.select(*TREE, "node", "size", "leaves")), [*TREE, "node"]), "intervals")
    discard(nodes.sparkSession, held)
    return out


def at_path(nodes: DataFrame, symbols: list[str]) -> DataFrame:
    """The nodes whose labels from the root are ``symbols``: one join for each symbol, of what still fits."""
    found = nodes.where(F.col("parent").isNull() & (F.col("sym") == symbols[0]))
    for sym in symbols[1:]:
        above = found.select(*TREE, F.col("node").alias("parent"))
        found = nodes.where(F.col("sym") == sym).join(above, [*TREE, "parent"]).select(*nodes.columns)
    return found


def subtree_leaves(nodes: DataFrame, paths: dict[str, list[str]], order: str = "node") -> DataFrame:
    """(prefix, leaves): leaves at or below the nodes whose labels from the root are the path of that name; any depth."""
    places = intervals(nodes, order)
    asked = nodes.sparkSession.createDataFrame([(p,) for p in paths], "prefix string")
    hits = None
    for name, symbols in paths.items():
        own = at_path(nodes, symbols).select(F.lit(name).alias("prefix"), *TREE, "node")
        hits = own if hits is None else hits.union(own)
    if hits is None:
        return asked.withColumn("leaves", F.lit(0).cast("long"))
    found = hits.join(places, [*TREE, "node"]).groupBy("prefix").agg(F.sum("leaves").alias("n"))
    return asked.join(F.broadcast(found), "prefix", "left").select("prefix", F.coalesce("n", F.lit(0)).cast("long").alias("leaves"))


def totals(nodes: DataFrame) -> DataFrame:
    """One row: entries, trees, nodes, leaves."""
    flagged = with_flags(nodes)
    return flagged.agg(F.count_distinct("entry").alias("entries"), F.count_distinct("entry", "tree").alias("trees"), F.count("*").alias("nodes"), F.sum(F.col("is_leaf").cast("long")).alias("leaves"))


def kth_child(nodes: DataFrame, k: int, order: str = "node") -> DataFrame:
    """(parent, child): the k-th child (from 1) of each node that has one."""
    n = F.row_number().over(Window.partitionBy("entry", "tree", "parent").orderBy(order))
    return nodes.where("parent is not null").withColumn("n", n).where(F.col("n") == k).select("parent", F.col("node").alias("child"))


def degrees(nodes: DataFrame) -> DataFrame:
    """(parent, degree): the number of children."""
    return nodes.where("parent is not null").groupBy("parent").agg(F.count("*").alias("degree"))


def symbol_cumulative(nodes: DataFrame) -> DataFrame:
    """(sym, n, cum): symbol counts and their running sum in the order of symbols; a table of one row per symbol."""
    counts = nodes.groupBy("sym").agg(F.count("*").alias("n"))
    return counts.withColumn("cum", F.sum("n").over(Window.orderBy("sym")))


def rank_of(sequence: DataFrame, symbol: str, position: Column | int) -> DataFrame:
    """(g, n): how often ``symbol`` occurs in (g, id, sym) at ids up to ``position``."""
    return sequence.groupBy("g").agg(F.count_if((F.col("sym") == symbol) & (F.col("id") <= position)).alias("n"))


def select_of(sequence: DataFrame, symbol: str, k: int) -> DataFrame:
    """(g, id): the place of the k-th occurrence of ``symbol``."""
    n = F.row_number().over(Window.partitionBy("g").orderBy("id"))
    return sequence.where(F.col("sym") == symbol).withColumn("n", n).where(F.col("n") == k).select("g", "id")
