"""Products of graphs over the labels of shortest paths, without writing a label out.

A task holds graphs, or a graph and a part of its start nodes, and goes on by one node a round from all starts at once.
Equal labels of a round have equal ranks there; between tasks a label is told by 128 bits of hash that each step
extends. A label that begins with one that only its own graph has is in no other graph either, so only labels whose
first part is in several graphs are shuffled, and what the others add is summed where they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pathloom.operators.paths import as_graphs
from pathloom.schema import BRACKETS
from pathloom.scratch import discard, materialise

#: A round of more steps than this in one task is cut into parts of the starts, whose labels are all shuffled.
WIDE = 4_000_000
#: Labels are compared between graphs at this size first, then at twice the last.
FIRST_LOOK = 8
_ROWS = pa.schema([("g", pa.int64()), ("size", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
_DDL = "g long, size int, a long, b long, n long"
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64), np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def _hashes(texts: list[str]) -> np.ndarray:
    return np.array([np.frombuffer(blake2b(t.encode(), digest_size=16).digest(), np.uint64) for t in texts], np.uint64).reshape(-1, 2)


def _extended(hashes: np.ndarray, steps: np.ndarray) -> np.ndarray:
    x = hashes * _ODD[0] + steps
    x ^= x >> np.uint64(29)
    x *= _ODD[1]
    return x ^ (x >> np.uint64(32))


def _within(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


class _Graph:
    """A graph's neighbours in one array, with the number of the step (bracket and symbol) to each; steps are in order."""

    def __init__(self, ids, syms, src, dst, chg) -> None:
        own = np.asarray(ids, np.int64)
        order = np.argsort(own, kind="stable")
        ends = [order[np.searchsorted(own, np.asarray(e if e is not None else [], np.int64), sorter=order)] for e in (src, dst)]
        sign = np.sign(np.asarray(chg if chg is not None else [], np.int64)) + 1
        self.n = len(own)
        names, sym = np.unique(np.asarray(syms, object), return_inverse=True)
        a, b = np.concatenate(ends), np.concatenate(ends[::-1])
        step = np.concatenate([sign, sign]) * len(names) + sym[b]
        by_node = np.argsort(a, kind="stable")
        self.first = np.searchsorted(a[by_node], np.arange(self.n + 1))
        self.near = b[by_node]
        made, step = np.unique(step[by_node], return_inverse=True)
        texts = [BRACKETS[int(s) // len(names) - 1] + names[int(s) % len(names)] for s in made]
        placed = sorted(range(len(texts)), key=texts.__getitem__)
        self.steps = [texts[k] for k in placed]
        self.step = np.argsort(np.asarray(placed, np.int64))[step] if placed else step
        self.step_hash = _hashes(self.steps)
        self.starts, self.start_hash = sym, _hashes([BRACKETS[0] + s for s in names])
        self.start_texts = [BRACKETS[0] + s for s in names]
        #: Where no step begins another, labels are in the order of their first different step.
        self.plain = not any(y.startswith(x) for x, y in zip(self.steps, self.steps[1:]))

    def levels(self, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray] | None]:
        """(size, rank of each pair's label, hashes of the ranks, rank of what a rank's label goes on from) for sizes from 1;
        the label is the least of a pair's shortest paths. Null, and no more, where a round is too wide for one task."""
        who, node, rank, hashes = np.arange(len(starts)), starts, self.starts[starts], self.start_hash
        last, now, size, n_steps = np.empty(0, np.int64), who * self.n + node, 1, max(len(self.steps), 1)
        texts = None if self.plain else self.start_texts
        yield size, rank, hashes, np.arange(len(hashes))
        while len(now):
            degree = self.first[node + 1] - self.first[node]
            if degree.sum() > WIDE and len(starts) > 1:
                yield None
                return
            of = np.repeat(np.arange(len(node)), degree)
            at = np.arange(len(of)) + np.repeat(self.first[node] - np.cumsum(degree) + degree, degree)
            pair, key = who[of] * self.n + self.near[at], rank[of] * n_steps + self.step[at]
            new = ~(_within(now, pair) | _within(last, pair))  # what is next to a round is in it, or in the one before or after
            pair, key = pair[new], key[new]
            made = None
            if texts is not None:  # a label may begin another, so whole labels are put in order
                made, key = np.unique(key, return_inverse=True)
                longer = [texts[k // n_steps] + self.steps[k % n_steps] for k in made.tolist()]
                placed = np.array(sorted(range(len(longer)), key=longer.__getitem__), np.int64)
                made, key = made[placed], np.argsort(placed)[key]
            order = np.lexsort((key, pair))
            pair, key = pair[order], key[order]
            least = np.ones(len(pair), bool)
            least[1:] = pair[1:] != pair[:-1]
            last, now, key = now, pair[least], key[least]
            who, node, size = now // self.n, now % self.n, size + 1
            kept, rank = np.unique(key, return_inverse=True)
            if made is not None:
                texts, kept = [longer[placed[k]] for k in kept.tolist()], made[kept]
            before, by = kept // n_steps, kept % n_steps
            hashes = _extended(hashes[before], self.step_hash[by])
            if len(now):
                yield size, rank, hashes, before


def _rows(g: int, size: int, hashes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    signed = np.ascontiguousarray(hashes).view(np.int64)
    same = np.full(len(n), g, np.int64), np.full(len(n), size, np.int32)
    return pa.RecordBatch.from_arrays([*map(pa.array, same), pa.array(signed[:, 0].copy()), pa.array(signed[:, 1].copy()), pa.array(n.astype(np.int64))], schema=_ROWS)


def _sum(g: int, size: int, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((g, size, None, None, n), _ROWS)], schema=_ROWS)


def _walked(g: int, graph: _Graph, starts: np.ndarray, shared: np.ndarray, done: int, upto: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """Counts of labels of ``done`` + 1 to ``upto`` nodes; of labels that go on from none of ``shared`` (hashes of size ``done``)
    only the sum of squares of the counts, if all of the graph's starts are here."""
    open_ = None
    for level in graph.levels(starts):
        if level is None:
            for half in np.array_split(starts, 2):
                yield from _walked(g, graph, half, shared, max(done, size), upto, whole=False)
            return
        size, rank, hashes, before = level
        if size == done:
            open_ = np.isin(np.ascontiguousarray(hashes).view("V16").ravel(), shared) if done > 1 else np.ones(len(hashes), bool)
        elif size > done:
            open_ = open_[before] if whole else np.ones(len(hashes), bool)
            n = np.bincount(rank, minlength=len(hashes))
            if open_.any():
                yield _rows(g, size, hashes[open_], n[open_])
            if not open_.all():
                yield _sum(g, size, int((n[~open_] ** 2).sum()))
        if size == upto:
            return


def _counted(graphs: DataFrame, done: int, upto: int, whole: bool) -> DataFrame:
    """(g, size, a, b, n): labels by their hash and how many pairs have them; sums of squares where a and b are null."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                g, ids, syms, src, dst, chg, low, high, shared = (c[row].as_py() if k in (0, 6, 7) else c[row].values for k, c in enumerate(batch.columns))
                graph = _Graph(ids.to_numpy(zero_copy_only=False), syms.to_pylist(), *(None if e is None else e.to_numpy(zero_copy_only=False) for e in (src, dst, chg)))
                known = np.array([], "V16") if shared is None else np.stack([shared.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)], 1).astype(np.int64).view("V16").ravel()
                yield from _walked(g, graph, np.arange(graph.n)[low:high], known, done, upto, whole)

    return graphs.mapInArrow(walk, _DDL)


def _products(counts: DataFrame) -> DataFrame:
    """(i, j, size, p), j <= i: sums of products over common labels. Both sides of the join are one shuffle by label."""
    own = counts.where("a is not null").repartition("size", "a", "b").groupBy("g", "size", "a", "b").agg(F.sum("n").alias("n"))
    other = own.select(F.col("g").alias("j"), *(F.col(c).alias(f"j_{c}") for c in ("size", "a", "b", "n")))
    same = (F.col("size") == F.col("j_size")) & (F.col("a") == F.col("j_a")) & (F.col("b") == F.col("j_b"))
    met = own.join(other, same).where("j <= g").groupBy(F.col("g").alias("i"), "j", "size").agg(F.sum(F.col("n") * F.col("j_n")).alias("p"))
    return met.unionByName(counts.where("a is null").select(F.col("g").alias("i"), F.col("g").alias("j"), "size", F.col("n").alias("p")))


def last_size(lam: float, largest: int) -> int:
    """The size beyond which no term of the sum of lam^size p changes it, in graphs of up to ``largest`` nodes.

    Graphs with a common label have one of size 2, so a sum is at least lam^2 by then. A later p is at most ``largest``^4, as
    pairs of nodes are met with pairs; below 2^-54 of the sum a term, added in the order of sizes, leaves a double as it is.
    """
    if not 0 < lam < 1 or largest < 2:
        return largest
    return min(largest, 3 + math.ceil((54 * math.log(2) + 4 * math.log(largest)) / -math.log(lam)))


def shortest_path_products(nodes: DataFrame, edges: DataFrame, lam: float, spread: bool) -> DataFrame:
    """(i, j, size, p), j <= i: products of the counts of shortest-path labels of each size from 2, up to ``last_size``.

    ``spread`` deals parts of a graph's starts to tasks, at most 16 for each graph, and shuffles all labels.
    """
    spark, held = nodes.sparkSession, []
    graphs = materialise(as_graphs(nodes, edges), "graphs", held)
    largest = graphs.agg(F.max(F.size("ids"))).first()[0] or 0
    upto = last_size(lam, largest)
    part = F.greatest(F.lit(1000), F.ceil(F.size("ids") / 16)).cast("int") if spread else F.size("ids")
    dealt = graphs.withColumn("part", part).select("*", F.explode(F.expr("sequence(0, size(ids) - 1, part)")).alias("low"))
    dealt = dealt.select(*graphs.columns, "low", (F.col("low") + F.col("part")).alias("high"))
    tasks = max(200, spark.sparkContext.defaultParallelism)
    done, out, labels = 1, None, None
    while True:
        if labels is None:
            ready = dealt.withColumn("shared", F.lit(None).cast("array<struct<a:long,b:long>>"))
        else:
            ready = dealt.join(labels.groupBy("g").agg(F.collect_list(F.struct("a", "b")).alias("shared")), "g", "left")
        rest = spread or (labels is not None and labels.isEmpty())
        until = upto if rest else min(upto, max(FIRST_LOOK, 2 * done))
        counts = _counted(ready.repartition(tasks, "g", "low"), done, until, not spread)
        if not spread:
            counts = materialise(counts, "labels", held)
        found = materialise(_products(counts), "label-products")
        out = found if out is None else out.unionByName(found)
        if until >= upto:
            break
        at = counts.where((F.col("size") == until) & F.col("a").isNotNull()).select("g", "a", "b").distinct()
        several = at.groupBy("a", "b").agg(F.count("*").alias("graphs")).where("graphs > 1").drop("graphs")
        labels, done = materialise(at.join(several, ["a", "b"]), "shared-labels", held), until
    discard(spark, held)
    return out


def shortest_path_kernel(nodes: DataFrame, edges: DataFrame, lam: float = 1.0, strategy: str = "graphs") -> DataFrame:
    """(i, j, k): sum over common features of lam^size f f', added in the order of sizes; ``joins`` spreads the starts of a
    graph over tasks. Symbols hold no brackets."""
    sums = shortest_path_products(nodes, edges, lam, strategy == "joins").groupBy("i", "j", "size").agg(F.sum("p").alias("p"))
    terms = sums.groupBy("i", "j").agg(F.array_sort(F.collect_list(F.struct("size", "p"))).alias("t"))
    return terms.select("i", "j", F.aggregate("t", F.lit(0.0), lambda s, x: s + F.pow(F.lit(lam), x["size"]) * x["p"]).alias("k"))
