"""Hard negatives by a vantage-point tree over norm-augmented vectors.

*Augmentation.* With M the largest norm of all rows, a row x becomes (x, sqrt(M^2 -
|x|^2)) and a query q becomes (q, 0). Their squared distance is |q|^2 + M^2 - 2 q.x:
the greater the score, the smaller the distance, and a window of scores is an
annulus around the query.

*Tree.* Vantage points and median distances are fitted on ``SAMPLE`` rows at most,
chosen by a hash of their ids; every row descends to a leaf. A leaf's rows are
packed into blocks of about ``BLOCK`` rows, and a leaf knows how near and how far
from each vantage point on its path any of its rows is, so what is broadcast is
bounded by the sample, not by the rows.

*Traversal.* A query visits leaves in the order of the least distance inside its
annulus that a row of the leaf may have: first its ``NEAREST`` leaves; the k-th best
row found so far then rules out every leaf that can't hold a better one, and what
remains is visited. No leaf that may hold a result is left out, so results are exact.
The first traversal, over the same label and the whole ball, finds an anchor's
positives; the second finds, for the windows of all its positives together, the
nearest rows of other labels. A visit is a row, dealt by block and, if a block has
very many visits, by shares of them; a block scores its visits by one matrix product.

Defined results: rows with a null id, label or vector, or with any null or
non-finite component, take no part, nor do rows whose squared norm reaches 2**62,
whose scores need not fit into 64 bits; shorter vectors count as padded with zeros;
rows that repeat an id are rows of their own (and anchors of their own); ties go to
the smaller id, then to the row read first; an empty table has no rows. Extra columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pathloom.llm.common import discard, materialise, sent

SAMPLE = 16_384
LEAF_SAMPLE = 64
BLOCK = 4096
NEAREST = 8
VISITS = 16_384
MAX_NORM = 1 << 62
#: Every score is within these.
LEAST, MOST = -MAX_NORM, MAX_NORM


def quantised(rows: DataFrame, scale: float) -> DataFrame:
    """(vec_id, label, v, norm, row) of the rows that take part, from (vec_id, embedding, label)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for vec_id, vector, label in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if vec_id is None or label is None or vector is None or None in vector:
                    continue
                x = np.floor(scale * np.array(vector, np.float64))
                if np.isfinite(x).all() and float(x @ x) < MAX_NORM and (norm := sum(int(c) ** 2 for c in x)) < MAX_NORM:
                    out.append((vec_id, label, x.astype("<i4").tobytes(), norm))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.int64()))], ["vec_id", "label", "v", "norm"])

    chosen = rows.select(F.col("vec_id").cast("long"), "embedding", F.col("label").cast("long"))
    return chosen.mapInArrow(make, "vec_id long, label long, v binary, norm long").withColumn("row", F.monotonically_increasing_id())


def _matrix(data: list[bytes], dims: int) -> np.ndarray:
    """The vectors as rows, padded with zeros."""
    if all(len(v) == 4 * dims for v in data):
        return np.frombuffer(b"".join(data), "<i4").reshape(len(data), dims)
    return np.array([np.pad(np.frombuffer(v, "<i4"), (0, dims - len(v) // 4)) for v in data]).reshape(len(data), dims)


class Tree:
    """Vantage points (augmented) with the radius that halves their rows; leaves are numbered."""

    def __init__(self, sample: np.ndarray, most: int) -> None:
        self.most = float(most)
        self.points: list[np.ndarray] = []
        self.nodes: list[tuple[int, float, int, int]] = []  # vantage point, radius, inner and outer child; a leaf is ~number
        self.paths: list[tuple[int, ...]] = []
        # Distances come from differences of large squares; what rounding may do to them is left open.
        self.slack = 1e-5 * (1 + math.sqrt(self.most))
        self._random = np.random.default_rng(0)
        self._own = self.augmented(sample)
        self.top = self._grow(np.arange(len(sample)), ())
        del self._own

    def augmented(self, vectors: np.ndarray) -> np.ndarray:
        x = vectors.astype(np.float64)
        return np.column_stack([x, np.sqrt(np.maximum(0.0, self.most - np.einsum("ij,ij->i", x, x)))])

    def _grow(self, at: np.ndarray, path: tuple[int, ...]) -> int:
        if len(at) > LEAF_SAMPLE:
            # Of a few candidates the one from which distances differ most.
            tried = [(k, np.linalg.norm(self._own[at] - self._own[k], axis=1)) for k in self._random.choice(at, 8, replace=False)]
            chosen, distance = max(tried, key=lambda c: c[1].std())
            radius = float(np.median(distance))
            inner = distance < radius
            if inner.any() and not inner.all():
                point, node = len(self.points), len(self.nodes)
                self.points.append(self._own[chosen])
                self.nodes.append((point, radius, 0, 0))
                kids = [self._grow(at[side], (*path, point)) for side in (inner, ~inner)]
                self.nodes[node] = (point, radius, *kids)
                return node
        self.paths.append(path)
        return ~(len(self.paths) - 1)

    def leaves(self, vectors: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The leaf of each vector, and its distances from the vantage points on the leaf's path."""
        x = self.augmented(vectors)
        leaf, distances = np.zeros(len(x), np.int64), [np.empty(0)] * len(x)

        def descend(node: int, at: np.ndarray, seen: np.ndarray) -> None:
            if not len(at):
                return
            if node < 0:
                leaf[at] = ~node
                for i, own in zip(at.tolist(), seen):
                    distances[i] = own
                return
            point, radius, inner, outer = self.nodes[node]
            d = np.linalg.norm(x[at] - self.points[point], axis=1)
            seen = np.column_stack([seen, d])
            descend(inner, at[d < radius], seen[d < radius])
            descend(outer, at[d >= radius], seen[d >= radius])

        descend(self.top, np.arange(len(x)), np.empty((len(x), 0)))
        return leaf, distances


class Bounds:
    """How near to and how far from its vantage points the rows of each leaf are; leaves without rows are left out."""

    def __init__(self, tree: Tree, found: list[tuple[int, list[float], list[float]]]) -> None:
        self.tree = tree
        self.leaf = np.array([f[0] for f in found], np.int64)
        depth = max((len(tree.paths[f[0]]) for f in found), default=0)
        pad = lambda values, fill: np.array([[*v, *[fill] * (depth - len(v))] for v in values], np.float64).reshape(len(found), depth)
        self.point = pad([tree.paths[f[0]] for f in found], 0).astype(np.int64)
        self.near, self.far = pad([f[1] for f in found], -np.inf), pad([f[2] for f in found], np.inf)

    def scores(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest score that a row of each leaf may have with each query."""
        q = vectors.astype(np.float64)
        square = np.einsum("ij,ij->i", q, q)[:, None] + self.tree.most
        if not self.tree.points:
            reach = np.sqrt(square - self.tree.most) * math.sqrt(self.tree.most) + 1.0
            return np.repeat(-reach, len(self.leaf), axis=1), np.repeat(reach, len(self.leaf), axis=1)
        points = np.array(self.tree.points)
        d = np.sqrt(np.maximum(0.0, square - 2 * (q @ points[:, :-1].T)))
        own = d[:, self.point]  # query, leaf, depth
        low = np.maximum(own - self.far, self.near - own).max(axis=2).clip(0) - self.tree.slack
        high = (own + self.far).min(axis=2) + self.tree.slack
        return (square - high**2) / 2, (square - low.clip(0) ** 2) / 2


def fit(rows: DataFrame) -> tuple[Tree, int]:
    """The tree over quantised rows, and the length of the longest vector."""
    most, size = rows.agg(F.max("norm"), F.max(F.octet_length("v"))).first()
    dims = (size or 0) // 4
    sample = rows.orderBy(F.xxhash64("vec_id", "label", "v"), "row").limit(SAMPLE).select("v").toArrow()
    return Tree(_matrix(sample.column("v").to_pylist(), dims), most or 0), dims


def index(rows: DataFrame, tree: Tree, dims: int, held: list[str]) -> tuple[DataFrame, DataFrame]:
    """Blocks (leaf, block, ids, labels, rows, v, near, far) of all rows, and (leaf, blocks)."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, distances = tree.leaves(_matrix(batch.column("v").to_pylist(), dims))
            columns = [pa.array(leaf, pa.int64()), pa.array([d.tolist() for d in distances], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "leaf", "d"])

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        d = np.array(table.column("d").to_pylist(), np.float64).reshape(table.num_rows, -1)
        packed = {name: table.column(c).to_numpy().astype("<i8").tobytes() for name, c in (("ids", "vec_id"), ("labels", "label"), ("rows", "row"))}
        packed |= {"v": _matrix(table.column("v").to_pylist(), dims).tobytes(), "near": d.min(axis=0).tolist(), "far": d.max(axis=0).tolist()}
        return pa.Table.from_pylist([{"leaf": table.column("leaf")[0].as_py(), "block": table.column("block")[0].as_py(), **packed}], schema=_BLOCKS)

    own = rows.select("vec_id", "label", "v", "row")
    placed = materialise(own.mapInArrow(place, "vec_id long, label long, v binary, row long, leaf long, d array<double>"), "placed-vectors", held)
    leaves = materialise(placed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "leaves", held)
    dealt = placed.join(sent(leaves), "leaf").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    blocks = dealt.groupBy("leaf", "block").applyInArrow(pack, "leaf long, block int, ids binary, labels binary, rows binary, v binary, near array<double>, far array<double>")
    return materialise(blocks, "vector-blocks", held), leaves


_BLOCKS = pa.schema([("leaf", pa.int64()), ("block", pa.int32()), *((n, pa.binary()) for n in ("ids", "labels", "rows", "v")), *((n, pa.list_(pa.float64())) for n in ("near", "far"))])
_QUERY = "q long, label long, v binary, low array<long>, high array<long>, kth array<long>"


def bounds(blocks: DataFrame, tree: Tree) -> Bounds:
    """What is known of each leaf: a row for each, of which the sample bounds the number."""
    at = blocks.select("leaf", F.posexplode(F.arrays_zip("near", "far")).alias("depth", "b"))
    known = at.groupBy("leaf", "depth").agg(F.min("b.near").alias("near"), F.max("b.far").alias("far"))
    ordered = F.array_sort(F.collect_list(F.struct("depth", "near", "far"))).alias("b")
    found = blocks.select("leaf").distinct().join(known.groupBy("leaf").agg(ordered), "leaf", "left").orderBy("leaf").collect()
    return Bounds(tree, [(r.leaf, [b.near for b in r.b or []], [b.far for b in r.b or []]) for r in found])


def _visits(queries: DataFrame, known: Bounds, dims: int, first: bool) -> DataFrame:
    """Queries with a leaf that they visit: their nearest ones, or the others that the rows found so far don't rule out."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                least, greatest = known.scores(_matrix(part.column("v").to_pylist(), dims))
                low, high, kth = (part.column(c).to_pylist() for c in ("low", "high", "kth"))
                who, where = [], []
                for i in range(part.num_rows):
                    reach = lambda bottom: np.logical_or.reduce([(greatest[i] >= b) & (least[i] <= h) for b, h in zip(bottom, high[i])])  # noqa: E731, B023
                    able = reach(low[i])
                    order = np.argsort(-np.minimum(greatest[i], max(high[i])), kind="stable")
                    order = order[able[order]]
                    if first:
                        order = order[:NEAREST]
                    else:
                        order = order[NEAREST:]
                        order = order[reach([max(x) for x in zip(low[i], kth[i])])[order]]
                    who += [i] * len(order)
                    where += known.leaf[order].tolist()
                taken = part.take(pa.array(who, pa.int64()))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(where, pa.int64())], [*part.schema.names, "leaf"])

    return queries.mapInArrow(choose, f"{_QUERY}, leaf long")


def best(scores: np.ndarray, valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, place) of the k greatest valid scores of each query; of equal ones the first."""
    if scores.shape[1] > k:
        shown = np.where(valid, scores, np.iinfo(np.int64).min)
        valid = valid & (scores >= np.partition(shown, shown.shape[1] - k, axis=1)[:, -k][:, None])
    query, place = np.nonzero(valid)
    order = np.lexsort((place, -scores[query, place], query))
    query, place = query[order], place[order]
    kept = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[kept], place[kept]


_FOUND = pa.schema([("q", pa.int64()), ("w", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64())])


def _scan(visits: DataFrame, blocks: DataFrame, leaves: DataFrame, dims: int, exact: bool, k: int, same: bool, held: list[str]) -> DataFrame:
    """(q, w, score, vec_id, row): the k best rows of each visited block for each window w of a query."""

    def scan(asked: pa.Table, stored: pa.Table) -> pa.Table:
        out = []
        for block in stored.to_pylist() if asked.num_rows else []:
            ids, labels, numbers = (np.frombuffer(block[c], "<i8") for c in ("ids", "labels", "rows"))
            x = np.frombuffer(block["v"], "<i4").reshape(len(ids), dims)
            for at in range(0, asked.num_rows, 256):
                part = asked.slice(at, 256)
                q = _matrix(part.column("v").to_pylist(), dims)
                # Sums below 2**53 are whole in floating point, which multiplies faster.
                scores = (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64) if exact else q.astype(np.int64) @ x.T.astype(np.int64)
                name = part.column("q").to_numpy()
                alike = labels[None, :] == part.column("label").to_numpy()[:, None]
                alike = alike & (numbers[None, :] != name[:, None]) if same else ~alike
                low, high, kth = (part.column(c).to_pylist() for c in ("low", "high", "kth"))
                for w in range(max(map(len, low))):
                    bottom = np.array([max(a[w], b[w]) if w < len(a) else 1 for a, b in zip(low, kth)], np.int64)
                    top = np.array([a[w] if w < len(a) else 0 for a in high], np.int64)
                    i, j = best(scores, alike & (scores >= bottom[:, None]) & (scores <= top[:, None]), k)
                    out.append(pa.table([name[i], np.full(len(i), w, np.int32), scores[i, j], ids[j], numbers[j]], schema=_FOUND))
        return pa.concat_tables(out) if out else _FOUND.empty_table()

    visits = materialise(visits, "visits", held)
    shares = visits.groupBy("leaf").agg(F.ceil(F.count("*") / VISITS).cast("int").alias("shares")).join(leaves, "leaf")
    shares = sent(materialise(shares, "shares", held))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = visits.join(shares, "leaf").withColumn("share", F.pmod(F.xxhash64("q"), F.col("shares")).cast("int")).withColumn("block", each("blocks")).drop("shares", "blocks")
    stored = blocks.join(shares, "leaf").withColumn("share", each("shares")).drop("shares", "blocks", "near", "far")
    key = ["leaf", "block", "share"]
    return asked.groupBy(*key).cogroup(stored.groupBy(*key)).applyInArrow(scan, "q long, w int, score long, vec_id long, row long")


def _first(found: DataFrame, k: int) -> DataFrame:
    """With rank: the k best of each query and window."""
    order = Window.partitionBy("q", "w").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(queries: DataFrame, blocks: DataFrame, leaves: DataFrame, known: Bounds, dims: int, k: int, same: bool, held: list[str]) -> DataFrame:
    """(q, w, score, vec_id, row, rank): the k best rows, of the query's label or of others, in each window.

    ``queries`` are (q, label, v, low, high), with an array element for each window.
    """
    exact = known.tree.most < 1 << 53
    none = F.transform("low", lambda _: F.lit(LEAST).cast("long"))
    queries = materialise(queries.withColumn("kth", none), "queries", held)
    near = materialise(_first(_scan(_visits(queries, known, dims, True), blocks, leaves, dims, exact, k, same, held), k), "near-rows", held)
    last = near.where(F.col("rank") == k).groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("have")).withColumnRenamed("q", "of")
    told = F.transform("low", lambda _, w: F.coalesce(F.try_element_at("have", w.cast("int")), F.lit(LEAST).cast("long")))
    open_ = queries.join(last, F.col("q") == F.col("of"), "left").withColumn("kth", told).drop("of", "have")
    rest = _scan(_visits(open_, known, dims, False), blocks, leaves, dims, exact, k, same, held)
    return materialise(_first(near.drop("rank").unionByName(rest), k), "found-rows", held)


def mine(rows: DataFrame, k: int = 5, positives: int = 5, low: int = 80, high: int = 100, every: int = 100, scale: float = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows (vec_id, embedding, label) whose id ``every`` divides. Of an anchor's ``positives`` best rows of
    its label each asks for the ``k`` best rows of other labels with low * positive_score <= 100 * score <= high *
    positive_score. Components are multiplied by ``scale`` and rounded down, so that scores are whole.
    """
    if not 0 <= low <= 100 or not 0 <= high <= 100:
        raise ValueError("low and high are shares of 100")
    held: list[str] = []
    stored = materialise(quantised(rows, scale), "vectors", held)
    tree, dims = fit(stored)
    blocks, leaves = index(stored, tree, dims, held)
    known = bounds(blocks, tree)
    anchors = stored.where(F.col("vec_id") % every == 0).select(F.col("row").alias("q"), F.col("vec_id").alias("anchor_id"), "label", "v")
    ball = [F.array(F.lit(end).cast("long")).alias(name) for end, name in ((LEAST, "low"), (MOST, "high"))]
    liked = search(anchors.select("q", "label", "v", *ball), blocks, leaves, known, dims, positives, True, held)
    # low * s / 100 upwards and high * s / 100 downwards, without leaving 64 bits
    hundreds, rest = F.floor(F.col("score") / F.lit(100).cast("decimal(3,0)")), F.pmod("score", F.lit(100))
    ends = [(low * hundreds + F.ceil(low * rest / 100)).cast("long").alias("low"), (high * hundreds + F.floor(high * rest / 100)).cast("long").alias("high")]
    windows = liked.select("q", "rank", *ends).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "low", "high"))).alias("windows"))
    asked = anchors.join(windows, "q").select("q", "label", "v", F.col("windows.low").alias("low"), F.col("windows.high").alias("high"))
    unlike = search(asked, blocks, leaves, known, dims, k, False, held)
    chosen = liked.select("q", (F.col("rank") - 1).alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = unlike.select("q", "w", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(chosen, ["q", "w"]).join(anchors.select("q", "anchor_id"), "q")
    out = materialise(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "hard-negatives")
    discard(rows.sparkSession, held)
    return out
