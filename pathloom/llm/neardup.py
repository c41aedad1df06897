"""Near-duplicate documents by bottom-k sketches of one hash function.

Each document's set of word shingles is hashed once; the ``SKETCH`` least hash
values are its sketch. Documents with equal sets are one class; a class is a node
with a number of its own, and only one row of it goes on.

*Inverted lists.* Two sets with similarity of at least 0.8 share, but for a
chance below 1e-9 for a pair exactly at the threshold, at least ``need(n)``
values of their sketches (surely, where the sets fit into the sketch). Values
that one representative alone has are dropped. The others are sorted by how many
lists' members they have, and a document enters the lists of its rarest
``m - need + 1`` of ``m`` values: of the values that a pair shares, the rarest
must be among these for both. A document with fewer than ``need`` shared values
enters none, so boilerplate alone rarely makes a candidate.

*Families.* Each list hangs its members on its least one; the connected families
of that graph hold every pair that shares a list, at one row per list entry. The
text of family members is read again for their full sets, and one task takes a
family: the sketches' overlaps, counted from their inverted lists, and the
*estimate* from the least values of the union of two sketches rule pairs out for
which similarity 0.8 has a chance below 1e-9; then pairs of different components
are *verified* on the full sets, most alike first.

*Large families* (over ``FAMILY`` members or ``FAMILY_SHINGLES`` shingles), which a
hot text and its near copies make, never meet in one task. Members of short lists
are compared with each other, members of longer lists with the list's least
member, and the links' components are found. What then stands outside the
family's largest component is compared with all members, in blocks of bounded
size, and a task passes on only links that join components: no more than it has
members, however many pairs are alike.

Defined results: null, empty and word-less texts have no shingles and are linked
with nothing; fewer words than a shingle make one shingle of the whole sequence;
rows that repeat an id are each judged by their own text, and link nothing through
the id; a row whose id is null is a component of its own (component_id null, kept).
Ids may be of any type with an order. Extra columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh3_128_digest

from pathloom.llm.common import batched, discard, materialise, rows, sent, window_hashes, word_hashes, words
from pathloom.llm.components import components

SKETCH = 96
#: The least x with P(Binomial(SKETCH, 0.8) <= x) >= 1e-9: what a sample of the union must hold in common.
SAMPLE_NEED = 51
SHORT_LIST = 64
FAMILY = 1000
FAMILY_SHINGLES = 6_000_000
OUTSIDE_BLOCK, BLOCK = 256, 512


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted as signed 64-bit integers."""
    return np.unique(window_hashes(word_hashes(words(text)), width).view(np.int64))


def _chosen(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text).cast("string").alias("text"))


def sketches(docs: DataFrame, width: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class, sketch): class is a fingerprint of the whole set."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingle_set(passage, width) for passage in part.column(1).to_pylist()]
                marks = [xxh3_128_digest(own.tobytes()) if len(own) else None for own in sets]
                cuts = np.cumsum([0, *(min(len(own), SKETCH) for own in sets)])
                least = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate([own[:SKETCH] for own in sets])))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(own) for own in sets], pa.int64()), pa.array(marks, pa.binary()), least], ["doc_id", "n_shingles", "class", "sketch"])

    own = _chosen(docs, id_column, text)
    return own.mapInArrow(make, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_shingles long, class binary, sketch array<long>")


def need(n: Column) -> Column:
    """How many sketch values a document of n shingles shares with any partner of similarity 0.8 or more."""
    surely = F.lit(SKETCH) - F.floor(n / 4)
    return F.when(n <= SKETCH, F.least(F.ceil(n * 8 / 10), surely)).otherwise(F.greatest(F.lit(SAMPLE_NEED), surely)).cast("int")


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sketches leave similarity 0.8 possible."""
    common = np.intersect1d(a, b, assume_unique=True)
    if len(a) < SKETCH and len(b) < SKETCH:  # whole sets, and so is their union, whatever its size
        return len(common) * 5 >= 4 * (len(a) + len(b) - len(common))
    union = np.union1d(a, b)[:SKETCH]
    shared = int(np.searchsorted(common, union[-1], "right"))
    return shared >= SAMPLE_NEED * len(union) // SKETCH


def _needs(size: np.ndarray) -> np.ndarray:
    surely = SKETCH - size // 4
    return np.where(size <= SKETCH, np.minimum(-(-size * 8 // 10), surely), np.maximum(SAMPLE_NEED, surely))


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= 80 * (len(a) + len(b) - common)


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values the sets have in common, from the inverted lists of the values."""
    out = np.zeros((len(left), len(right)), np.int32)
    value = np.concatenate([*left, *right])
    member = np.concatenate([np.repeat(np.arange(len(left)), [len(s) for s in left]), np.repeat(np.arange(len(right)), [len(s) for s in right]) + len(left)])
    order = np.argsort(value, kind="stable")
    value, member = value[order], member[order]
    edges = np.flatnonzero(np.diff(value)) + 1
    starts, ends = np.append(0, edges), np.append(edges, len(value))
    for a, b in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
        cut = a + np.searchsorted(member[a:b], len(left))
        if a < cut < b:
            out[np.ix_(member[a:cut], member[cut:b] - len(left))] += 1
    return out


def _links(sets: list[np.ndarray], others: list[np.ndarray], names: list, other_names: list) -> list[tuple[int, int]]:
    """Verified pairs (place in ``sets``, place in ``others``) that join components; names are components so far."""
    size, other_size = np.array([len(s) for s in sets]), np.array([len(s) for s in others])
    overlap = _overlaps([s[:SKETCH] for s in sets], [s[:SKETCH] for s in others])
    possible = overlap >= np.maximum(_needs(size)[:, None], _needs(other_size)[None, :])
    possible &= (size[:, None] * 5 >= other_size[None, :] * 4) & (other_size[None, :] * 5 >= size[:, None] * 4)
    x, y = np.nonzero(possible)
    order = np.argsort(-overlap[x, y], kind="stable")
    parent: dict = {}

    def root(c):
        while parent.setdefault(c, c) != c:
            parent[c] = c = parent[parent[c]]
        return c

    out = []
    for i, j in zip(x[order].tolist(), y[order].tolist()):
        a, b = root(names[i]), root(other_names[j])
        if a != b and _alike(sets[i][:SKETCH], others[j][:SKETCH]) and _similar(sets[i], others[j]):
            parent[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def _set_of(data: pa.Scalar) -> np.ndarray:
    return np.frombuffer(data.as_buffer(), np.int64)


def _family_links(table: pa.Table) -> pa.Table:
    """Links that join what is alike in one small family."""
    nodes = table.column("node").to_pylist()
    sets = [_set_of(s) for s in table.column("shingles")]
    found = _links(sets, sets, nodes, nodes)
    return pa.table({"a": pa.array([nodes[i] for i, _ in found], pa.int64()), "b": pa.array([nodes[j] for _, j in found], pa.int64())})


def _block_links(table: pa.Table) -> pa.Table:
    """Links between members outside a family's largest component and a block of its members."""
    outside = table.filter(pa.compute.field("outside"))
    inside = table.filter(~pa.compute.field("outside"))
    nodes, others = outside.column("node").to_pylist(), inside.column("node").to_pylist()
    found = []
    if nodes and others:
        found = _links([_set_of(s) for s in outside.column("shingles")], [_set_of(s) for s in inside.column("shingles")], outside.column("component").to_pylist(), inside.column("component").to_pylist())
    return pa.table({"a": pa.array([nodes[i] for i, _ in found], pa.int64()), "b": pa.array([others[j] for _, j in found], pa.int64())})


def _sets(docs: DataFrame, members: DataFrame, width: int, id_column: str, text: str) -> DataFrame:
    """(family, node, shingles) of the members (family, node, rep, class), made again from their texts; by family."""
    schema = pa.schema([("family", pa.int64()), ("node", pa.int64()), ("shingles", pa.binary())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        done: set[int] = set()  # rows may be repeated; a task tells each member once
        for family, node, own, passage in rows(batches, "family", "node", "class", "text"):
            if node not in done:
                data = shingle_set(passage, width).tobytes()
                if xxh3_128_digest(data) == own:  # another text under the same id is another class
                    done.add(node)
                    yield family, node, data

    chosen = _chosen(docs, id_column, text)
    some = chosen.join(sent(members), chosen["doc_id"] == members["rep"]).select("family", "node", "class", "text")
    found = some.mapInArrow(lambda it: batched(make(it), schema, 512), "family long, node long, shingles binary")
    return found.repartition("family").dropDuplicates(["family", "node"])


def _pairs_by(test, pairs: DataFrame, sets: DataFrame, column) -> DataFrame:
    """The pairs (a, b) whose values of ``column`` pass ``test``."""
    left = sets.select(F.col("node").alias("a"), column.alias("sa"))
    right = sets.select(F.col("node").alias("b"), column.alias("sb"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [test(_set_of(x), _set_of(y)) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(judge, "a long, b long").distinct()


def _large_families(lists: DataFrame, members: DataFrame, sets: DataFrame, held: list[str]) -> DataFrame:
    """Links that join what is alike in families (family, node) that no one task may hold."""
    own = lists.join(members.select(F.col("node").alias("m")), F.col("node") == F.col("m"), "left_semi")
    short = own.where(F.col("df") <= SHORT_LIST)
    pairs = short.alias("x").join(short.alias("y"), (F.col("x.v") == F.col("y.v")) & (F.col("x.node") > F.col("y.node")))
    pairs = pairs.where("x.n * 5 >= y.n * 4 and y.n * 5 >= x.n * 4").select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    long = own.where(F.col("df") > SHORT_LIST)
    pivots = long.groupBy("v").agg(F.min("node").alias("b"))
    pairs = pairs.union(long.join(pivots, "v").where("node > b").select(F.col("node").alias("a"), "b")).distinct()
    likely = materialise(_pairs_by(_alike, pairs, sets, F.substring("shingles", 1, 8 * SKETCH)), "candidates", held)
    links = materialise(_pairs_by(_similar, likely, sets, F.col("shingles")), "verified", held)
    labels = components(links, held)

    placed = members.select("family", "node").join(labels.withColumnRenamed("node", "labelled"), F.col("node") == F.col("labelled"), "left")
    placed = materialise(placed.select("family", "node", F.coalesce("component", "node").alias("component")), "placed", held)
    most = placed.groupBy("family", "component").count().groupBy("family").agg(F.max_by("component", F.struct("count", "component")).alias("home"), F.sum("count").alias("n"), F.max("count").alias("at_home"))
    most = most.withColumns({"outer": F.ceil((F.col("n") - F.col("at_home")) / OUTSIDE_BLOCK).cast("int"), "inner": F.ceil(F.col("n") / BLOCK).cast("int")}).where("outer > 0")
    dealt = placed.join(most, "family").join(sets.select(F.col("node").alias("sd"), "shingles"), F.col("node") == F.col("sd"))
    number = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = ["node", "component", "shingles"]
    outside = dealt.where("component <> home").select("family", number("outer").alias("i"), each("inner").alias("j"), *rest, F.lit(True).alias("outside"))
    inside = dealt.select("family", each("outer").alias("i"), number("inner").alias("j"), *rest, F.lit(False).alias("outside"))
    found = outside.union(inside).groupBy("family", "i", "j").applyInArrow(_block_links, "a long, b long")
    return links.union(materialise(found, "links-of-blocks", held))


def near_duplicates(docs: DataFrame, width: int = 5, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    held: list[str] = []
    features = materialise(sketches(docs, width, id_column, text).withColumn("row", F.monotonically_increasing_id()), "sketches", held)
    # A node for each class, and one row that stands for it: of its rows with the least id the first.
    known = features.where("class is not null and doc_id is not null")
    classes = known.groupBy("class").agg(F.min(F.struct("doc_id", "row")).alias("rep"), F.count("*").alias("copies"))
    classes = classes.select("class", F.col("rep.doc_id").alias("rep"), F.col("rep.row").alias("first"), "copies", F.monotonically_increasing_id().alias("node"))
    classes = materialise(classes, "classes", held)
    reps = features.select("row", "n_shingles", "sketch").join(sent(classes.select("first", "node")), F.col("row") == F.col("first"))

    values = reps.select("node", F.col("n_shingles").alias("n"), F.explode("sketch").alias("v"))
    common = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    shared = values.join(common, "v").groupBy("node", "n").agg(F.array_sort(F.collect_set(F.struct("df", "v"))).alias("s"))
    shared = shared.withColumn("need", need(F.col("n"))).where("size(s) >= need")
    lists = shared.select("node", "n", F.explode(F.slice("s", F.lit(1), F.size("s") - F.col("need") + 1)).alias("e"))
    lists = materialise(lists.select("node", "n", "e.v", "e.df"), "lists", held)

    heads = lists.groupBy("v").agg(F.min("node").alias("b"), F.count("*").alias("members")).where("members > 1").select("v", "b")
    families = components(lists.join(heads, "v").select(F.col("node").alias("a"), "b"), held)
    named = families.select(F.col("component").alias("family"), F.col("node").alias("member")).join(classes, F.col("member") == F.col("node"))
    sizes = lists.select(F.col("node").alias("d"), "n").distinct()
    sizes = named.join(sizes, F.col("node") == F.col("d")).groupBy("family").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    sizes = sizes.select(F.col("family").alias("f"), ((F.col("members") > FAMILY) | (F.col("shingles") > FAMILY_SHINGLES)).alias("large"))
    members = materialise(named.join(sizes, F.col("family") == F.col("f")).select("family", "node", "rep", "class", "large"), "members", held)

    small, large = members.where("not large"), members.where("large")
    links = materialise(_sets(docs, small, width, id_column, text).groupBy("family").applyInArrow(_family_links, "a long, b long"), "links-of-families", held)
    if not large.isEmpty():
        sets = materialise(_sets(docs, large, width, id_column, text), "sets", held)
        links = links.union(_large_families(lists, large, sets, held))

    # The least id of what is reachable, for classes that are linked or have copies; the others' is their own.
    labels = classes.select("class", "rep", "copies", "node").join(components(links, held).withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left")
    labels = materialise(labels.where("copies > 1 or component is not null").select(F.col("class").alias("__class"), "rep", "component"), "labels", held)
    least = labels.where("component is not null").groupBy("component").agg(F.min("rep").alias("least")).withColumnRenamed("component", "c")
    least = materialise(labels.join(least, F.col("component") == F.col("c"), "left").select("__class", F.coalesce("least", "rep").alias("component_id")), "least", held)
    out = features.select("doc_id", "n_shingles", "class").join(sent(least), F.col("class") == F.col("__class"), "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    out = materialise(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "near-duplicates")
    discard(docs.sparkSession, held)
    return out
