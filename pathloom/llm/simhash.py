"""Near duplicates by SimHash fingerprints, found through an inverted index of byte positions.

*Fingerprints.* Of each word shingle's 64-bit hash, repeats included, a bit is
counted up; the fingerprint has the bits that over half of the hashes have.
Documents with equal fingerprints are one node, so copies cost one row each.

*Index.* Two fingerprints that differ in at most ``distance`` bits differ in at
most as many bytes, so of their ``BYTES`` positional bytes at least ``need = BYTES
- distance`` are equal. A list holds the fingerprints with the same bytes at
``depth`` positions; of the ``need`` equal bytes of a pair at least ``depth`` lie
in the first ``BYTES - need + depth`` positions, so lists over these positions
find every pair. Single bytes (depth 1) would make 2,048 lists in all; at depth 3
a list of evenly spread fingerprints holds one in 16 million.

*Count filter.* Within a list each pair's shared positional bytes are tallied;
only pairs that reach ``need`` go on, and are *verified* by their differing bits.
A list is sorted and compared with itself shifted by 1, 2, 3, ... places, so all
of a task's lists are compared at once. Of the verified pairs only those that join
what is not yet joined leave the task: fewer than the list has members.

*Long lists*, which near copies of one text make, never meet in one task: first
parts of them, at most about ``PART`` members each and dealt differently in each
list, are compared as lists of their own, and the links' components are found.
What then lies outside the largest component of a list is compared with all of
its members, in blocks. All pairs within the distance are so either compared or
already joined.

Defined results: null, empty and word-less texts have fingerprint zero and are
linked like any other; fewer words than a shingle make one shingle; rows that
repeat an id have a fingerprint each, and nothing is linked through the id; a row
whose id is null is linked, but names no component (if no other id is reachable,
component_id is null). Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from pathloom.llm.common import batched, discard, materialise, rows, sent, words
from pathloom.llm.components import components

BYTES = 8
SEED = 42
PART = 4096
BLOCK = 2048
SHINGLES_AT_ONCE = 65_536


def shingle_hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """The hashes of all shingles, repeats included, some at a time."""
    tokens = words(text)
    width = min(width, len(tokens))
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.append(0, ends[:-1] + 1)
    for at in range(0, len(tokens) - width + 1 if tokens else 0, SHINGLES_AT_ONCE):
        to = min(at + SHINGLES_AT_ONCE, len(tokens) - width + 1)
        cuts = zip(starts[at:to].tolist(), ends[at + width - 1 : to + width - 1].tolist())
        yield np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in cuts), np.uint64, to - at)


def fingerprint(text: str | None, width: int) -> int:
    """As a signed 64-bit integer."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, width):
        counts += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, BYTES), axis=1).sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * counts > n).view(">i8")[0])


def fingerprints(docs: DataFrame, width: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp)."""
    own = docs.select(F.col(id_column).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [fingerprint(passage, width) for passage in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return own.mapInArrow(make, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, fp long")


def postings(nodes: DataFrame, distance: int, depth: int) -> DataFrame:
    """(key, fp): the lists that each fingerprint of ``nodes`` (fp) stands in. A key has the positions and their bytes."""
    indexed = range(distance + depth)  # BYTES - need + depth of them
    keys = []
    for number, chosen in enumerate(combinations(indexed, depth)):
        mask = sum(0xFF << 8 * p for p in chosen)
        keys.append(F.struct(F.lit(number).cast("short").alias("at"), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("bytes")))
    return nodes.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.at", "k.bytes", "fp")


def _root(parent: list[int] | dict, x: int) -> int:
    while parent[x] != x:
        parent[x] = x = parent[parent[x]]
    return x


def matching(x: np.ndarray, y: np.ndarray, distance: int) -> np.ndarray:
    """Whether pairs share enough positional bytes, and then differ in few enough bits."""
    differing = (x ^ y).view(np.uint64)
    tally = (differing.view(np.uint8).reshape(*differing.shape, BYTES) == 0).sum(axis=-1)
    near = tally >= BYTES - distance
    near[near] = np.bitwise_count(differing[near]) <= distance
    return near


def list_links(fp: np.ndarray, lists: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Verified pairs that join what is alike; equal numbers of ``lists`` stand together and are a list each."""
    parent, own, found = list(range(len(fp))), np.arange(len(fp)), []
    at, shift = own, 1
    while len(at := at[at + shift < len(fp)]) and len(at := at[lists[at] == lists[at + shift]]):
        open_ = at[own[at] != own[at + shift]]  # not joined yet
        hit = open_[matching(fp[open_], fp[open_ + shift], distance)]
        for i in hit.tolist():
            a, b = _root(parent, i), _root(parent, i + shift)
            if a != b:
                parent[max(a, b)] = min(a, b)
                found.append((int(fp[i]), int(fp[i + shift])))
        if len(hit):
            own = np.array(parent)
            while (own[own] != own).any():
                own = own[own]
        shift += 1
    return found


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _links_of_parts(parts: DataFrame, distance: int) -> DataFrame:
    """Links within parts (at, bytes, part, fp) of lists, which stand together in sorted tasks."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()
        held: list[np.ndarray] = []

        def emit(table: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(table) > 1:
                number = np.cumsum(np.append(0, (table[1:, :3] != table[:-1, :3]).any(axis=1)))
                new = [pair for pair in dict.fromkeys(list_links(table[:, 3].copy(), number, distance)) if pair not in done]
                if len(done) < 500_000:
                    done.update(new)
                yield from batched(iter(new), LINKS)

        for batch in batches:
            table = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)])
            if len(table):
                held.append(table)
            if sum(map(len, held)) >= 50_000:  # what follows the last whole part waits
                table = np.concatenate(held)
                last = int(np.argmax((table[:, :3] == table[-1, :3]).all(axis=1)))
                yield from emit(table[:last])
                held = [table[last:]]
        if held:
            yield from emit(np.concatenate(held))

    return parts.mapInArrow(compare, "a long, b long")


def _block_links(table: pa.Table, distance: int) -> pa.Table:
    """Links between a block of members outside a list's largest component and a block of all its members."""
    outside = np.array(table.column("outside").to_pylist(), bool)
    fp, name = table.column("fp").to_numpy(), table.column("component").to_numpy()
    parent, found = {c: c for c in name.tolist()}, []
    others, names = fp[~outside], name[~outside]
    for x, own in zip(fp[outside].tolist(), name[outside].tolist()):
        hit = np.flatnonzero(matching(np.full(len(others), x), others, distance))
        near, first = np.unique(names[hit], return_index=True)  # one pair joins two components
        for other, j in zip(near.tolist(), hit[first].tolist()):
            a, b = _root(parent, own), _root(parent, other)
            if a != b:
                parent[max(a, b)] = min(a, b)
                found.append((x, int(others[j])))
    return pa.Table.from_pylist([{"a": a, "b": b} for a, b in found], schema=LINKS)


def links(nodes: DataFrame, distance: int, depth: int, held: list[str]) -> DataFrame:
    """Pairs (a, b) of fingerprints within the distance, enough to join all that is joined by such pairs."""
    posted = materialise(postings(nodes, distance, depth), "postings", held)
    sizes = posted.groupBy("at", "bytes").agg(F.count("*").alias("n")).where("n > 1")
    lists = materialise(sizes.withColumn("parts", F.ceil(F.col("n") / PART).cast("int")), "lists", held)
    key = ["at", "bytes"]
    own = posted.join(lists, key)
    part = F.when(F.col("parts") == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("fp", *key), F.col("parts"))).alias("part")
    parts = own.select(*key, part, "fp").repartition(*key, "part").sortWithinPartitions(*key, "part", "fp")
    found = materialise(_links_of_parts(parts, distance).distinct(), "links-of-parts", held)

    long = lists.where("parts > 1")
    if long.isEmpty():
        return found
    labels = components(found, held)
    members = posted.join(sent(long), key).join(labels.withColumnRenamed("node", "labelled"), F.col("fp") == F.col("labelled"), "left")
    members = materialise(members.select(*key, "n", "fp", F.coalesce("component", "fp").alias("component")), "members", held)
    most = members.groupBy(*key, "n", "component").count().groupBy(*key, "n").agg(F.max_by("component", F.struct("count", "component")).alias("home"), F.max("count").alias("at_home"))
    blocks = most.withColumns({"outer": F.ceil((F.col("n") - F.col("at_home")) / BLOCK).cast("int"), "inner": F.ceil(F.col("n") / BLOCK).cast("int")}).where("outer > 0").drop("n")
    dealt = members.join(sent(blocks), key)
    number = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = ["fp", "component"]
    outside = dealt.where("component <> home").select(*key, number("outer").alias("i"), each("inner").alias("j"), *rest, F.lit(True).alias("outside"))
    inside = dealt.select(*key, each("outer").alias("i"), number("inner").alias("j"), *rest, F.lit(False).alias("outside"))
    crossed = outside.union(inside).groupBy(*key, "i", "j").applyInArrow(lambda table: _block_links(table, distance), "a long, b long")
    return found.union(materialise(crossed, "links-of-blocks", held))


def near_duplicates(docs: DataFrame, width: int = 5, distance: int = 4, depth: int = 3, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id (the least id reachable)."""
    if not 0 <= distance < BYTES or not 1 <= depth <= BYTES - distance:
        raise ValueError("a pair must share depth bytes: 1 <= depth <= 8 - distance")
    held: list[str] = []
    features = materialise(fingerprints(docs, width, id_column, text), "fingerprints", held)
    nodes = materialise(features.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "nodes", held)
    labels = nodes.join(components(links(nodes.select("fp"), distance, depth, held), held).withColumnRenamed("node", "linked"), F.col("fp") == F.col("linked"), "left")
    labels = materialise(labels.where("copies > 1 or component is not null").select(F.col("fp").alias("own"), "rep", F.coalesce("component", "fp").alias("component")), "labels", held)
    least = labels.groupBy("component").agg(F.min("rep").alias("least")).withColumnRenamed("component", "c")
    named = materialise(labels.join(least, F.col("component") == F.col("c")).select("own", "least"), "named", held)
    out = features.join(sent(named), F.col("fp") == F.col("own"), "left")
    out = out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.coalesce("least", "doc_id").alias("component_id"))
    out = materialise(out, "simhash")
    discard(docs.sparkSession, held)
    return out
