"""A Merkle manifest of a dataset: one hash tree for each language, and a tree over their roots.

*Build, bottom-up.* A row's leaf is the hash of its fields, each told apart by its
length. The leaves of a tree are numbered in order (``scratch.numbered``: ranges,
no single sort), and level by level each run of ``fan`` consecutive nodes becomes
their hash: a run's key is its tree and the place divided by ``fan``, so runs of
one large tree spread over all tasks and a group never holds more than ``fan``
rows. Every level is a table in the shared scratch folder, and the roots of the
trees, in order, are the leaves of one more tree.

*Proofs, top-down.* The root has the empty proof. Each level's nodes join what
their parents hand down; a child puts its own siblings (those before it and those
after it in its run) before the proof that its parent has. A tree over n leaves
takes about log(n) rounds either way, and what a round moves shrinks with its level.

*Check.* Folding a leaf with its proof, level by level, must give the root;
``verify`` folds the leaves of changed rows with the siblings of the original ones.

Defined results: a null field is hashed as ``-``; a null language is a tree of its
own, before the others; null ids come first in their tree, and rows that repeat an
id are ordered by their leaves (equal rows have places of their own); a tree of one
leaf is that leaf; an empty table has no rows. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pathloom.llm.common import discard, materialise, sent
from pathloom.scratch import numbered

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that are joined before the proofs so far are written.
LEVELS_A_WRITE = 6
#: For each level the siblings before and after, as raw digests.
PROOF = "array<struct<before: binary, after: binary>>"


def field(value: Column) -> Column:
    """``-`` for null; else the number of UTF-8 bytes, a colon, and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_hash(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def _digests(hashes: Column) -> Column:
    return F.unhex(F.array_join(hashes, ""))


def _text(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def build(leaves: DataFrame, fan: int, held: list[str]) -> list[DataFrame]:
    """The levels above ``leaves`` (tree, place from 0, size of the tree, hash): tables of runs (tree, place, size of
    the level, run: the hashes below it in order, hash). A level has the trees that are not yet at their root."""
    most, levels, now = leaves.agg(F.max("size")).first()[0] or 0, [], leaves
    while most > 1:
        key = [F.floor(F.col(c) / fan).alias(a) for c, a in (("place", "place"), ("up", "size"))]
        runs = now.where("size > 1").withColumn("up", F.col("size") + fan - 1).groupBy("tree", *key)
        ordered = F.array_sort(F.collect_list(F.struct("place", "hash")))
        run = runs.agg(F.transform(ordered, lambda node: node["hash"]).alias("run"))
        now = materialise(run.withColumn("hash", F.sha2(F.array_join("run", ""), 256)), "merkle-level", held)
        levels.append(now)
        most = -(-most // fan)
    return levels


def roots(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(tree, hash) of the root of each tree."""
    out = leaves.where("size = 1").select("tree", "hash")
    for level in levels:
        out = out.unionByName(level.where("size = 1").select("tree", "hash"))
    return out


def push(leaves: DataFrame, levels: list[DataFrame], inherited: DataFrame, fan: int, held: list[str]) -> DataFrame:
    """(tree, place, proof) of ``leaves``; ``inherited`` (tree, proof) is what each tree's root begins with."""
    handed = None  # (tree, place, proof) for the nodes of the level at hand
    for at in range(len(levels) - 1, -1, -1):
        now = levels[at].where("size = 1").join(inherited, "tree").select("tree", "place", "run", "proof")
        if handed is not None:
            now = now.unionByName(levels[at].where("size > 1").join(handed, ["tree", "place"]).select("tree", "place", "run", "proof"))
        child = now.select("tree", "place", "run", "proof", F.explode(F.sequence(F.lit(0), F.size("run") - 1)).alias("at"))
        siblings = F.struct(
            _digests(F.slice("run", F.lit(1), F.col("at"))).alias("before"), _digests(F.slice("run", F.col("at") + 2, F.lit(fan))).alias("after")
        )
        handed = child.select("tree", (F.col("place") * fan + F.col("at")).alias("place"), F.concat(F.array(siblings), "proof").cast(PROOF).alias("proof"))
        if at % LEVELS_A_WRITE == 0:
            handed = materialise(handed, "merkle-proofs", held)
    alone = leaves.where("size = 1").join(inherited, "tree").select("tree", "place", "proof")
    return alone if handed is None else alone.unionByName(handed)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings make."""
    return F.aggregate(proof, leaf, lambda own, step: F.sha2(F.concat(_text(step["before"]), own, _text(step["after"])), 256))


def verify(
    docs: DataFrame, changed: dict[str, Column] | None = None, fan: int = 2, fields: tuple[str, ...] = FIELDS, id_column: str = "doc_id", group: str = "lang"
) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, folded_root, verified) of each row.

    ``changed`` gives what the fields are when the rows are checked against the manifest of ``docs``.
    """
    held: list[str] = []
    claimed = [(changed or {}).get(f, F.col(f)) for f in fields]
    # The texts are read once; from here on a row is its id, its language and two hashes.
    hashed = docs.select(F.col(id_column).alias("doc_id"), F.col(group).alias("group"), leaf_hash([F.col(f) for f in fields]).alias("hash"), leaf_hash(claimed).alias("claimed"))
    hashed = materialise(hashed.withColumn("row", F.monotonically_increasing_id()), "merkle-leaves", held)
    placed = numbered(hashed, "n", "group", "doc_id", "hash", "row", start=0)
    groups = numbered(placed.groupBy("group").agg(F.min("n").alias("first"), F.count("*").alias("size")), "tree", "group", start=0)
    groups = sent(groups.select(F.col("group").alias("g"), "first", "size", "tree"))
    leaves = placed.join(groups, F.col("group").eqNullSafe(F.col("g"))).select("tree", (F.col("n") - F.col("first")).alias("place"), "size", "hash", "doc_id", "claimed")
    leaves = materialise(leaves, "merkle-placed", held)

    levels = build(leaves, fan, held)
    subroots = materialise(roots(leaves, levels), "merkle-roots", held)
    over = subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("place"), F.lit(subroots.count()).alias("size"), "hash")
    top = build(over, fan, held)
    root = (roots(over, top).first() or [None, None])[1]
    empty = F.array().cast(PROOF)
    start = docs.sparkSession.range(1).select(F.lit(0).alias("tree"), empty.alias("proof"))
    inherited = push(over, top, start, fan, held).select(F.col("place").alias("tree"), "proof")
    inherited = materialise(inherited.join(subroots.withColumnRenamed("hash", "subroot"), "tree"), "merkle-trees", held)
    proofs = push(leaves, levels, inherited.select("tree", "proof"), fan, held)

    out = leaves.join(proofs, ["tree", "place"]).join(sent(inherited.select("tree", "subroot")), "tree")
    out = out.select("doc_id", F.col("hash").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), "proof", fold(F.col("claimed"), F.col("proof")).alias("folded_root"))
    out = materialise(out.withColumn("verified", F.col("folded_root") == F.col("root")), "merkle-manifest")
    discard(docs.sparkSession, held)
    return out


def proof_hash(proof: Column) -> Column:
    """The hash of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: _text(F.concat(step["before"], step["after"]))), ""), 256)
