import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pathloom.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves, fan):
    """(root, for each leaf its siblings by level: before, after)."""
    proofs, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for leaf, place in enumerate(at):
            run = place - place % fan
            proofs[leaf].append(("".join(level[run:place]), "".join(level[place + 1 : run + fan])))
        at = [place // fan for place in at]
        level = [digest("".join(level[i : i + fan])) for i in range(0, len(level), fan)]
    return level[0], proofs


def brute(rows, fan=2, changed=lambda row: row):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda lang: (lang is not None, (lang or "").encode()))
    ordered = {n: sorted(groups[n], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for n in names}
    trees = {n: tree([leaf_of(r) for r in ordered[n]], fan) for n in names}
    root, above = tree([trees[n][0] for n in names], fan)
    out = []
    for n, over in zip(names, above):
        for row, own in zip(ordered[n], trees[n][1]):
            proof, folded = own + over, leaf_of(changed(row))
            for before, after in proof:
                folded = digest(before + folded + after)
            out.append((row[0], leaf_of(row), trees[n][0], root, digest("".join(b + a for b, a in proof)), folded, folded == root))
    return sorted(out, key=str)


def got(table, **options):
    found = merkle.verify(table, **options).select("doc_id", "leaf", "subroot", "root", merkle.proof_hash(F.col("proof")), "folded_root", "verified")
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize("fan, n", [(2, 1), (2, 2), (2, 77), (3, 100), (5, 26)])
def test_against_plain_trees(spark, fan, n):
    rng = random.Random(n)
    rows = [(i * 3, rng.choice(["a", None]), rng.choice(["de", "en", "en", "en", None, "ü"]), rng.randrange(99), f"text {i} é") for i in range(n)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, SCHEMA)
    longer = {"n_chars": F.when(F.col("doc_id") % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    want = brute(rows, fan, lambda r: (*r[:3], r[3] + (r[0] % 7 == 0), r[4]))
    assert got(table, changed=longer, fan=fan) == want
    assert {r[0] for r in want if not r[-1]} == {r[0] for r in rows if r[0] % 7 == 0}
    assert all(r[-1] for r in got(table, fan=fan))


def test_odd_rows(spark):
    long_text = "word " * 400_000
    rows = [(None,) * 5, (None, "s", None, 1, "x"), (5, "", "en", None, ""), (5, "", "en", None, ""), (5, "", "en", 3, None), (-2, "s", "en", 2**63 - 1, long_text)]
    table = spark.createDataFrame(rows, SCHEMA).withColumns({"tree": F.lit("x"), "place": F.lit(1), "hash": F.lit(None), "run": F.lit(0)})
    longer = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}  # beyond 64 bits for the last row
    more = lambda r: (*r[:3], None if r[3] is None else r[3] + 1, r[4])
    assert got(table, changed=longer) == brute(rows, changed=more)
    assert got(table.limit(0)) == []
    only = spark.createDataFrame(rows[:1], SCHEMA)
    assert got(only) == brute(rows[:1]) and got(only)[0][1] == got(only)[0][3]
