import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, k=5, positives=5, low=80, high=100, every=100, scale=256):
    held = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (anchor, v, label) in enumerate(held):
        if anchor % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, own) for b, (i, w, own) in enumerate(held) if a != b)
        for score, positive, _ in [s for s in scored if s[2] == label][:positives]:
            fit = [(s, i) for s, i, own in scored if own != label and low * -score <= 100 * -s <= high * -score][:k]
            out += [(anchor, positive, rank, i, -score, -s) for rank, (s, i) in enumerate(fit, 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label) for i, v, label in rows], SCHEMA)


def clustered(seed, n=900, dims=6, spread=0.1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    return [(int(i), (centres[rng.integers(12)] + rng.normal(scale=spread, size=dims)).tolist(), int(rng.integers(3))) for i in rng.permutation(n)]


@pytest.mark.parametrize("block, nearest, visits, spread", [(4096, 8, 16_384, 0.1), (7, 1, 3, 0.02), (50, 2, 20, 3.0)])
def test_against_all_pairs(spark, monkeypatch, block, nearest, visits, spread):
    monkeypatch.setattr(negatives, "LEAF_SAMPLE", 8)
    for name, value in (("BLOCK", block), ("NEAREST", nearest), ("VISITS", visits), ("SAMPLE", 300)):
        monkeypatch.setattr(negatives, name, value)
    rows = clustered(block, spread=spread)
    got = sorted(tuple(r) for r in negatives.mine(table(spark, rows), every=30).collect())
    assert got == brute(rows, every=30) and len(got) > 100


def test_far_leaves_are_not_visited(spark, monkeypatch):
    monkeypatch.setattr(negatives, "LEAF_SAMPLE", 8)
    rows = table(spark, clustered(3, spread=0.01))
    held = []
    stored = negatives.materialise(negatives.quantised(rows, 256), "vectors", held)
    tree, dims = negatives.fit(stored)
    blocks, leaves = negatives.index(stored, tree, dims, held)
    assert blocks.agg(F.sum(F.length("ids") / 8)).first()[0] == 900  # every row is indexed
    known = negatives.bounds(blocks, tree)
    queries = stored.where("vec_id % 30 = 0").select(F.col("row").alias("q"), "label", "v", F.array("norm").alias("high"))
    queries = queries.select("*", F.transform("high", lambda s: (s * 0.9).cast("long")).alias("low")).select("q", "label", "v", "low", "high", F.col("low").alias("kth"))
    visits = sum(negatives._visits(queries, known, dims, first).count() for first in (True, False))
    assert 30 <= visits < 0.4 * 30 * len(known.leaf)


def test_ties_and_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(100, [1, 0], 1), (1, [1, 0], 1), (2, [1, 0], 1), (2, [1, 0], 1), (7, [0.9, 5], 2), (6, [0.9, 5], 2), (5, [0.9, -5], 3), (4, [1, 1], 0), (3, [0.8, 0], 0), (11, [0.797, 0], 0), (12, [1.01, 0], 0)]
    rows += [(300, [0.5], 9), (13, [0.25], 9), (400, [-1, 0], 4), (14, [1, 0], 4), (0, [], 5), (15, [], 5), (500, [0, 3], 6), (None, [1, 0], 2), (8, None, 2), (9, [1, 0], None), (10, [1, None], 2), (16, [1, inf], 2), (17, [nan, 1], 2)]
    own = table(spark, rows).withColumns({"row": F.lit("x"), "q": F.lit(0), "leaf": F.lit(None), "norm": F.lit(1)})
    got = sorted(tuple(r) for r in negatives.mine(own).collect())
    assert got == brute(rows) and (100, 2, 1, 4, 65536, 65536) in got
    assert negatives.mine(own.limit(0)).collect() == []
    assert negatives.mine(own.where("vec_id = 100")).collect() == []


def test_scores_beyond_floating_point(spark):
    rows = [(i * 50, [2**30 + 7 * i, 3 * i + 1], i % 2) for i in range(12)] + [(9, [2.0**40, 1.0], 1), (11, [1e300, 0.0], 0)]
    got = sorted(tuple(r) for r in negatives.mine(table(spark, rows), scale=1).collect())
    assert got == brute(rows[:12], scale=1) and got[0][4] > 2**53


def test_one_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 64)
    monkeypatch.setattr(negatives, "VISITS", 10)
    rows = [(i, [0.5, 0.5], i % 4) for i in range(1500)] + [(i, [0.1 * (i % 7), 0.3], i % 4) for i in range(1500, 1700)]
    assert sorted(tuple(r) for r in negatives.mine(table(spark, rows), every=100).collect()) == brute(rows, every=100)


def test_best_keeps_the_first_of_equals():
    scores = np.array([[3, 9, 9, 9, 1], [5, 4, 3, 2, 1]])
    valid = np.array([[True, True, True, True, True], [False, False, False, True, False]])
    query, place = negatives.best(scores, valid, 2)
    assert (query.tolist(), place.tolist()) == ([0, 0, 1], [1, 2, 3])
