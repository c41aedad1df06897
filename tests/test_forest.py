import random

import pytest
from pyspark.sql import functions as F

from pathloom import scratch
from pathloom.operators import forest, graphs

SCHEMA = "entry long, tree long, node long, parent long, sym string"


def plain(rows):
    """(entry, tree, node) -> (labels up to the root, preorder place, nodes and leaves of the subtree)."""
    kids, by = {}, {r[:3]: r for r in rows}
    for e, t, n, p, _ in sorted(rows):
        kids.setdefault((e, t, p), []).append((e, t, n))
    out = {}
    for root in [k for key, ks in kids.items() if key[2] is None for k in ks]:
        open_, at = [root], {}
        while open_:
            key = open_.pop()
            e, t, _, p, sym = by[key]
            at[key] = len(at)
            out[key] = [(sym, *(out[e, t, p][0] if p is not None else ())), at[key], 1, int(key not in kids)]
            open_ += reversed(kids.get(key, []))
        for key in reversed(at):
            if (p := by[key][3]) is not None:
                for k in (2, 3):
                    out[(*key[:2], p)][k] += out[key][k]
    return out


def trees(seed, n=240, deep=0.9):
    rng = random.Random(seed)
    rows = []
    for tree in range(4):
        for node in range(1, 1 + n // 4 if tree else 2):
            parent = None if node == 1 else (node - 1 if rng.random() < deep else rng.randrange(1, node))
            rows.append((tree % 2, tree, node, parent, rng.choice(["a", "b", "ab"])))
    return rows


@pytest.mark.parametrize("deep", [0.0, 0.9, 1.0])
def test_any_depth(spark, deep):
    rows = trees(3, deep=deep)
    want = plain(rows)
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    names = sorted({tuple(v[0]) for v in want.values()})
    got = {(r.entry, r.tree, r.node): r["rank"] for r in forest.upward_rank(table).collect()}
    assert got == {k: names.index(tuple(v[0])) + 1 for k, v in want.items()}
    places = {(r.entry, r.tree, r.node): [r.pre, r.size, r.leaves] for r in forest.intervals(table).collect()}
    assert places == {k: v[1:] for k, v in want.items()}


def test_chain_keeps_its_leaf(spark):
    chain = spark.createDataFrame([(0, 0, k, k - 1 if k else None, "x") for k in range(10)], SCHEMA)
    assert sorted(r["rank"] for r in forest.upward_rank(chain).collect()) == list(range(1, 11))
    asked = {"root": ["x"], "deep": ["x"] * 10, "below": ["x"] * 11, "other": ["y"]}
    assert {r.prefix: r.leaves for r in forest.subtree_leaves(chain, asked).collect()} == {"root": 1, "deep": 1, "below": 0, "other": 0}
    assert forest.upward_rank(chain.limit(0)).collect() == [] and forest.intervals(chain.limit(0)).collect() == []
    assert forest.subtree_leaves(chain, {}).collect() == []


def test_no_window_over_all_nodes(spark):
    plan = forest.upward_rank(spark.createDataFrame(trees(1), SCHEMA))._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


def test_distances_go_on_to_the_end(spark):
    edges = spark.createDataFrame([(1, k, k + 1, 0) for k in range(40)], "g long, src int, dst int, chg int")
    nodes = spark.createDataFrame([(1, k, "x") for k in range(41)], "g long, id int, sym string")
    start = nodes.where("id = 0").select("g", F.col("id").alias("source"), "id")
    assert {r.id: r.dist for r in graphs.distances(start, edges).collect()} == {k: k for k in range(41)}
    assert {r.id: r.dist for r in graphs.distances(start, edges, within=3).collect()} == {k: k for k in range(4)}


def test_what_is_sent_is_bounded_in_rows_and_bytes(spark, monkeypatch):
    items = spark.range(1000).select("id", F.expr("repeat('x', 1000000)").alias("text"))
    docs = spark.range(5000).select(F.col("id").alias("d"))
    joined = docs.join(scratch.sent(items), F.col("d") == F.col("id"))
    assert "ResolvedHint" not in joined._jdf.queryExecution().analyzed().toString()
    few = spark.range(10).select("id", F.array(F.lit("ab"), F.lit(None).cast("string")).alias("a"), F.create_map(F.lit("k"), F.struct("id")).alias("m"))
    assert few.select(F.max(scratch.row_bytes(few))).first()[0] < 120
    rows = lambda: sorted(tuple(r) for r in docs.join(scratch.sent(few.select("id")), F.col("d") == F.col("id")).collect())
    hinted = lambda: "ResolvedHint" in docs.join(scratch.sent(few.select("id")), F.col("d") == F.col("id"))._jdf.queryExecution().analyzed().toString()
    want = rows()
    assert hinted()
    monkeypatch.setattr(scratch, "SENT_ROWS", 9)
    assert not hinted() and rows() == want


def test_running_sums(spark):
    rows = [(k % 7, k, k * k % 11) for k in range(500)]
    table = spark.createDataFrame(rows, "a long, b long, v long").repartition(6)
    got = {(r.a, r.b): r.s for r in scratch.running(table, "s", "v", "a", "b").collect()}
    total, want = 0, {}
    for a, b, v in sorted(rows):
        want[a, b] = total
        total += v
    assert got == want


def test_rounds_collect_no_nodes_for_broadcasts(spark, tmp_path):
    rows = spark.range(500).selectExpr("0L as entry", "0L as tree", "id as node", "nullif(id - 1, -1) as up", "id as size")
    rows.write.parquet(str(tmp_path / "nodes"))
    now = spark.read.parquet(str(tmp_path / "nodes"))
    met = forest._jump(now, now, "up", "size")
    assert met.where("up_size is not null").count() == 499
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
