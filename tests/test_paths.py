import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from pathloom.operators import graphs, kernels, paths
from pathloom.schema import EDGES, NODES

TOY_NODES = [(0, 0, "C"), (0, 1, "C"), (0, 2, "O"), (1, 0, "C"), (1, 1, "O")]
TOY_EDGES = [(0, 0, 1, 0), (0, 1, 2, 1), (1, 0, 1, 0)]
TOY_PATHS = {
    (0, "(C", 1): 2, (1, "(C", 1): 1, (0, "(C(C", 2): 2, (0, "(C(C[O", 3): 1, (1, "(C(O", 2): 1, (0, "(C[O", 2): 1,
    (0, "(O", 1): 1, (1, "(O", 1): 1, (1, "(O(C", 2): 1, (0, "(O[C", 2): 1, (0, "(O[C(C", 3): 1,
}


def tables(spark, nodes, edges):
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def counted(df):
    return {(r.g, r.path, r.len): r.freq for r in df.collect()}


@pytest.mark.parametrize("strategy", ["graphs", "joins", "sql"])
def test_toy(spark, strategy):
    assert counted(paths.path_table(*tables(spark, TOY_NODES, TOY_EDGES), strategy=strategy)) == TOY_PATHS


def random_graphs(seed, n=12):
    rng = random.Random(seed)
    nodes, edges = [], []
    for g in range(n):
        size = rng.randrange(1, 7)
        nodes += [(g, i, rng.choice("CNO")) for i in range(size)]
        edges += [(g, a, b, rng.choice([0, 0, 1, -1])) for a in range(size) for b in range(a) if rng.random() < 0.5]
    return nodes, edges


def test_strategies_agree_and_paths_are_closed_under_reversal(spark):
    nodes, edges = random_graphs(3)
    depth = 4
    found = [counted(paths.path_table(*tables(spark, nodes, edges), max_depth=depth, strategy=s)) for s in ("graphs", "joins", "sql")]
    assert found[0] == found[1] == found[2]
    assert max(k[2] for k in found[0]) <= depth
    total = {}
    for (g, path, n), f in found[0].items():
        symbols = [c for c in path if c not in "({["]
        marks = [c for c in path if c in "({["][1:]
        back = "(" + symbols[-1] + "".join(m + s for m, s in zip(reversed(marks), reversed(symbols[:-1])))
        assert found[0][g, back, n] == f
        total[n] = total.get(n, 0) + f
    assert total[1] == len(nodes)


def test_index_queries(spark, tmp_path):
    table = paths.path_table(*tables(spark, TOY_NODES, TOY_EDGES))
    paths.write_index(table, f"{tmp_path}/i")
    index = paths.read_index(spark, f"{tmp_path}/i")
    assert {r.path: r.n for r in paths.subpath_count(index, ["(C", "(C[O", "(Z"]).collect()} == {"(C": 3, "(C[O": 1, "(Z": 0}
    assert {r.path for r in paths.descend(index, "(C(C").collect()} == {"(C(C", "(C(C[O"}
    assert {r.step for r in paths.child_symbols(index, "(C").collect()} == {"(C", "[O", "(O"}
    assert {r.path for r in paths.shared_paths(index, 1).collect()} == {"(C", "(O"}
    assert {r.path for r in paths.core_paths(index).collect()} == {"(C[O", "(C(C[O", "(O[C", "(O[C(C"}
    ids = [(r.len, r.path) for r in paths.feature_ids(index).orderBy("path_id").collect()]
    assert ids == sorted(ids)


def test_toy_kernel(spark):
    table = paths.path_table(*tables(spark, TOY_NODES, TOY_EDGES))
    k = {(r.i, r.j): r.k for r in kernels.path_kernels(table, seed=0.0).where("l = 50 and dp = 'float' and paths = 'allpaths' and type = 'f' and power = 1").collect()}
    assert k[0, 0] == pytest.approx(1) and k[1, 1] == pytest.approx(1) and k[1, 0] == pytest.approx(2.7 / (10.818 * 3.42) ** 0.5)


def test_spread_distances_agree_with_the_others(spark):
    nodes, edges = tables(spark, *random_graphs(9))
    as_set = lambda df: {tuple(r) for r in df.collect()}
    assert as_set(graphs.all_pairs(nodes, edges)) == as_set(graphs.all_pairs(nodes, edges, "joins"))
    assert as_set(graphs.core_distance(nodes, edges)) == as_set(graphs.core_distance(nodes, edges, "joins"))


@given(st.integers(0, 10**6))
@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_pieces_and_induced(spark, seed):
    nodes, edges = random_graphs(seed, 4)
    n, e = tables(spark, nodes, edges)
    piece = {(r.g, r.id): r.piece for r in graphs.pieces(n, e).collect()}
    assert all(piece[g, a] == piece[g, b] for g, a, b, _ in edges) and all(piece[g, p] == p for (g, _), p in piece.items())
    inner, links = graphs.induced(n, e, n.where("sym <> 'O'").select("g", "id"))
    assert inner.count() == sum(s != "O" for *_, s in nodes)
    kept = {(g, i) for g, i, s in nodes if s != "O"}
    assert links.count() == sum((g, a) in kept and (g, b) in kept for g, a, b, _ in edges)


def test_streaming_equals_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from pathloom.streaming.paths import append_paths

    nodes, edges = tables(spark, *random_graphs(4))
    packed = nodes.groupBy("g").agg(F.collect_list(F.struct("id", "sym")).alias("n")).join(edges.groupBy("g").agg(F.collect_list(F.struct("src", "dst", "chg")).alias("e")), "g", "left")
    packed.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(packed.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    append_paths(stream, f"{tmp_path}/out", f"{tmp_path}/check").start().awaitTermination()
    got = counted(spark.read.parquet(f"{tmp_path}/out").select("g", "path", "len", "freq"))
    assert got == counted(paths.path_table(nodes, edges))


@pytest.mark.parametrize("strategy", ["graphs", "joins", "sql"])
def test_no_graphs(spark, strategy):
    assert paths.path_table(*tables(spark, [], []), strategy=strategy).collect() == []


def test_features_are_numbered_in_order(spark):
    nodes = [(g, i, "CNO"[(g * i) % 3]) for g in (4, 9, 2) for i in range(5)]
    edges = [(g, i, i + 1, (g + i) % 3 - 1) for g in (4, 9, 2) for i in range(4)]
    table = paths.path_table(*tables(spark, nodes, edges))
    ids = {r.path: r.path_id for r in paths.feature_ids(table).collect()}
    want = sorted({(r.len, r.path) for r in table.collect()})
    assert ids == {p: k for k, (_, p) in enumerate(want, 1)}
    assert {r.graph_id for r in paths.feature_triples(table).collect()} == {1, 2, 3}
