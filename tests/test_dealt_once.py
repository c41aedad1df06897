"""Orders are dealt once to rows of graphs, and an index is cut by graph within a path."""

from collections import Counter

from pyspark.sql import functions as F

from pathloom.operators import adapters, messages, paths
from pathloom.sinks import text as sink
from pathloom.sources import trees
from tests.conftest import SF_SMALL

LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def as_sets(df):
    listed = df.select("g", F.arrays_zip("ids", "syms").alias("n"), F.arrays_zip("src", "dst", "chg").alias("e")).collect()
    return {r.g: (sorted(map(tuple, r.n), key=str), sorted(map(tuple, r.e or []), key=str)) for r in listed}


def test_order_graphs_are_those_of_nodes_and_edges(spark, tmp_path):
    odd = [(k, p, 1, n, 1.0, 1.0, 0.0, 0.0, f, s, None) for k, p, n, f, s in [
        (1, 2, 1, "A", "F"), (1, 1, 1, "N", "O"), (1, 3, None, "R", None), (2, 1, 1, None, "O"), (2, 2, 1, "A", "O"), (2, 3, 2, "A", "F"), (3, 1, 1, "A", "O"), (None, 1, 1, "A", "O"), (None, 1, 2, "A", "F"),
    ]]
    spark.createDataFrame(odd, LINE).write.parquet(f"{tmp_path}/lineitem.parquet")
    for folder in (str(tmp_path), SF_SMALL):
        want = as_sets(paths.as_graphs(*adapters.order_graph(spark, folder)))
        assert as_sets(adapters.order_graphs(spark, folder)[0]) == want and len(want) > 3


def test_what_is_made_of_orders_shuffles_their_lines_once(spark):
    made = [paths.path_table(*adapters.order_graphs(spark, SF_SMALL)), messages.atom_distribution(*adapters.order_graphs(spark, SF_SMALL), context=3), messages.wiener_index(*adapters.order_graphs(spark, SF_SMALL), context=3)]
    assert [exchanges(df) for df in made] == [1, 1, 1]


def test_a_graph_without_a_key_has_paths(spark):
    nodes = spark.createDataFrame([(None, 0, "A"), (1, 0, "B")], "g long, id int, sym string")
    assert {(r.g, r.path) for r in paths.path_table(nodes, nodes.select("g", F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0).alias("chg")).limit(0)).collect()} == {(None, "(A"), (1, "(B")}


def test_a_path_of_most_graphs_is_in_many_ranges(spark, tmp_path):
    table = spark.range(4000).select(F.col("id").alias("g"), F.lit("(A").alias("path"), F.lit(1).alias("len"), F.lit(1).cast("long").alias("freq"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sink.save_index(table, f"{tmp_path}/saved")
        paths.write_index(table, f"{tmp_path}/plain")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for index in (trees.read_index(spark, f"{tmp_path}/saved"), paths.read_index(spark, f"{tmp_path}/plain")):
        files = Counter(r.f for r in index.select(F.input_file_name().alias("f")).collect())
        assert sum(files.values()) == 4000 and max(files.values()) < 2000


def test_settled_is_until_stable_without_a_shuffle(spark):
    chain = [(9, i, i + 1, i % 7 and 0) for i in range(49)]
    nodes = [(9, i, "abc"[i % 3] if i else "~") for i in range(50)] + [(1, 0, "x"), (2, 0, "c"), (2, 1, "b"), (2, 5, "a"), (3, 1, None), (3, 2, "q")]
    edges = chain + [(2, 0, 1, 0), (2, 1, 5, 1), (2, 5, 0, 0), (3, 1, 2, 0)]
    n = spark.createDataFrame(nodes, "g long, id int, sym string")
    e = spark.createDataFrame(edges, "g long, src int, dst int, chg int")
    start = n.select("g", "id", F.ascii("sym").alias("m"))
    most = lambda m, met: F.greatest(m, met)
    graphs = paths.as_graphs(n, e)
    for within in (5, None):
        want, rounds = messages.until_stable(n, e, start, lambda m, chg: m - F.abs(chg), "max", most, within)
        got, made = messages.settled(graphs, F.ascii, lambda m, chg: m - F.abs(chg), F.array_max, most, within)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and made == rounds
    assert rounds == 49


def test_reachable_symbols_write_no_rounds_and_shuffle_lines_only(spark):
    from pathloom.plans import catalogue
    from pathloom.scratch import scratch_made

    with scratch_made() as made:
        found = catalogue.QUERIES["reachable_symbols"](spark, SF_SMALL)
    assert len(made) == 1 and found.columns == ["g", "id", "m"]
