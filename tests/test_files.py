"""File scans and sinks on small files made here."""

import pytest
from pyspark.sql import functions as F

from pathloom.functions import columns
from pathloom.operators import forest, labels, paths, reactions
from pathloom.sinks import text as sink
from pathloom.sources import flatfile, molfile, trees
from tests.test_paths import TOY_EDGES, TOY_NODES, tables

MOL = """first
second

  4  3  0     0  0  0  0  0  0999 V2000
    1.0000    2.0000    0.0000 C   0  0  0  0  0
    0.0000    0.0000    0.0000 H   0  0  0  0  0
    0.0000    0.0000    0.0000 O   0  0  0  0  0
   -1.5000    0.0000    0.0000 N   0  0  0  0  0
  1  2  1  0  0  0
  1  3  2  0  0  0
  3  4  1  0  0  0
M  END
"""
MOL2 = """@<TRIPOS>MOLECULE
m
@<TRIPOS>ATOM
1 C1 0.5 1.5 0.0 C.ar
3 N1 0.0 0.0 0.0 N
@<TRIPOS>BOND
1 1 3 ar
"""
FLAT = """ENTRY       R00001                      Reaction
EQUATION    2 C00001 + n C00002 <=> C00003 +
            C00004
ENZYME      1.1.1.1         2.3.-.-
///
ENTRY       R00002                      Reaction
EQUATION    G00009 <=> C00001
RPAIR       RP00001  C00001_C00002 main
///
"""


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_molecules(spark, tmp_path):
    write(tmp_path / "m/b.mol", MOL)
    write(tmp_path / "m/a.mol", MOL.replace("\n", "\r\n"))
    graphs, nodes, edges = molfile.read_molecules(spark, f"{tmp_path}/m")
    assert {(r.g, r.name) for r in graphs.collect()} == {(0, "a"), (1, "b")}
    assert [(r.id, r.sym, r.x) for r in nodes.where("g = 0").orderBy("id").collect()] == [(0, "C", 1.0), (1, "O", 0.0), (2, "N", -1.5)]
    assert sorted((r.src, r.dst, r.type, r.chg) for r in edges.where("g = 1").collect()) == [(0, 1, 2, 0), (1, 2, 1, 0)]
    _, every, bonds = molfile.read_molecules(spark, f"{tmp_path}/m", keep_hydrogen=True)
    assert every.count() == 8 and bonds.count() == 6
    order = spark.createDataFrame([("R", 0, 0), ("R", 1, 1)], "reaction string, ord int, g long")
    assert [r.offset for r in molfile.running_offsets(nodes, order).orderBy("ord").collect()] == [0, 3]


def test_mol2(spark, tmp_path):
    write(tmp_path / "m/x.mol2", MOL2)
    write(tmp_path / "m/y.mol", MOL)
    _, nodes, edges = molfile.read_mol2(spark, f"{tmp_path}/m")
    assert [(r.id, r.sym) for r in nodes.orderBy("id").collect()] == [(0, "C"), (1, "N")]
    assert [(r.src, r.dst, r.type) for r in edges.collect()] == [(0, 1, "ar")]


def test_reaction_graphs_round_trip(spark, tmp_path):
    nodes, edges = tables(spark, TOY_NODES, TOY_EDGES)
    edges = edges.withColumns({"old": F.lit(1), "new": F.lit(2)})
    heads = spark.createDataFrame([(0, "R1 1.1.1.1 2.-.-.-", "C1 C2 => C3"), (1, "R2", "C4 => C5")], "g long, title string, second string")
    for name, back in (("f", False), ("b", True)):
        for r in sink.mol_text(heads, nodes, edges, backward=back).collect():
            write(tmp_path / f"r/R{r.g}_7_{name}.mol", r.text)
    graphs, atoms, bonds, sides = molfile.read_reaction_graphs(spark, f"{tmp_path}/r")
    g = {r.name: r for r in graphs.collect()}
    assert g["R0_7_f.mol"].direction == 1 and g["R0_7_b.mol"].direction == -1 and g["R0_7_f.mol"].map_num == 7
    assert g["R0_7_f.mol"].ligand == "R1" and g["R0_7_f.mol"].ec_codes == ["1.1.1.1", "2.-.-.-"]
    of = lambda name: {(r.src, r.dst): (r.chg, r.old, r.new) for r in bonds.where(F.col("g") == g[name].g).collect()}
    assert of("R0_7_f.mol") == {(0, 1): (0, 1, 2), (1, 2): (1, 1, 2)} and of("R0_7_b.mol") == {(0, 1): (0, 2, 1), (1, 2): (-1, 2, 1)}
    assert [r.ligand for r in sides.where(F.col("g") == g["R0_7_f.mol"].g).orderBy(F.desc("side"), "ord").collect()] == ["C1", "C2", "C3"]
    assert atoms.count() == 10


def test_flat_files(spark, tmp_path):
    entries = flatfile.read_entries(spark, write(tmp_path / "reaction", FLAT))
    found = {r.id: r for r in flatfile.reactions(entries).collect()}
    assert found["R00001"].subs == ["C00001", "C00002"] and found["R00001"].prods == ["C00003", "C00004"]
    assert found["R00001"].ec == ["1.1.1.1", "2.3.-.-"] and found["R00002"].ec == []
    assert found["R00002"].rpairs == ["RP00001", "C00001_C00002"]
    listed = flatfile.reaction_list(flatfile.reactions(entries)).collect()
    assert [(r.id, r.ligands) for r in listed] == [("R00001", ["C00001", "C00001", "C00002", "C00002", "p", "C00003", "C00004"])]
    lines = sink.reaction_lines(flatfile.reaction_list(flatfile.reactions(entries)).withColumn("natoms", F.lit(9)))
    back = flatfile.read_reaction_list(spark, write(tmp_path / "list.txt", "\n".join(r.value for r in lines.collect()))).first()
    assert (back.id, back.natoms, back.subs, back.prods) == ("R00001", 9, ["C00001"] * 2 + ["C00002"] * 2, ["C00003", "C00004"])


@pytest.mark.parametrize("equation, want", [
    ("C1 <=> C2", "C1 p C2"), ("2 C1 + C3 <=> C2", "C1 C1 C3 p C2"), ("n C1 <=> C2(n)", "C1 C1 p C2"), ("(n-1) C1 + C2 <=> n C3", "C1 C1 C2 p C3 C3 C3"),
    ("2n C1 <=> (n+1) C2", "C1 C1 C1 C1 p C2 C2 C2"), ("(m+n) C1 <=> C2", "C1 C1 C1 C1 p C2"),
])
def test_equations(spark, equation, want):
    got = spark.createDataFrame([(equation,)], "e string").select(reactions.expand_equation(F.col("e")).alias("l")).first().l
    assert " ".join(got) == want


def test_features_and_tables(spark, tmp_path):
    f = write(tmp_path / "x.feat", "C1:12:ATOM_DISTRIBUTION:2=(CCCO,6=CCC,4=O,)\nC1:3:RING:6=True\nC2:1:MORGAN:1=(4)\n")
    got = {(r.mol, r.atom): r for r in flatfile.read_features(spark, f).collect()}
    assert got["C1", 12].value == "CCCO" and got["C1", 12].dirs == {4: "O", 6: "CCC"} and got["C1", 12].context == 2 and ("C1", 3) not in got
    t = flatfile.read_code_table(spark, write(tmp_path / "t", " 3 306 0\n 0 0 0\n 4 1 1\n")).orderBy("row_no").collect()
    assert [(r.codes[0], r.used, r.forward) for r in t] == [(3, True, True), (0, False, None), (4, True, False)]
    r = flatfile.read_rpair_definitions(spark, write(tmp_path / "rp", "R1 C1 C2 main\nshort line\n")).collect()
    assert [(x.sub, x.type) for x in r] == [("C1", "main")]
    tagged = flatfile.read_tagged(spark, write(tmp_path / "tag", "ATOM 1 C\nBOND 1 2\n")).orderBy("ord").collect()
    assert [(x.tag, x.fields) for x in tagged] == [("ATOM", ["1", "C"]), ("BOND", ["1", "2"])]
    assert {(e.src, e.dst) for e in flatfile.read_edge_list(spark, write(tmp_path / "e", "1 2\n3 4\nx\n")).collect()} == {(1, 2), (3, 4)}
    m = flatfile.read_mapping_report(spark, write(tmp_path / "map", "REACTION R9\n 1 C 2 C\n 2 O 1 O\nBONDS\n1 2 0 0\n")).collect()
    assert {(x.reaction, x.lhs_atom, x.rhs_atom) for x in m} == {("R9", 1, 2), ("R9", 2, 1)}
    pair = flatfile.rpairs(flatfile.read_entries(spark, write(tmp_path / "pair", "ENTRY       RP1\nNAME        C1_C2\nREACTION    R00001 R00002\nALIGN       2\n            1   1:C1a 2:C1b\n            2   2:O1a 1:O1b\n///\n"))).first()
    assert pair.reactions == ["R00001", "R00002"] and [(x.a, x.b) for x in pair.align] == [(1, 2), (2, 1)]


def test_trees(spark, tmp_path):
    a = write(tmp_path / "s/a.seqs", ">one.seqs\n(C(C[O]))\n(O)\n>two\n(N{C})")
    write(tmp_path / "s/b.seqs", ">three\n(X)\n")
    found = trees.read_sequences(spark, f"{tmp_path}/s").orderBy("entry", "tree").collect()
    assert [(r.entry, r.title, r.tree, r.line) for r in found] == [(0, "one", 0, "(C(C[O]))"), (0, "one", 1, "(O)"), (1, "two", 0, "(N{C})"), (2, "three", 0, "(X)")]
    nodes = trees.read_forest(spark, a).orderBy("entry", "tree", "node").collect()
    assert [(r.sym, r.parent, r.depth, r.bracket, r.is_leaf) for r in nodes] == [("C", None, 1, "(", False), ("C", 0, 2, "(", False), ("O", 1, 3, "[", True), ("O", None, 1, "(", True), ("N", None, 1, "(", False), ("C", 0, 2, "{", True)]
    lines = trees.read_sequences(spark, a).select("entry", "tree", "line")
    assert sorted(map(tuple, forest.tree_text(forest.parse_trees(lines)).collect())) == sorted(map(tuple, lines.collect()))
    size = trees.input_size(trees.read_sequences(spark, a)).first()
    assert (size.entries, size.trees, size.nodes) == (2, 3, 6)
    s = trees.read_symbols(spark, write(tmp_path / "map", "otoi['*'] = \"(C\";\nnoise\n")).collect()
    assert [(r.code, r.label) for r in s] == [("*", "(C")]
    assert [r.name for r in trees.graph_list(spark, f"{tmp_path}/s").orderBy("index").collect()] == ["a.seqs", "b.seqs"]


def test_path_files(spark, tmp_path):
    nodes, edges = tables(spark, TOY_NODES, TOY_EDGES)
    table = paths.path_table(nodes, edges)
    names = spark.createDataFrame([(0, "g:0"), (1, "g1")], "g long, name string")
    f = write(tmp_path / "f.freqs", "\n".join(r.value for r in sink.frequencies(table, names).collect()))
    assert {(r.path, r.graph): r.freq for r in trees.read_frequencies(spark, f).collect()} == {(r.path, "g:0" if r.g == 0 else "g1"): r.freq for r in table.collect()}
    sink.save_index(table, f"{tmp_path}/index")
    assert trees.read_index(spark, f"{tmp_path}/index").count() == 11
    write(tmp_path / "index/version/part-x", "other")
    triples = paths.feature_triples(table)
    sink.write_triples(triples, paths.feature_ids(table), f"{tmp_path}/mtl")
    assert spark.read.option("sep", " ").schema("a long, b long, c long").csv(f"{tmp_path}/mtl").count() == 11
    assert sink.triple_header(triples).first().value == "9 2 0"
    lines = sink.sequences(nodes, edges).select(F.col("g").alias("entry"), F.col("start").cast("long").alias("tree"), "line")
    assert forest.parse_trees(lines).count() == table.agg(F.sum("freq")).first()[0]
    graphs = spark.createDataFrame([(0, "R1_f.mol", 1), (1, "R2_b.mol", -1)], "g long, name string, direction int")
    named = {r.name: r.text for r in sink.sequence_files(sink.sequences(nodes, edges), graphs).collect()}
    assert set(named) == {"R1_f_.seqs", "R2_b_.seqs"} and named["R2_b_.seqs"] == ">R2_b_.seqs\n(C(O))\n(O(C))\n"
    kernel = spark.createDataFrame([(0, 0, 1.0), (1, 0, float("nan")), (1, 1, float("inf"))], "i long, j long, k double")
    assert [r.value for r in sink.kernel_lines(kernel).orderBy("i").collect()] == ["1.00000E+00", "NaN\tInf"]
    assert [r.i for r in sink.kernel_lines(kernel, 1, 1).collect()] == [1]
    old = spark.createDataFrame([("a",)], "value string")
    assert [r.value for r in sink.new_lines(spark.createDataFrame([("a",), ("b",), ("b",)], "value string"), old).collect()] == ["b"]


def test_graphviz(spark):
    nodes, edges = tables(spark, TOY_NODES, TOY_EDGES)
    got = {r.g: r.value for r in sink.dot(nodes, edges).collect()}
    assert got[0] == 'graph g0 {\n  n0 [label="C"];\n  n1 [label="C"];\n  n2 [label="O"];\n  n0 -- n1;\n  n1 -- n2 [label="+"];\n}'
    assert [r.value for r in sink.network_dot(spark.createDataFrame([(1, 2)], "r1 long, r2 long")).collect()] == ['  "1" -- "2";']


def test_reports_and_labels(spark):
    heads = spark.createDataFrame([("R1", "A <=> B", 2)], "reaction string, equation string, cost int")
    image = spark.createDataFrame([("R1", 2, "O", 1, "O"), ("R1", 1, "C", 2, "C")], "reaction string, lhs_atom int, lhs_sym string, rhs_atom int, rhs_sym string")
    bonds = spark.createDataFrame([("R1", 2, 1, 0), ("R1", 1, 2, 0)], "reaction string, a int, b int, chg int")
    assert sink.mapping_report(heads, image, bonds).first().value == "REACTION R1\nEQUATION A <=> B\nCOST 2\nATOMS\n1 C 2 C\n2 O 1 O\nBONDS\n1 2 0\n"
    own = spark.createDataFrame([("x", "1.1.1.1"), ("x", "2.-.-.-"), ("y", "1.1.1.1")], "item string, label string")
    assert {r.item: r.value for r in sink.labels_matrix(own, ["1.1.1.1", "2.-.-.-"]).collect()} == {"x": "1 1", "y": "1 0"}
    files = spark.createDataFrame([("R00001_1_f.mol",), ("R00002_1_b.mol",)], "name string")
    assert [(r.id, r.name) for r in labels.graph_files(spark.createDataFrame([("R00001",)], "id string"), files).collect()] == [("R00001", "R00001_1_f.mol")]
    sides = spark.createDataFrame([(1, "s", "A"), (1, "s", "B"), (1, "p", "C")], "reaction long, side string, ligand string")
    pairs = spark.createDataFrame([(1, "C", "A", "main"), (1, "A", "Z", "leave")], "reaction long, sub string, prod string, type string")
    nodes, edges = reactions.ligand_graph(sides, pairs)
    name = {r.id: r.sym for r in nodes.collect()}
    assert {(frozenset((name[r.src], name[r.dst])), r.chg) for r in edges.collect()} == {(frozenset("AC"), 1), (frozenset("AB"), 0)}


def test_column_functions(spark):
    row = spark.createDataFrame([([1, None, 3], [2, 5, None], [0.5, 0.5], ["a", "a", "b"], ["a", "b", "b"], {"x": 1}, {"x": 2, "y": 3})], "a array<int>, b array<int>, p array<double>, s array<string>, t array<string>, m map<string,int>, n map<string,int>")
    c = F.col
    got = row.select(
        columns.elementwise(c("a"), c("b"), "min").alias("lo"), columns.elementwise(c("a"), c("b"), "add").alias("sum"), columns.array_sum(c("a")).alias("total"), columns.entropy(c("p")).alias("h"),
        columns.multiset_common(c("s"), c("t")).alias("common"), columns.merged_counts(c("m"), c("n")).alias("merged"), columns.ceil_log2(F.lit(9)).alias("log"), columns.gaussian(F.lit(0.0)).alias("pdf"), columns.logistic(F.lit(0.5), 2.0).alias("half"),
    ).first()
    assert got.lo == [1, 5, 3] and got["sum"] == [3, None, None] and got.total == 4 and got.h == pytest.approx(0.30103) and got.common == 2
    assert got.merged == {"x": 3, "y": 3} and got.log == 4 and got.pdf == pytest.approx(0.398942) and got.half == 0.5


def test_reactions_of_molecules_from_files(spark, tmp_path):
    (tmp_path / "r").mkdir()
    for name, text in {"1": "R00001  1.2.3.4\nA A B => C A\nrest of it\n", "2": "R00002\nA  B\r\n", "3": "R00003\n\n", "4": "R00004", "5": "R00005\n=> C\n"}.items():
        (tmp_path / "r" / name).write_text(text)
    sides = flatfile.read_reaction_sides(spark, f"{tmp_path}/r")
    assert sorted(map(tuple, sides.collect())) == [
        ("R00001", "p", 0, "C"), ("R00001", "p", 1, "A"), ("R00001", "s", 0, "A"), ("R00001", "s", 1, "A"), ("R00001", "s", 2, "B"),
        ("R00002", "s", 0, "A"), ("R00002", "s", 1, "B"), ("R00005", "p", 0, "C"),
    ]
    (tmp_path / "pairs").write_text("R00001 C A trans\nR00001 A C main\nR00001 A A odd\nR00009 A B main\nR00002 A\n")
    nodes, edges = reactions.molecule_graph(sides, flatfile.read_rpair_definitions(spark, f"{tmp_path}/pairs", placed=True))
    assert sorted(map(tuple, nodes.where("g = 'R00001'").collect())) == [("R00001", k, s) for k, s in enumerate("AABCA")]
    # The first pair gives the type; an odd type is 0; the products C and A are joined by the pair, not as a group.
    assert sorted(tuple(r)[1:] for r in edges.where("g = 'R00001'").collect()) == [(0, 1, 0), (0, 2, 0), (0, 3, 4), (0, 4, 0), (1, 2, 0), (1, 3, 4), (1, 4, 0), (3, 4, 4)]
    assert [tuple(r) for r in edges.where("g <> 'R00001'").collect()] == [("R00002", 0, 1, 0)]
    assert all(t.collect() == [] for t in reactions.molecule_graph(sides.limit(0), flatfile.read_rpair_definitions(spark, f"{tmp_path}/pairs", placed=True)))


def test_no_name_of_the_registered_queries_is_bound_twice():
    """A second helper of a name takes the place of the first in all queries that call it."""
    import ast
    from collections import Counter
    from pathlib import Path

    from pathloom import plans

    for module in Path(plans.__file__).parent.glob("*.py"):
        names = Counter(x.name for x in ast.parse(module.read_text()).body if isinstance(x, ast.FunctionDef))
        assert [n for n, times in names.items() if times > 1] == [], module.name


def test_entries_of_one_name_stay_apart(spark, tmp_path):
    one = "ENTRY       R00001   Reaction\nEQUATION    2 C00001 <=> C00002\nENZYME      1.1.1.1\n///\n"
    two = "ENTRY       R00001   Reaction\nEQUATION    C00003 <=> C00004\n            + C00005\n///\n"
    found = flatfile.reactions(flatfile.read_entries(spark, write(tmp_path / "twice", one + two)))
    assert sorted((r.id, r.equation, r.ec) for r in found.collect()) == [("R00001", "2 C00001 <=> C00002", ["1.1.1.1"]), ("R00001", "C00003 <=> C00004 + C00005", [])]
    pair = "ENTRY       RP1\nNAME        {}\nREACTION    R00001\nALIGN       1\n            1   1:C1a 2:C1b\n///\n"
    pairs = flatfile.rpairs(flatfile.read_entries(spark, write(tmp_path / "pairs", pair.format("A_B") + pair.format("A_C"))))
    assert sorted((r.name, r.reactions) for r in pairs.collect()) == [("A_B", ["R00001"]), ("A_C", ["R00001"])]
    files = spark.createDataFrame([("R00001_1.mol",), ("R00001_2.mol",)], "name string")
    ids = spark.createDataFrame([("R00001",), ("R00001",)], "id string")
    assert sorted(r.name for r in labels.graph_files(ids, files).collect()) == ["R00001_1.mol", "R00001_2.mol"]


def test_reports_of_one_file_are_read_apart(spark, tmp_path):
    """A file of many reports is cut at their marks: with small splits several tasks read it, each its own reports."""
    report = "REACTION R{0}\nEQUATION A <=> B\nCOST 1\nATOMS\n1 C {0} C\n2 O 1 O\nBONDS\n1 2 0\n"
    path = write(tmp_path / "reports", "".join(report.format(k) for k in range(300)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = flatfile.read_mapping_report(spark, path)
        texts = " ".join(found._jdf.queryExecution().optimizedPlan().toString().split())
        got = sorted((int(r.reaction[1:]), r.lhs_atom, r.rhs_atom) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert got == [row for k in range(300) for row in ((k, 1, k), (k, 2, 1))] and "file_path" not in texts


def test_tries_of_a_graph_take_their_neighbours_from_one_table(spark):
    """A chain of 20,000 nodes: with a table of neighbours for each start this takes minutes."""
    import time

    size = 20_000
    nodes = spark.range(size).select(F.lit(0).cast("long").alias("g"), F.col("id").cast("int").alias("id"), F.lit("A").alias("sym"))
    edges = spark.range(size - 1).select(F.lit(0).cast("long").alias("g"), F.col("id").cast("int").alias("src"), (F.col("id") + 1).cast("int").alias("dst"), F.lit(0).alias("chg"))
    began = time.monotonic()
    assert {(r.line, r.n) for r in sink.sequences(nodes, edges, 2).groupBy("line").agg(F.count("*").alias("n")).collect()} == {("(A(A))", 2), ("(A(A)(A))", size - 2)}
    assert time.monotonic() - began < 60
