"""Registered queries of the file forms: tables are written as the engine's sinks write them and read by its scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pathloom.operators import adapters, graphs, kernels, labels, mapping, messages, paths, reactions
from pathloom.plans import sql
from pathloom.plans.registry import query
from pathloom.scratch import materialise, scratch_path
from pathloom.sinks import text as sink
from pathloom.sources import flatfile, molfile, trees

# --- molecules: a hundred customers of a nation in a row are a molecule, its atoms told by their keys

_MOL = """
s AS (SELECT c_nationkey AS nk, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS r FROM customer),
m AS (SELECT 'M' || lpad(CAST(nk AS VARCHAR), 3, '0') || lpad(CAST(r // 100 AS VARCHAR), 6, '0') AS name, CAST(nk AS BIGINT) AS nk, r % 100 AS id,
             ['C', 'N', 'O', 'H', 'S'][c_custkey % 5 + 1] AS sym, c_acctbal AS x, CASE WHEN c_acctbal >= 0 THEN 1 ELSE 2 END AS type, c_custkey % 3 - 1 AS chg FROM s),
b AS (SELECT * FROM (SELECT name, id AS src, lead(id) OVER (PARTITION BY name ORDER BY id) AS dst, type, chg FROM m) WHERE dst IS NOT NULL)"""


def _molecules(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (g, nk, id, sym, x, y) and edges (g, src, dst, type, chg, old, new); g is a name."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_nationkey", "c_custkey", "c_acctbal")
    r = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    letter = F.element_at(F.array(*map(F.lit, "CNOHS")), (F.pmod("c_custkey", F.lit(5)) + 1).cast("int"))
    rows = rows.withColumn("r", r).select(
        F.concat(F.lit("M"), F.lpad(F.col("c_nationkey").cast("string"), 3, "0"), F.lpad(F.floor(F.col("r") / 100).cast("string"), 6, "0")).alias("g"), F.col("c_nationkey").cast("long").alias("nk"),
        (F.col("r") % 100).alias("id"), letter.alias("sym"), F.col("c_acctbal").alias("x"), F.lit(0.0).alias("y"), F.when(F.col("c_acctbal") >= 0, 1).otherwise(2).alias("type"), (F.col("c_custkey") % 3 - 1).cast("int").alias("chg"),
    )
    after = F.lead("id").over(Window.partitionBy("g").orderBy("id"))
    edges = rows.select("g", F.col("id").alias("src"), after.alias("dst"), "type", "chg").where("dst is not null")
    return rows.select("g", "nk", "id", "sym", "x", "y"), edges.withColumns({"old": F.lit(1), "new": F.lit(1) + F.col("chg")})


def _molecule_files(spark: SparkSession, sf_dir: str) -> str:
    nodes, edges = _molecules(spark, sf_dir)
    titles = nodes.select("g", F.col("g").alias("title")).distinct()
    folder = scratch_path(spark, "mol")
    sink.write_files(sink.molecule_text(titles, nodes, edges).select(F.concat("g", F.lit(".mol")).alias("name"), "text"), folder)
    return folder


@query("WITH " + _MOL + """, h AS (SELECT name, id, sym, x, row_number() OVER (PARTITION BY name ORDER BY id) - 1 AS now FROM m WHERE sym <> 'H'),
e AS (SELECT b.name, a.now AS src, c.now AS dst, type FROM b JOIN h a ON a.name = b.name AND a.id = b.src JOIN h c ON c.name = b.name AND c.id = b.dst),
d AS (SELECT name, src AS now, type FROM e UNION ALL SELECT name, dst, type FROM e)
SELECT h.name, CAST(h.now AS INTEGER) AS id, h.sym, round(h.x, 2) AS x, CAST(coalesce(sum(type), 0) AS BIGINT) AS bonds FROM h LEFT JOIN d ON d.name = h.name AND d.now = h.now GROUP BY ALL""")
def molecule_scan(spark, sf_dir):
    names, nodes, edges = molfile.read_molecules(spark, _molecule_files(spark, sf_dir))
    ends = edges.select("g", F.explode(F.array("src", "dst")).alias("id"), "type").groupBy("g", "id").agg(F.sum("type").alias("bonds"))
    joined = nodes.join(names, "g").join(ends, ["g", "id"], "left")
    return joined.select("name", "id", "sym", F.round("x", 2).alias("x"), F.coalesce("bonds", F.lit(0)).cast("long").alias("bonds"))


@query("WITH " + _MOL + " SELECT name || '.mol' AS name, CAST(row_number() OVER (ORDER BY name) - 1 AS BIGINT) AS index FROM (SELECT DISTINCT name FROM m)")
def graph_list(spark, sf_dir):
    return trees.graph_list(spark, _molecule_files(spark, sf_dir), "*.mol")


@query("WITH " + _MOL + ", k AS (SELECT name, count(*) AS size FROM m GROUP BY name) SELECT CAST(left(name, 4) AS VARCHAR) AS reaction, name, size, CAST(coalesce(sum(size) OVER (PARTITION BY left(name, 4) ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM k")
def atom_offsets(spark, sf_dir):
    names, nodes, _ = molfile.read_molecules(spark, _molecule_files(spark, sf_dir), keep_hydrogen=True)
    order = names.select(F.substring("name", 1, 4).alias("reaction"), F.col("name").alias("ord"), "g")
    sizes = nodes.groupBy("g").agg(F.count("*").alias("size"))
    return molfile.running_offsets(nodes, order).join(sizes, "g").select("reaction", F.col("ord").alias("name"), "size", F.col("offset").cast("long").alias("first"))


@query("WITH " + _MOL + """, h AS (SELECT name, count(*) FILTER (sym <> 'H') AS heavy, bool_or(sym = 'H') AS has_h FROM m GROUP BY name),
k AS (SELECT b.name, count(*) AS bonds FROM b JOIN m x ON x.name = b.name AND x.id = b.src JOIN m y ON y.name = b.name AND y.id = b.dst WHERE x.sym <> 'H' AND y.sym <> 'H' GROUP BY b.name)
SELECT h.name, has_h, heavy, CAST(coalesce(bonds, 0) AS BIGINT) AS bonds FROM h LEFT JOIN k USING (name)""")
def heavy_atoms(spark, sf_dir):
    nodes, edges = _molecules(spark, sf_dir)
    left, links = graphs.heavy_atoms(nodes.select("g", "id", "sym"), edges.select("g", "src", "dst", "chg"))
    out = reactions.has_hydrogens(nodes).join(left.groupBy("g").agg(F.count("*").alias("heavy")), "g", "left")
    out = out.join(links.groupBy("g").agg(F.count("*").alias("bonds")), "g", "left").na.fill(0, ["heavy", "bonds"])
    return out.withColumnRenamed("g", "name")


@query("WITH " + _MOL + """, t AS (SELECT name, CAST(sum(chg) AS BIGINT) AS chg, CAST(count(*) AS BIGINT) AS old, CAST(sum(1 + chg) AS BIGINT) AS new, CAST(max(chg) AS INTEGER) AS top, CAST(min(chg) AS INTEGER) AS low FROM b GROUP BY name),
n AS (SELECT name, count(*) AS atoms FROM m GROUP BY name)
SELECT name || '_0_f.mol' AS name, 1 AS direction, 0 AS map_num, name AS ligand, '1.1.1.1 2.3.-.4' AS ec, atoms, 'C1 C2 | C3' AS sides, chg, old, new, top FROM t JOIN n USING (name)
UNION ALL SELECT name || '_0_b.mol', -1, 0, name, '1.1.1.1 2.3.-.4', atoms, 'C1 C2 | C3', -chg, new, old, -low FROM t JOIN n USING (name)""")
def reaction_graph_scan(spark, sf_dir):
    nodes, edges = _molecules(spark, sf_dir)
    heads = nodes.select("g", F.concat("g", F.lit(" 1.1.1.1 2.3.-.4")).alias("title"), F.lit("C1 C2 => C3").alias("second")).distinct()
    folder = scratch_path(spark, "reaction-mol")
    for mark, backward in (("_0_f.mol", False), ("_0_b.mol", True)):
        sink.write_files(sink.mol_text(heads, nodes, edges, backward).select(F.concat("g", F.lit(mark)).alias("name"), "text"), folder)
    found, atoms, bonds, sides = molfile.read_reaction_graphs(spark, folder)
    told = lambda s: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("ord", "ligand")))), lambda x: x["ligand"]), " ")
    by_side = sides.groupBy("g").agg(F.concat_ws(" | ", told("s"), told("p")).alias("sides"))
    changes = bonds.groupBy("g").agg(F.sum("chg").alias("chg"), F.sum("old").alias("old"), F.sum("new").alias("new"), F.max("chg").alias("top"))
    out = found.join(by_side, "g").join(changes, "g").join(atoms.groupBy("g").agg(F.count("*").alias("atoms")), "g")
    return out.select("name", "direction", "map_num", "ligand", F.array_join("ec_codes", " ").alias("ec"), "atoms", "sides", "chg", "old", "new", "top")


@query("WITH " + _MOL + """, a AS (SELECT name, string_agg(sym, '' ORDER BY id) AS syms, round(sum(x), 2) AS x FROM m GROUP BY name), k AS (SELECT name, count(*) AS bonds, CAST(sum(src + dst) AS BIGINT) AS ends, string_agg(CAST(type AS VARCHAR), '' ORDER BY src) AS types FROM b GROUP BY name)
SELECT a.name, syms, x, bonds, ends, types FROM a JOIN k USING (name)""")
def mol2_scan(spark, sf_dir):
    nodes, edges = _molecules(spark, sf_dir)
    atom = F.concat_ws(" ", F.col("id") + 1, F.concat("sym", F.col("id").cast("string")), F.format_string("%.2f", "x"), F.lit("0.0"), F.lit("0.0"), F.concat("sym", F.lit(".3")))
    bond = F.concat_ws(" ", F.col("src") + 1, F.col("src") + 1, F.col("dst") + 1, "type")
    lines = lambda key, line: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, line.alias("line")))), lambda x: x["line"]), "\n")
    texts = nodes.groupBy("g").agg(lines("id", atom).alias("a")).join(edges.groupBy("g").agg(lines("src", bond).alias("b")), "g")
    whole = F.concat_ws("\n", F.lit("@<TRIPOS>MOLECULE"), "g", F.lit("@<TRIPOS>ATOM"), "a", F.lit("@<TRIPOS>BOND"), "b", F.lit(""))
    folder = scratch_path(spark, "mol2")
    sink.write_files(texts.select(F.concat("g", F.lit(".mol2")).alias("name"), whole.alias("text")), folder)
    found, atoms, bonds = molfile.read_mol2(spark, folder)
    told = lambda key, c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, c))), lambda x: x[c]), "")
    a = atoms.groupBy("g").agg(told("id", "sym").alias("syms"), F.round(F.sum("x"), 2).alias("x"))
    b = bonds.groupBy("g").agg(F.count("*").alias("bonds"), F.sum(F.col("src") + F.col("dst")).alias("ends"), told("edge", "type").alias("types"))
    return found.join(a, "g").join(b, "g").select(F.regexp_replace("name", r"\.mol2$", "").alias("name"), "syms", "x", "bonds", "ends", "types")


# --- entries: a part is a reaction, its size the first compound and the coefficient

_PART = """
c AS (SELECT p_partkey, 'R' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') AS id, CASE WHEN p_size % 10 = 0 THEN 'G' ELSE 'C' END || lpad(CAST(p_size AS VARCHAR), 5, '0') AS a,
             'C' || lpad(CAST(p_partkey % 97 AS VARCHAR), 5, '0') AS b, p_size % 3 + 1 AS k, p_size FROM part)"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    five = lambda c: F.lpad(c.cast("string"), 5, "0")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    return rows.select(
        "p_partkey", F.when(F.length(F.col("p_partkey").cast("string")) > 5, F.concat(F.lit("R"), F.substring(F.col("p_partkey").cast("string"), 1, 5))).otherwise(F.concat(F.lit("R"), five(F.col("p_partkey")))).alias("id"),
        F.concat(F.when(F.col("p_size") % 10 == 0, "G").otherwise("C"), five(F.col("p_size"))).alias("a"),
        F.concat(F.lit("C"), five(F.col("p_partkey") % 97)).alias("b"), (F.col("p_size") % 3 + 1).alias("k"), "p_size",
    )


def _keyword(name: str, data: Column) -> Column:
    return F.concat(F.lit(name.ljust(12)), data)


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of parts as a keyword file, written and read again."""
    c = _parts(spark, sf_dir)
    equation = F.concat(F.col("k").cast("string"), F.lit(" "), "a", F.lit(" + n "), "b", F.lit(" <=> C00777 + "), "a")
    text = F.concat_ws(
        "\n", _keyword("ENTRY", F.concat("id", F.lit("                      Reaction"))), _keyword("EQUATION", equation),
        _keyword("RPAIR", F.concat(F.lit("RP00001  "), F.regexp_replace("a", "G", "C"), F.lit("_C00777 main"))), _keyword("", F.concat(F.lit("RP00002  "), "b", F.lit("_C00777 leave"))),
        _keyword("ENZYME", F.concat(F.lit("1.1.1."), F.col("k").cast("string"), F.lit("     2.3.-.7  1.1.1."), F.col("k").cast("string"))), F.lit("///"),
    )
    folder = scratch_path(spark, "entries")
    c.select(text.alias("value")).write.text(folder)
    return flatfile.read_entries(spark, folder)


@query("WITH " + _PART + """ SELECT id, CAST(k AS VARCHAR) || ' ' || a || ' + n ' || b || ' <=> C00777 + ' || a AS equation, a || ' ' || b AS subs, 'C00777 ' || a AS prods,
'RP00001 ' || replace(a, 'G', 'C') || '_C00777 RP00002 ' || b || '_C00777' AS rpairs, '1.1.1.' || k || ' 2.3.-.7' AS ec FROM c""")
def entry_scan(spark, sf_dir):
    found = flatfile.reactions(_entries(spark, sf_dir))
    return found.select("id", "equation", *(F.array_join(c, " ").alias(c) for c in ("subs", "prods", "rpairs", "ec")))


@query("WITH " + _PART + """ SELECT id, CAST(k + 4 AS INTEGER) AS natoms, repeat(a || ' ', CAST(k AS INTEGER)) || b || ' ' || b AS subs, 'C00777 ' || a AS prods FROM c WHERE a NOT LIKE 'G%'""")
def reaction_list(spark, sf_dir):
    listed = flatfile.reaction_list(flatfile.reactions(_entries(spark, sf_dir)))
    folder = scratch_path(spark, "reaction-list")
    sink.reaction_lines(listed.select("id", (F.size("ligands") - 1).alias("natoms"), "ligands")).write.text(folder)
    return flatfile.read_reaction_list(spark, folder).select("id", "natoms", F.array_join("subs", " ").alias("subs"), F.array_join("prods", " ").alias("prods"))


@query("WITH " + _PART + " SELECT id AS reaction, a AS sub, b AS prod, CASE WHEN k = 1 THEN 'main' ELSE 'leave' END AS type FROM c")
def pair_definitions(spark, sf_dir):
    folder = scratch_path(spark, "pairs")
    _parts(spark, sf_dir).select(F.concat_ws(" ", "id", "a", "b", F.when(F.col("k") == 1, "main").otherwise("leave")).alias("value")).write.text(folder)
    return flatfile.read_rpair_definitions(spark, folder)


@query("WITH " + _PART + " SELECT id, a || '_' || b AS name, id || ' R00001' AS reactions, CAST(k AS INTEGER) AS lhs_atom, CAST(p_size AS INTEGER) AS rhs_atom FROM c UNION ALL SELECT id, a || '_' || b, id || ' R00001', 7, 9 FROM c")
def pair_entries(spark, sf_dir):
    c = _parts(spark, sf_dir)
    align = F.concat(F.lit("1   "), F.col("k").cast("string"), F.lit(":C1a  "), F.col("p_size").cast("string"), F.lit(":C1b"))
    text = F.concat_ws("\n", _keyword("ENTRY", F.concat("id", F.lit("  RPair"))), _keyword("NAME", F.concat("a", F.lit("_"), "b")), _keyword("REACTION", F.concat("id", F.lit(" R00001"))), _keyword("ALIGN", F.lit("2")), _keyword("", align), _keyword("", F.lit("2   7:N1x  9:N1y")), F.lit("///"))
    folder = scratch_path(spark, "pair-entries")
    c.select(text.alias("value")).write.text(folder)
    found = flatfile.rpairs(flatfile.read_entries(spark, folder))
    return found.select("id", "name", F.array_join("reactions", " ").alias("reactions"), F.explode("align").alias("p")).select("id", "name", "reactions", F.col("p.a").alias("lhs_atom"), F.col("p.b").alias("rhs_atom"))


@query("WITH " + _PART + " SELECT id, id || '_' || k || '.mol' AS name FROM c WHERE k < 3")
def entry_files(spark, sf_dir):
    c = _parts(spark, sf_dir)
    names = c.where("k < 3").select(F.concat("id", F.lit("_"), F.col("k").cast("string"), F.lit(".mol")).alias("name"))
    return labels.graph_files(c.select("id"), names).select("id", "name")


# --- features, mappings, codes, records


@query("WITH " + sql.ORDER + """, d AS (SELECT a.g, a.id, k, string_agg(b.sym, '' ORDER BY b.sym) AS value FROM n a CROSS JOIN range(1, 3) r(k) JOIN n b ON b.g = a.g AND abs(b.id - a.id) <= k GROUP BY ALL)
SELECT CAST(g AS VARCHAR) AS mol, CAST(id AS INTEGER) AS atom, 'ATOM_DISTRIBUTION' AS feature, CAST(k AS INTEGER) AS context, value, count(*) AS times FROM d GROUP BY ALL""")
def feature_lines(spark, sf_dir):
    """Facts of context 1 are written, all of contexts 1 and 2 are offered, and only the new ones are added."""
    facts = materialise(messages.features(messages.atom_distribution(*adapters.order_graphs(spark, sf_dir), context=2), 1, 2), "facts")
    folder = scratch_path(spark, "feat")
    facts.where(F.col("value").contains(":1=")).write.text(folder, compression="gzip")
    sink.new_lines(facts, spark.read.text(folder)).write.mode("append").text(folder, compression="gzip")
    found = flatfile.read_features(spark, folder)
    return found.groupBy("mol", "atom", "feature", "context", "value").agg(F.count("*").alias("times"))


_MOLECULES = """
l AS (SELECT s_suppkey AS k, 'R' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS r FROM supplier),
m(s, a, d) AS (VALUES ('s', 0, 1), ('s', 1, 5), ('p', 0, 3), ('p', 1, 7), ('p', 2, 2)),
n AS (SELECT k, r, s, CASE s WHEN 's' THEN a ELSE a + 2 END AS id, ['A', 'B', 'F', 'H', 'M'][(k // d) % 5 + 1] AS lig FROM l, m),
rp AS (SELECT x.k, x.r, x.lig AS u, y.lig AS v, q.place, CASE q.place WHEN 2 THEN 1 ELSE (x.k + q.place) % 6 END AS chg
       FROM (VALUES (0, 0, 2), (1, 3, 1), (2, 0, 2), (3, 2, 4)) q(place, i, j) JOIN n x ON x.id = q.i JOIN n y ON y.k = x.k AND y.id = q.j),
t AS (SELECT k, u, v, place, chg FROM rp UNION ALL SELECT k, v, u, place, chg FROM rp),
tp AS (SELECT k, u, v, arg_min(chg, place) AS chg FROM t GROUP BY ALL)"""


def _supplier_reactions(spark, sf_dir):
    """Suppliers as reactions of two substrates and three products, whose names follow from the supplier's key: a file
    for each, and one table of pair definitions."""
    k = F.col("s_suppkey").cast("int")
    letter = lambda d: F.element_at(F.array(*map(F.lit, "ABFHM")), (F.floor(k / d) % 5 + 1).cast("int"))
    m = [letter(d) for d in (1, 5, 3, 7, 2)]
    name = F.concat(F.lit("R"), F.lpad(k.cast("string"), 5, "0"))
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey")
    files, pairs = scratch_path(spark, "reaction-files"), scratch_path(spark, "pair-definitions")
    text = F.concat_ws("\n", F.concat(name, F.lit("  1.1.1.1")), F.concat_ws(" ", *m[:2], F.lit("=>"), *m[2:]), F.lit("atoms follow"))
    tasks = max(spark.sparkContext.defaultParallelism, supplier.count() // 1000)  # a file takes its time and a key few bytes
    sink.write_files(supplier.repartition(tasks).select(F.concat(F.lit("R"), k.cast("string")).alias("name"), text.alias("text")), files)
    kinds = F.array(*map(F.lit, ["other", *reactions.EDGE_TYPES]))
    kind = lambda place: F.element_at(kinds, (k + place) % 6 + 1) if place != 2 else F.lit("main")
    lines = [F.concat_ws(" ", name, m[i], m[j], kind(place)) for place, (i, j) in enumerate([(0, 2), (3, 1), (0, 2), (2, 4)])]
    supplier.select(F.concat_ws("\n", *lines).alias("value")).write.text(pairs)
    return reactions.molecule_graph(flatfile.read_reaction_sides(spark, files), flatfile.read_rpair_definitions(spark, pairs, placed=True))


@query("WITH " + _MOLECULES + """ SELECT x.r AS g, CAST(x.id AS INTEGER) AS src, CAST(y.id AS INTEGER) AS dst, CAST(coalesce(tp.chg, 0) AS INTEGER) AS chg, x.lig AS a, y.lig AS b
FROM n x JOIN n y ON y.k = x.k AND y.id > x.id LEFT JOIN tp ON tp.k = x.k AND tp.u = x.lig AND tp.v = y.lig WHERE tp.chg IS NOT NULL OR x.s = y.s""")
def reaction_of_molecules(spark, sf_dir):
    """Reactions read from a file each, as graphs of the molecules that they name."""
    nodes, edges = _supplier_reactions(spark, sf_dir)
    a, b = (nodes.select("g", F.col("id").alias(end), F.col("sym").alias(n)) for end, n in (("src", "a"), ("dst", "b")))
    return edges.join(a, ["g", "src"]).join(b, ["g", "dst"]).select("g", "src", "dst", "chg", "a", "b")


def _feature_facts_sql() -> str:
    """Orders are chains, so neighbours are the lines before and after, and a chain of m lines has contexts 0 to m."""
    turn = "SELECT n.g, n.id, coalesce(sum(m.v), 0) AS v FROM n LEFT JOIN adj ON adj.g = n.g AND adj.src = n.id LEFT JOIN m{} m ON m.g = adj.g AND m.id = adj.dst GROUP BY n.g, n.id"
    morgan = "".join(f", m{k} AS ({turn.format(k - 1)})" for k in (1, 2, 3))
    levels = " UNION ALL ".join(f"SELECT g, id, 'MORGAN' AS feature, {k} AS context, CAST(CAST(v AS BIGINT) AS VARCHAR) AS value FROM m{k}" for k in range(4))
    spell = lambda where: f"string_agg(b.sym, '' ORDER BY b.sym) FILTER (WHERE {where})"
    return "WITH " + sql.ORDER + f""", sz AS (SELECT g, count(*) AS m FROM n GROUP BY g), m0 AS (SELECT g, id, 1 AS v FROM n){morgan},
ad AS (SELECT a.g, a.id, k, {spell("true")} AS own, coalesce({spell("b.id <> a.id")}, '') AS others, {spell("b.id < a.id")} AS l, {spell("b.id > a.id")} AS r
       FROM n a JOIN sz ON sz.g = a.g JOIN range(0, 4) t(k) ON k <= m JOIN n b ON b.g = a.g AND abs(b.id - a.id) <= k GROUP BY a.g, a.id, k),
br AS (SELECT *, coalesce(',' || (id - 1) || '=' || l, '') || coalesce(',' || (id + 1) || '=' || r, '') || ')' AS sides FROM ad),
b AS (SELECT e.g, src, dst, least(x.sym, y.sym) || chg || greatest(x.sym, y.sym) AS bond FROM e JOIN n x ON x.g = e.g AND x.id = src JOIN n y ON y.g = e.g AND y.id = dst),
bd AS (SELECT a.g, a.id, k, string_agg(bond, '' ORDER BY bond) AS v FROM n a CROSS JOIN range(1, 4) t(k) JOIN b ON b.g = a.g AND least(abs(src - a.id), abs(dst - a.id)) < k GROUP BY ALL),
ws AS (SELECT a.g, a.id, k, sum(y.id - x.id) AS v FROM n a CROSS JOIN range(1, 4) t(k) JOIN n x ON x.g = a.g AND abs(x.id - a.id) <= k JOIN n y ON y.g = a.g AND abs(y.id - a.id) <= k AND x.id < y.id GROUP BY ALL),
wi AS (SELECT n.g, n.id, t.k, CAST(CAST(coalesce(v, 0) AS BIGINT) AS VARCHAR) AS v FROM n CROSS JOIN range(1, 4) t(k) LEFT JOIN ws ON ws.g = n.g AND ws.id = n.id AND ws.k = t.k),
f AS (SELECT g, id, 'ATOM_DISTRIBUTION' AS feature, k AS context, '(' || own || sides AS value FROM br UNION ALL SELECT g, id, 'ATOM_DISTRIBUTION_EXCLUDE', k, '(' || others || sides FROM br
      UNION ALL SELECT g, id, 'BOND_DISTRIBUTION', k, v FROM bd UNION ALL SELECT g, id, 'WIENER', k, v FROM wi UNION ALL {levels})
SELECT g, CAST(id AS INTEGER) AS id, feature, CAST(context AS INTEGER) AS context, value FROM f"""


@query(_feature_facts_sql())
def feature_facts(spark, sf_dir):
    """Every feature but rings, which chains have not, in contexts 0 to 3."""
    nodes, edges = adapters.order_graphs(spark, sf_dir)
    return messages.feature_facts(nodes, edges, 0, 3, messages.FEATURES[:-1])


@query("WITH " + sql.RING + """, sz AS (SELECT g, count(*) AS m FROM n GROUP BY g),
p AS (SELECT a.g, a.id, m, k, b.sym, (b.id - a.id - 1 + m) % m + 1 AS ahead, (a.id - b.id - 1 + m) % m + 1 AS behind FROM n a JOIN sz ON sz.g = a.g JOIN range(0, 6) t(k) ON k <= m + 1 JOIN n b ON b.g = a.g),
d AS (SELECT g, id, k, (id + 1) % m AS nx, (id - 1 + m) % m AS pv, string_agg(sym, '' ORDER BY sym) FILTER (WHERE ahead = m OR least(ahead, behind) <= k) AS own,
             string_agg(sym, '' ORDER BY sym) FILTER (WHERE ahead <= k) AS f, string_agg(sym, '' ORDER BY sym) FILTER (WHERE behind <= k) AS b FROM p GROUP BY g, id, m, k)
SELECT CAST(g AS VARCHAR) AS mol, CAST(id AS INTEGER) AS atom, 'ATOM_DISTRIBUTION' AS feature, CAST(k AS INTEGER) AS context, own AS value,
       CASE WHEN f IS NULL THEN '' WHEN nx < pv THEN nx || '=' || f || ' ' || pv || '=' || b ELSE pv || '=' || b || ' ' || nx || '=' || f END AS sides FROM d
UNION ALL SELECT CAST(n.g AS VARCHAR), CAST(id AS INTEGER), 'RING', CAST(k AS INTEGER), CASE WHEN k = m THEN 'True' ELSE 'False' END, '' FROM n JOIN sz ON sz.g = n.g CROSS JOIN range(0, 6) t(k)""")
def ring_feature_file(spark, sf_dir):
    """Facts of closed orders, with what each neighbour tells, written as lines and read back."""
    facts = messages.feature_facts(*adapters.order_graphs(spark, sf_dir, closed=True), 0, 5, ("ATOM_DISTRIBUTION", "RING"))
    folder = scratch_path(spark, "facts")
    messages.fact_lines(facts).write.text(folder, compression="snappy")
    found = flatfile.read_features(spark, folder, skip=())
    sides = F.transform(F.sort_array(F.map_entries("dirs")), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"]))
    return found.select("mol", "atom", "feature", "context", "value", F.when(F.size("dirs") > 0, F.array_join(sides, " ")).otherwise("").alias("sides"))


_TURNED = f"""l AS (SELECT l_orderkey AS reaction, row_number() OVER (PARTITION BY l_orderkey ORDER BY {sql._LINES}) - 1 AS id, l_returnflag AS sym, l_partkey FROM lineitem),
im AS (SELECT reaction, id AS lhs_atom, row_number() OVER (PARTITION BY reaction ORDER BY l_partkey, id) - 1 AS rhs_atom, sym FROM l)"""


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(reaction, lhs_atom, rhs_atom, sym): each line of an order goes to its place in the order of part keys."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", *adapters.LINE_ORDER)
    own = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*adapters.LINE_ORDER)) - 1
    rows = lines.select(F.col("l_orderkey").alias("reaction"), own.alias("lhs_atom"), F.col("l_returnflag").alias("sym"), "l_partkey")
    return rows.select("reaction", "lhs_atom", (F.row_number().over(Window.partitionBy("reaction").orderBy("l_partkey", "lhs_atom")) - 1).alias("rhs_atom"), "sym")


#: Edges of both sides, the chain of ids, under the mapping.
_CHANGES = "WITH " + _TURNED + """, bk AS (SELECT reaction, rhs_atom AS b, lhs_atom AS a FROM im),
old AS (SELECT reaction, lhs_atom AS a, lhs_atom + 1 AS b FROM im WHERE (reaction, lhs_atom + 1) IN (SELECT (reaction, lhs_atom) FROM im)),
new AS (SELECT x.reaction, least(x.a, y.a) AS a, greatest(x.a, y.a) AS b FROM bk x JOIN bk y ON y.reaction = x.reaction AND y.b = x.b + 1),
ch AS (SELECT coalesce(o.reaction, w.reaction) AS reaction, coalesce(o.a, w.a) AS a, coalesce(o.b, w.b) AS b, CASE WHEN o.a IS NULL THEN 0 ELSE 1 END AS old, CASE WHEN w.a IS NULL THEN 0 ELSE 1 END AS new
       FROM old o FULL OUTER JOIN new w ON o.reaction = w.reaction AND o.a = w.a AND o.b = w.b)"""


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _images(spark, sf_dir)
    last = images.groupBy("reaction").agg(F.max("lhs_atom").alias("last")).where("last > 0")
    chain = last.select("reaction", F.explode(F.sequence(F.lit(0), F.col("last") - 1)).alias("a")).select("reaction", "a", (F.col("a") + 1).alias("b"), F.lit(1).alias("type"))
    return mapping.reaction_graph(chain, chain, images)


@query(_CHANGES + " SELECT reaction, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, old, new, new - old AS chg FROM ch")
def mapped_reaction_graph(spark, sf_dir):
    return _changes(spark, sf_dir).select("reaction", "a", "b", "old", "new", "chg")


@query("WITH " + _TURNED + " SELECT CAST(reaction AS VARCHAR) AS reaction, CAST(lhs_atom AS INTEGER) AS lhs_atom, CAST(rhs_atom AS INTEGER) AS rhs_atom FROM im")
def mapping_reports(spark, sf_dir):
    """Reports are written, a file for each task, and their atom tables read."""
    images = _images(spark, sf_dir)
    heads = images.groupBy("reaction").agg(F.count("*").alias("cost")).withColumn("equation", F.lit("A <=> B"))
    report = sink.mapping_report(heads, images.select("reaction", "lhs_atom", F.col("sym").alias("lhs_sym"), "rhs_atom", F.col("sym").alias("rhs_sym")), _changes(spark, sf_dir))
    folder = scratch_path(spark, "reports")
    report.select("value").write.text(folder)
    return flatfile.read_mapping_report(spark, folder)


@query("WITH " + _TURNED + " SELECT reaction, count(*) FILTER (rhs_atom % 2 = 0) AS mapped, count(*) AS total, string_agg(CAST(lhs_atom AS VARCHAR), ' ' ORDER BY lhs_atom) FILTER (rhs_atom % 2 = 1) AS unmapped FROM im GROUP BY reaction")
def mapping_completeness(spark, sf_dir):
    """Of a mapping without its images at odd places: how much is mapped, and which atoms are not."""
    images = _images(spark, sf_dir)
    some = images.where("rhs_atom % 2 = 0")
    sides = images.groupBy("reaction").agg(F.collect_list("sym").alias("syms1"))
    nodes = images.select("reaction", F.col("lhs_atom").alias("id"))
    left = mapping.unmapped(nodes, some).groupBy("reaction").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), " ").alias("unmapped"))
    return mapping.completeness(sides, some).join(left, "reaction", "left").select("reaction", "mapped", "total", "unmapped")


@query("WITH t AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS row_no, p_size FROM part), u AS (SELECT *, sum(CASE WHEN p_size % 4 > 0 THEN 1 ELSE 0 END) OVER (ORDER BY row_no) AS n FROM t) SELECT CAST(row_no AS INTEGER) AS row_no, (p_size % 4) || ' ' || p_partkey || ' -1' AS codes, p_size % 4 > 0 AS used, CASE WHEN p_size % 4 > 0 THEN n % 2 = 1 END AS forward FROM u")
def code_rows(spark, sf_dir):
    """Files of lines in the order of part keys: rows alternate between forward and backward by their place."""
    c = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.concat_ws(" ", (F.col("p_size") % 4).cast("string"), F.col("p_partkey").cast("string"), F.lit("-1")).alias("value"))
    folder = scratch_path(spark, "codes")
    c.repartitionByRange("p_partkey").sortWithinPartitions("p_partkey").select("value").write.text(folder)
    return flatfile.read_code_table(spark, folder).select("row_no", F.array_join(F.transform("codes", lambda x: x.cast("string")), " ").alias("codes"), "used", "forward")


@query("WITH " + _MOL + " SELECT tag, f, count(*) AS n FROM (SELECT 'ATOM' AS tag, id || ' ' || sym AS f FROM m UNION ALL SELECT 'BOND', src || ' ' || dst || ' ' || type FROM b) GROUP BY tag, f")
def tagged_records(spark, sf_dir):
    nodes, edges = _molecules(spark, sf_dir)
    folder = scratch_path(spark, "tagged")
    nodes.select(F.concat_ws(" ", F.lit("ATOM "), "id", "sym").alias("value")).union(edges.select(F.concat_ws("  ", F.lit("BOND"), "src", "dst", "type"))).write.text(folder)
    return flatfile.read_tagged(spark, folder).groupBy("tag", F.array_join("fields", " ").alias("f")).agg(F.count("*").alias("n"))


@query("SELECT CAST(s_nationkey AS INTEGER) AS src, CAST(s_suppkey AS INTEGER) AS dst FROM supplier")
def edge_list(spark, sf_dir):
    folder = scratch_path(spark, "edges")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    rows.select(F.concat_ws(" ", "s_nationkey", "s_suppkey").alias("value")).union(spark.createDataFrame([("# no edge",)], "value string")).write.text(folder)
    return flatfile.read_edge_list(spark, folder)


# --- trees, frequencies, features, kernels as text

_NP = "WITH RECURSIVE " + sql.paths(sql.NATION, 4)


def _nation_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.path_table(*adapters.nation_graph(spark, sf_dir), max_depth=4)


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("g"), F.col("n_name").alias("name"))


@query("WITH " + sql.NATION + """, k AS (SELECT g, count(*) AS k FROM n GROUP BY g), t AS (SELECT n.g, 1 + least(3, n.id) + least(3, k - 1 - n.id) AS size FROM n JOIN k USING (g))
SELECT n_name || CASE WHEN g % 2 = 0 THEN '_f_' ELSE '_b_' END AS title, count(*) AS trees, CAST(sum(size) AS BIGINT) AS nodes, false AS suspicious FROM t JOIN nation ON n_nationkey = g GROUP BY ALL""")
def sequence_scan(spark, sf_dir):
    """Tries of nations as sequence files, one a nation, named by direction; read as titles and forests."""
    nodes, edges = adapters.nation_graph(spark, sf_dir)
    named = _names(spark, sf_dir).withColumn("direction", F.when(F.col("g") % 2 == 0, 1).otherwise(-1))
    folder = scratch_path(spark, "seqs")
    sink.write_files(sink.sequence_files(sink.sequences(nodes, edges, 4), named), folder)
    titles = trees.read_titles(spark, folder)
    found = trees.read_forest(spark, folder).groupBy("entry").agg(F.count_distinct("tree").alias("trees"), F.count("*").alias("nodes"))
    return found.join(titles, "entry").select("title", "trees", "nodes", "suspicious")


@query(_NP + " SELECT path, n_name AS graph, freq FROM p JOIN nation ON n_nationkey = g")
def frequency_scan(spark, sf_dir):
    """Frequencies under names, written as lines and read again."""
    folder = scratch_path(spark, "freqs")
    sink.frequencies(_nation_paths(spark, sf_dir), _names(spark, sf_dir)).write.text(folder)
    return trees.read_frequencies(spark, folder)


@query("WITH s AS (SELECT DISTINCT c_mktsegment[1:1] AS sym FROM customer) SELECT lower(sym) AS code, '(' || sym AS label FROM s")
def symbol_map(spark, sf_dir):
    folder = scratch_path(spark, "symbols")
    syms = adapters.nation_graph(spark, sf_dir)[0].select("sym").distinct()
    syms.select(F.concat(F.lit("otoi['"), F.lower("sym"), F.lit("'] = \"("), "sym", F.lit("\";")).alias("value")).write.text(folder)
    return trees.read_symbols(spark, folder)


_TRIPLES = _NP + """, f AS (SELECT path, len, row_number() OVER (ORDER BY len, path) AS path_id FROM (SELECT DISTINCT path, len FROM p)),
q AS (SELECT g, row_number() OVER (ORDER BY g) AS graph_id FROM (SELECT DISTINCT g FROM p)), t AS (SELECT path_id, graph_id, freq, f.len, contains(path, '{') OR contains(path, '[') AS is_core FROM p JOIN f USING (path) JOIN q USING (g))"""


@query(_TRIPLES + " SELECT CAST(len AS INTEGER) AS len, is_core, graph_id AS path_id, path_id AS graph_id, freq FROM t")
def triple_files(spark, sf_dir):
    """Sparse triples by length and kind, read back from each folder and transposed."""
    table = _nation_paths(spark, sf_dir)
    folder = scratch_path(spark, "mtl")
    sink.write_triples(paths.feature_triples(table), paths.feature_ids(table), folder)
    found = spark.read.option("sep", " ").schema("path_id long, graph_id long, freq long, len int, is_core boolean").csv(folder)
    kind = found.select("path_id", "len", "is_core").distinct()
    turned = flatfile.transpose(found.select("path_id", "graph_id", "freq"))
    return turned.join(kind.withColumnRenamed("path_id", "graph_id"), "graph_id").select("len", "is_core", "path_id", "graph_id", "freq")


@query(_TRIPLES + " SELECT max(path_id) || ' ' || max(graph_id) || ' 0' AS value, count(*) AS n, CAST(sum(freq) AS BIGINT) AS freq FROM t")
def triple_header(spark, sf_dir):
    """One file with its line of sizes, which the reader leaves out."""
    triples = paths.feature_triples(_nation_paths(spark, sf_dir))
    folder = scratch_path(spark, "mtl-all")
    head = sink.triple_header(triples)
    head.union(triples.select(F.concat_ws(" ", "path_id", "graph_id", "freq"))).write.text(folder)
    return head.crossJoin(flatfile.read_triples(spark, folder).agg(F.count("*").alias("n"), F.sum("freq").alias("freq")))


_ASKED = ["(A", "(A(B", "(A[B", "(B{A", "(F(F", "(H"]


@query(_NP + " SELECT g, concat_ws(' ', " + ", ".join(f"sum(CASE WHEN path = '{p}' THEN freq ELSE 0 END)::BIGINT" for p in _ASKED) + ") AS value FROM p GROUP BY g")
def dense_lines(spark, sf_dir):
    return sink.dense_features(_nation_paths(spark, sf_dir), _ASKED)


def _kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = _nation_paths(spark, sf_dir).select("g", F.col("path").alias("feature"), F.col("freq").alias("n"))
    return kernels.normalized(kernels.feature_kernel(features))


@query(_NP + """, k AS (SELECT a.g AS i, b.g AS j, CAST(sum(a.freq * b.freq) AS DOUBLE) AS k FROM p a JOIN p b ON a.path = b.path AND b.g <= a.g GROUP BY a.g, b.g),
z AS (SELECT k.i, k.j, k.k / sqrt(a.k * b.k) AS k FROM k JOIN k a ON a.i = k.i AND a.j = k.i JOIN k b ON b.i = k.j AND b.j = k.j)
SELECT i, string_agg(printf('%.5E', k), chr(9) ORDER BY j) AS value FROM z WHERE i BETWEEN 5 AND 17 GROUP BY i""")
def kernel_lines(spark, sf_dir):
    return sink.kernel_lines(_kernel(spark, sf_dir), 5, 17)


@query("SELECT 'paths' AS kind, count(*) AS files, min(name) AS least, max(name) AS greatest FROM (SELECT concat_ws('_', paths, l, '90', dp, type, power) AS name FROM (VALUES ('allpaths'), ('corepaths')) a(paths), (VALUES (15), (50)) b(l), (VALUES ('float'), ('ind')) c(dp), (VALUES ('f'), ('fb'), ('max'), ('tensor')) d(type), (VALUES (1), (2)) e(power))")
def kernel_files(spark, sf_dir):
    """The 64 kernels as files of their names; here the names that were written."""
    table = sink.kernel_name(kernels.path_kernels(_nation_paths(spark, sf_dir)))
    folder = scratch_path(spark, "kernels")
    sink.write_files(sink.kernel_text(table), folder)
    found = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    return found.agg(F.lit("paths").alias("kind"), F.count("*").alias("files"), F.min("name").alias("least"), F.max("name").alias("greatest"))


@query("SELECT doc_id AS item, " + " || ' ' || ".join(f"CAST(max(CASE WHEN lang = '{v}' THEN 1 ELSE 0 END) AS VARCHAR)" for v in ("de", "en", "es", "fr")) + " AS value FROM documents GROUP BY doc_id")
def label_lines(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("item"), F.col("lang").alias("label"))
    return sink.labels_matrix(docs, ["de", "en", "es", "fr"])


@query("WITH " + sql.ORDER + """, a AS (SELECT g, string_agg('  n' || id || ' [label="' || sym || '"];', chr(10) ORDER BY id) AS a FROM n GROUP BY g),
l AS (SELECT g, string_agg('  n' || src || ' -- n' || dst || CASE chg WHEN 1 THEN ' [label="+"]' WHEN -1 THEN ' [label="-"]' ELSE '' END || ';', chr(10) ORDER BY src, dst) AS l FROM e GROUP BY g)
SELECT a.g, 'graph g' || a.g || ' {' || chr(10) || a || coalesce(chr(10) || l, '') || chr(10) || '}' AS value FROM a LEFT JOIN l USING (g)""")
def graph_drawings(spark, sf_dir):
    return sink.dot(*adapters.order_graph(spark, sf_dir))


@query("WITH " + sql.ORDER + " SELECT '1 ' || a.g || ' ' || a.src || ' ' || a.dst || ' ' || ascii(n.sym) AS value, count(*) AS n FROM adj a JOIN n ON n.g = a.g AND n.id = a.src GROUP BY ALL")
def message_lines(spark, sf_dir):
    nodes, edges = adapters.order_graph(spark, sf_dir)
    sent = messages.messages(nodes, edges, 1, nodes.select("g", "id", F.ascii("sym").cast("long").alias("m")))
    folder = scratch_path(spark, "messages")
    sink.message_lines(sent).write.text(folder)
    return spark.read.text(folder).groupBy("value").agg(F.count("*").alias("n"))
