"""Registered queries of further kernels, structures, column functions and the built text index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pathloom.functions import columns, matrices
from pathloom.operators import adapters, graphs, mapping, paths, reactions, subgraphs, textindex, walks
from pathloom.plans import sql
from pathloom.plans.registry import query, rounded
from pathloom.scratch import built_once, scratch_path
from pathloom.sinks import text as sink
from pathloom.sources import trees

_P = "WITH RECURSIVE " + sql.paths(sql.ORDER)
_NP = "WITH RECURSIVE " + sql.paths(sql.NATION, 4)

# --- paths


@query(_P + " SELECT len, count(*) AS n, CAST(sum(freq) AS BIGINT) AS freq FROM p WHERE len BETWEEN 3 AND 5 GROUP BY len")
def path_length_range(spark, sf_dir):
    found = paths.of_length(paths.path_table(*adapters.order_graphs(spark, sf_dir)), 3, 5)
    return found.groupBy("len").agg(F.count("*").alias("n"), F.sum("freq").alias("freq"))


@query("WITH RECURSIVE " + sql.paths(sql.RING, 4) + " SELECT path, len, count(*) AS n_graphs, CAST(sum(freq) AS BIGINT) AS total FROM p GROUP BY path, len")
def path_joins(spark, sf_dir):
    """Paths of rings by one join a length, as for graphs too large for a task."""
    return paths.shared_paths(paths.path_table(*adapters.order_ring(spark, sf_dir), max_depth=4, strategy="joins"), 0)


@query(_NP + " SELECT CAST(len AS INTEGER) AS len, count(*) AS n, count(DISTINCT path) AS n_paths, CAST(sum(freq) AS BIGINT) AS freq FROM p GROUP BY len")
def saved_index(spark, sf_dir):
    """The index of nations, saved, checked for its version and read a length at a time."""
    folder = scratch_path(spark, "index")
    sink.save_index(paths.path_table(*adapters.nation_graph(spark, sf_dir), max_depth=4), folder)
    found = trees.read_index(spark, folder)
    return found.groupBy("len").agg(F.count("*").alias("n"), F.count_distinct("path").alias("n_paths"), F.sum("freq").alias("freq"))


# --- kernels (graphs are nations)


@query(_NP + " SELECT a.g AS i, b.g AS j, round(sum(pow(0.9, a.len) * a.freq * b.freq), 6) AS k FROM p a JOIN p b ON a.path = b.path AND b.g <= a.g GROUP BY a.g, b.g")
def path_pair_kernel(spark, sf_dir):
    return rounded(walks.path_pair_kernel(paths.path_table(*adapters.nation_graph(spark, sf_dir), max_depth=4), 0.9), "k")


_PROBABILITIES = """,
sz AS (SELECT g, count(*) AS c FROM n GROUP BY g), dg AS (SELECT n.g, n.id, count(a.dst) AS d FROM n LEFT JOIN adj a ON a.g = n.g AND a.src = n.id GROUP BY n.g, n.id),
pw AS (SELECT pn.*, CASE WHEN x.d > 0 THEN 0.2 ELSE 1.0 END * CASE WHEN y.d > 0 THEN 0.2 ELSE 1.0 END AS e, 0.64 / (x.d * y.d) AS w, 1.0 / (p.c * q.c) AS s, x.d AS d1, y.d AS d2
       FROM pn JOIN dg x ON x.g = i AND x.id = a1 JOIN dg y ON y.g = j AND y.id = a2 JOIN sz p ON p.g = i JOIN sz q ON q.g = j)"""


@query("WITH " + sql.NATION + sql.PRODUCT + _PROBABILITIES + sql.walk_levels("SELECT i, j, a1, a2, e::DOUBLE AS f FROM pw", "any_value(pw.w)", 4) + """,
lv AS (SELECT fs.i, fs.j, fs.len, sum(f * s) AS k FROM fs JOIN pw ON pw.i = fs.i AND pw.j = fs.j AND pw.a1 = fs.a1 AND pw.a2 = fs.a2 GROUP BY fs.i, fs.j, fs.len)
SELECT l.i, l.j, round(sum(CASE WHEN a.k * b.k > 0 THEN l.k / sqrt(a.k * b.k) ELSE 0 END), 6) AS k FROM lv l JOIN lv a ON a.i = l.i AND a.j = l.i AND a.len = l.len JOIN lv b ON b.i = l.j AND b.j = l.j AND b.len = l.len GROUP BY l.i, l.j""")
def partially_normalized_kernel(spark, sf_dir):
    nodes, edges = adapters.nation_graph(spark, sf_dir)
    return rounded(walks.partially_normalized(walks.marginal_levels(nodes, edges, walks.constant_weights(nodes), 0.8, 4)), "k")


@query("WITH " + sql.NATION + sql.PRODUCT + _PROBABILITIES + """,
en AS (SELECT g, id, d, CASE WHEN d > 1 THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END AS e FROM dg),
m2 AS (SELECT pe.*, pw.s * pw.w AS m FROM pe JOIN pw ON pw.i = pe.i AND pw.j = pe.j AND pw.a1 = pe.a1 AND pw.a2 = pe.a2),
m3 AS (SELECT x.i, x.j, x.a1, x.a2, x.b1, x.b2, sum(p.m * 0.64 / ((u.d - 1) * (v.d - 1))) AS m FROM pe x JOIN m2 p ON p.i = x.i AND p.j = x.j AND p.b1 = x.a1 AND p.b2 = x.a2
       JOIN en u ON u.g = x.i AND u.id = x.a1 JOIN en v ON v.g = x.j AND v.id = x.a2 WHERE p.a1 <> x.b1 AND p.a2 <> x.b2 GROUP BY ALL),
m4 AS (SELECT x.i, x.j, x.a1, x.a2, x.b1, x.b2, sum(p.m * 0.64 / ((u.d - 1) * (v.d - 1))) AS m FROM pe x JOIN m3 p ON p.i = x.i AND p.j = x.j AND p.b1 = x.a1 AND p.b2 = x.a2
       JOIN en u ON u.g = x.i AND u.id = x.a1 JOIN en v ON v.g = x.j AND v.id = x.a2 WHERE p.a1 <> x.b1 AND p.a2 <> x.b2 GROUP BY ALL),
f AS (SELECT i, j, s * e AS f FROM pw UNION ALL SELECT m.i, m.j, m.m * u.e * v.e FROM (SELECT * FROM m2 UNION ALL SELECT * FROM m3 UNION ALL SELECT * FROM m4) m JOIN en u ON u.g = m.i AND u.id = m.b1 JOIN en v ON v.g = m.j AND v.id = m.b2)
SELECT i, j, round(CAST(sum(f) AS DOUBLE), 8) AS k FROM f GROUP BY i, j""")
def second_order_kernel(spark, sf_dir):
    nodes, edges = adapters.nation_graph(spark, sf_dir)
    return rounded(walks.nontottering_marginal_kernel(nodes, edges, walks.constant_weights(nodes), 0.8, 4), "k", digits=8)


def _diffusion(terms: int = 26, beta: float = 0.5) -> str:
    """exp(beta (A - D)) from each end of a changed edge, as a power series."""
    out = "WITH " + sql.ORDER + """,
dg AS (SELECT n.g, n.id, count(a.dst) AS d FROM n LEFT JOIN adj a ON a.g = n.g AND a.src = n.id GROUP BY n.g, n.id),
core AS (SELECT g, src AS c FROM e WHERE chg <> 0 UNION SELECT g, dst FROM e WHERE chg <> 0),
h AS (SELECT g, src AS a, dst AS b, 1.0::DOUBLE AS v FROM adj UNION ALL SELECT g, id, id, -d FROM dg),
x0 AS MATERIALIZED (SELECT g, c, c AS i, 1.0::DOUBLE AS v FROM core)"""
    for k in range(1, terms):
        out += f",\nx{k} AS MATERIALIZED (SELECT x.g, x.c, h.b AS i, sum(x.v * h.v) * {beta} / {k} AS v FROM x{k - 1} x JOIN h ON h.g = x.g AND h.a = x.i GROUP BY ALL)"
    every = " UNION ALL ".join(f"SELECT * FROM x{k}" for k in range(terms))
    return out + f",\nt AS (SELECT g, c, i, sum(v) AS v FROM ({every}) GROUP BY ALL) SELECT n.g, CAST(n.id AS INTEGER) AS id, round(coalesce(max(t.v), 0), 6) AS w FROM n LEFT JOIN t ON t.g = n.g AND t.i = n.id GROUP BY n.g, n.id"


@query(_diffusion())
def diffusion_weights(spark, sf_dir):
    return rounded(matrices.diffusion_weights(*adapters.order_graphs(spark, sf_dir), beta=0.5), "w")


_LIGAND = """
x AS (SELECT CAST(c_nationkey AS BIGINT) AS reaction, 's' AS side, c_mktsegment[1:1] AS ligand FROM customer
      UNION SELECT CAST(s_nationkey AS BIGINT), 'p', ['A', 'B', 'F', 'H', 'M'][s_suppkey % 5 + 1] FROM supplier),
own AS (SELECT reaction, side, ligand, row_number() OVER (PARTITION BY reaction ORDER BY side, ligand) - 1 AS id FROM x),
rp AS (SELECT CAST(s_nationkey AS BIGINT) AS reaction, ['A', 'B', 'F', 'H', 'M'][s_suppkey % 5 + 1] AS a, ['A', 'B', 'F', 'H', 'M'][(s_suppkey // 5) % 5 + 1] AS b, s_suppkey % 6 AS chg FROM supplier),
both_ AS (SELECT * FROM rp UNION ALL SELECT reaction, b, a, chg FROM rp),
jn AS (SELECT q.reaction, u.id AS src, v.id AS dst, CAST(max(q.chg) AS INTEGER) AS chg FROM both_ q JOIN own u ON u.reaction = q.reaction AND u.ligand = q.a AND u.side = 's' JOIN own v ON v.reaction = q.reaction AND v.ligand = q.b AND v.side = 'p' GROUP BY ALL),
e AS (SELECT reaction AS g, src, dst, chg FROM jn UNION ALL SELECT u.reaction, u.id, v.id, 0 FROM own u JOIN own v ON v.reaction = u.reaction AND v.side = u.side AND v.id > u.id),
n AS (SELECT reaction AS g, id, ligand AS sym FROM own)"""


def _ligand_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations as reactions of segments; the keys of suppliers pair them, by types of five names and one unknown."""
    letter = lambda c: F.element_at(F.array(*map(F.lit, "ABFHM")), (c % 5 + 1).cast("int"))
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_nationkey", "s_suppkey")
    names = F.element_at(F.array(*map(F.lit, ["other", *reactions.EDGE_TYPES])), (F.col("s_suppkey") % 6 + 1).cast("int"))
    pairs = supplier.select(F.col("s_nationkey").cast("long").alias("reaction"), letter(F.col("s_suppkey")).alias("sub"), letter(F.floor(F.col("s_suppkey") / 5)).alias("prod"), names.alias("type"))
    return reactions.ligand_graph(adapters.segment_reaction(spark, sf_dir), pairs)


@query("WITH " + _LIGAND + " SELECT e.g, CAST(src AS INTEGER) AS src, CAST(dst AS INTEGER) AS dst, chg, a.sym AS a, b.sym AS b FROM e JOIN n a ON a.g = e.g AND a.id = src JOIN n b ON b.g = e.g AND b.id = dst")
def ligand_graph(spark, sf_dir):
    nodes, edges = _ligand_graph(spark, sf_dir)
    a, b = (nodes.select("g", F.col("id").alias(end), F.col("sym").alias(n)) for end, n in (("src", "a"), ("dst", "b")))
    return edges.join(a, ["g", "src"]).join(b, ["g", "dst"]).select("g", "src", "dst", "chg", "a", "b")


@query("WITH " + _LIGAND + """, adj AS (SELECT * FROM e UNION ALL SELECT g, dst, src, chg FROM e),
mk AS (SELECT a, b, 1.0::DOUBLE / (1 + abs(ascii(a) - ascii(b))) AS k FROM (SELECT unnest(['A', 'B', 'F', 'H', 'M']) AS a), (SELECT unnest(['A', 'B', 'F', 'H', 'M']) AS b)),
sz AS (SELECT g, count(*) AS c FROM n GROUP BY g), dg AS (SELECT n.g, n.id, n.sym, count(a.dst) AS d FROM n LEFT JOIN adj a ON a.g = n.g AND a.src = n.id GROUP BY ALL),
ow AS (SELECT u.g AS i, v.g AS j, u.id AS a1, v.id AS a2, 1.0::DOUBLE / (p.c * q.c) AS ps, CASE WHEN u.d > 0 THEN 0.2::DOUBLE ELSE 1 END * CASE WHEN v.d > 0 THEN 0.2::DOUBLE ELSE 1 END AS pe, u.d AS d1, v.d AS d2, mk.k AS w
       FROM dg u JOIN mk ON mk.a = u.sym JOIN dg v ON v.sym = mk.b AND v.g <= u.g JOIN sz p ON p.g = u.g JOIN sz q ON q.g = v.g),
st AS (SELECT x.g AS i, y.g AS j, x.src AS a1, y.src AS a2, x.dst AS b1, y.dst AS b2 FROM adj x JOIN adj y ON x.chg = y.chg AND y.g <= x.g),
f1 AS (SELECT i, j, a1, a2, pe * w AS f FROM ow),
f2 AS (SELECT o.i, o.j, o.a1, o.a2, any_value(o.w) * sum(0.64 / (o.d1 * o.d2) * f.f) AS f FROM st JOIN f1 f ON f.i = st.i AND f.j = st.j AND f.a1 = st.b1 AND f.a2 = st.b2 JOIN ow o ON o.i = st.i AND o.j = st.j AND o.a1 = st.a1 AND o.a2 = st.a2 GROUP BY o.i, o.j, o.a1, o.a2),
f3 AS (SELECT o.i, o.j, o.a1, o.a2, any_value(o.w) * sum(0.64 / (o.d1 * o.d2) * f.f) AS f FROM st JOIN f2 f ON f.i = st.i AND f.j = st.j AND f.a1 = st.b1 AND f.a2 = st.b2 JOIN ow o ON o.i = st.i AND o.j = st.j AND o.a1 = st.a1 AND o.a2 = st.a2 GROUP BY o.i, o.j, o.a1, o.a2)
SELECT o.i, o.j, round(sum(o.ps * f.f), 6) AS k FROM (SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3) f JOIN ow o ON o.i = f.i AND o.j = f.j AND o.a1 = f.a1 AND o.a2 = f.a2 GROUP BY o.i, o.j""")
def reaction_graph_kernel(spark, sf_dir):
    letters = "ABFHM"
    alike = spark.createDataFrame([(a, b, 1.0 / (1 + abs(ord(a) - ord(b)))) for a in letters for b in letters], "a string, b string, k double")
    return rounded(walks.reaction_graph_kernel(*_ligand_graph(spark, sf_dir), alike, 0.8, 3), "k")


# --- structures


@query("WITH " + sql.ORDER + ", cut AS (SELECT n.g, n.id, coalesce(sum(abs(e.chg)) OVER (PARTITION BY n.g ORDER BY n.id), 0) AS part FROM n LEFT JOIN e ON e.g = n.g AND e.dst = n.id) SELECT g, CAST(id AS INTEGER) AS id, CAST(min(id) OVER (PARTITION BY g, part) AS INTEGER) AS piece FROM cut")
def graph_pieces(spark, sf_dir):
    """What is left of an order when its changed edges are taken out."""
    nodes, edges = adapters.order_graph(spark, sf_dir)
    return graphs.pieces(nodes, edges.where("chg = 0"))


@query("WITH " + sql.RING + ", size AS (SELECT g, count(*) AS k FROM n GROUP BY g) SELECT g, CASE WHEN k = 3 THEN 3 ELSE 2 END AS size, CASE WHEN k = 3 THEN 1 ELSE k END AS n FROM size")
def clique_sizes(spark, sf_dir):
    return subgraphs.clique_sizes(*adapters.order_ring(spark, sf_dir))


@query("WITH " + sql.ORDER + """, p AS (SELECT DISTINCT a.g FROM adj a JOIN adj b ON b.g = a.g AND b.src = a.dst AND b.dst <> a.src JOIN n x ON x.g = a.g AND x.id = a.src JOIN n y ON y.g = a.g AND y.id = a.dst JOIN n z ON z.g = a.g AND z.id = b.dst
WHERE x.sym = 'A' AND y.sym = 'N' AND z.sym = 'R' AND a.chg = 0 AND b.chg <> 0 AND b.chg = 1) SELECT DISTINCT n.g, p.g IS NOT NULL AS found FROM n LEFT JOIN p ON p.g = n.g""")
def pattern_search(spark, sf_dir):
    """Orders that hold A - N with a formed edge to R."""
    return subgraphs.contains(*adapters.order_graph(spark, sf_dir), ([0, 1, 2], ["A", "N", "R"], [0, 1], [1, 2], [0, 1]))


@query("SELECT CAST(c_nationkey AS BIGINT) AS reaction, c_custkey, c_acctbal FROM (SELECT *, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS r FROM customer) WHERE r = 1")
def least_cost(spark, sf_dir):
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").cast("long").alias("reaction"), "c_custkey", "c_acctbal")
    return graphs.least_cost(customers, "reaction", "c_acctbal")


@query("WITH " + sql.ORDER + " SELECT sym, CAST(dense_rank() OVER (ORDER BY sym) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT sym FROM n)")
def symbol_codes(spark, sf_dir):
    return mapping.dictionaries(adapters.order_graph(spark, sf_dir)[0])


# --- column functions


@query("""SELECT p_partkey, split_part(p_name[1:1] || '.' || p_size, '.', 1) AS symbol, least(p_name[1:1], p_type[1:1]) || p_size || greatest(p_name[1:1], p_type[1:1]) AS bond, lpad(CAST(p_size AS VARCHAR), 6, ' ') AS padded, trim(p_name[3:8]) AS field FROM part""")
def atom_functions(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    first, kind = F.substring("p_name", 1, 1), F.substring("p_type", 1, 1)
    return part.select(
        "p_partkey", columns.symbol_of(F.concat_ws(".", first, "p_size")).alias("symbol"), columns.bond_label(first, kind, F.col("p_size")).alias("bond"),
        columns.right_justified(F.col("p_size"), 6).alias("padded"), columns.fixed(F.col("p_name"), 2, 8).alias("field"),
    )


@query("""SELECT p_partkey, round(exp(-pow((p_size / 10.0 - 2) / 1.5, 2) / 2) / (1.5 * sqrt(2 * pi())), 6) AS bell, round(1 / (1 + exp(0.7 * (p_size - 0.5))), 6) AS falls, round(pow(1.3, -p_size), 6) AS weight, CAST(ceil(log2(p_size)) AS INTEGER) AS bits,
round(-list_sum(list_transform([x / CAST(p_size + 7 AS DOUBLE) FOR x IN [p_size, p_partkey % 5, 7 - p_partkey % 5] IF x > 0], lambda p: p * log10(p))), 6) AS entropy FROM part""")
def weight_functions(spark, sf_dir):
    part, size = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_size")
    rest = F.col("p_partkey") % 5
    shares = F.transform(F.array(size.cast("long"), rest, 7 - rest), lambda x: x / (size + 7))
    out = part.select(
        "p_partkey", columns.gaussian(size / 10.0, 2.0, 1.5).alias("bell"), columns.logistic(size, 0.7).alias("falls"), columns.power_weight(size, 1.3).alias("weight"),
        columns.ceil_log2(size).alias("bits"), columns.entropy(shares).alias("entropy"),
    )
    return rounded(out, "bell", "falls", "weight", "entropy")


_AB = "a AS (SELECT p_partkey, [CAST(p_size AS BIGINT), p_partkey % 7, 3, p_partkey % 4] AS a, [p_partkey % 11, CASE WHEN p_size > 20 THEN 2 END, p_partkey % 3, 3] AS b FROM part)"


def _text_of(values: str) -> str:
    return f"array_to_string(list_transform({values}, lambda x: coalesce(CAST(x AS VARCHAR), '-')), ' ')"


@query("WITH " + _AB + ", z AS (SELECT *, [[a[i], b[i]] FOR i IN [1, 2, 3, 4]] AS z FROM a) SELECT p_partkey, " + ", ".join(f"{_text_of(f'[{v} FOR x IN z]')} AS {n}" for n, v in {
    "least": "least(x[1], x[2])", "greatest": "greatest(x[1], x[2])", "added": "x[1] + x[2]", "apart": "x[1] - x[2]",
}.items()) + ", CAST(list_sum(b) AS DOUBLE) AS total, CAST(list_sum([least(len(list_filter(a, lambda y: y = v)), len(list_filter(b, lambda y: y = v))) FOR v IN list_distinct(a)]) AS INTEGER) AS common FROM z")
def array_functions(spark, sf_dir):
    part, key = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_partkey")
    a = F.array(F.col("p_size").cast("long"), key % 7, F.lit(3).cast("long"), key % 4)
    b = F.array(key % 11, F.when(F.col("p_size") > 20, F.lit(2).cast("long")), key % 3, F.lit(3).cast("long"))
    told = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ", "-")
    made = {n: told(columns.elementwise(a, b, how)) for n, how in {"least": "min", "greatest": "max", "added": "add", "apart": "sub"}.items()}
    return part.select("p_partkey", *(c.alias(n) for n, c in made.items()), columns.array_sum(b).alias("total"), columns.multiset_common(a, b).alias("common"))


@query("""WITH c AS (SELECT CAST(c_nationkey AS BIGINT) AS nation, c_mktsegment[1:1] AS sym, count(*) AS n FROM customer GROUP BY ALL UNION ALL
SELECT CAST(s_nationkey AS BIGINT), ['A', 'B', 'F', 'X', 'Y'][s_suppkey % 5 + 1], count(*) FROM supplier GROUP BY ALL)
SELECT nation, sym, CAST(sum(n) AS BIGINT) AS n FROM c WHERE nation IN (SELECT s_nationkey FROM supplier) AND nation IN (SELECT c_nationkey FROM customer) GROUP BY nation, sym""")
def merged_counts(spark, sf_dir):
    counted = lambda t: F.map_from_entries(F.collect_list(F.struct("sym", "n"))).alias(t)
    one = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy(F.col("c_nationkey").alias("nation"), F.substring("c_mktsegment", 1, 1).alias("sym")).agg(F.count("*").alias("n"))
    letter = F.element_at(F.array(*map(F.lit, "ABFXY")), (F.col("s_suppkey") % 5 + 1).cast("int"))
    two = spark.read.parquet(f"{sf_dir}/supplier.parquet").groupBy(F.col("s_nationkey").alias("nation"), letter.alias("sym")).agg(F.count("*").alias("n"))
    both = one.groupBy("nation").agg(counted("a")).join(two.groupBy("nation").agg(counted("b")), "nation")
    return both.select(F.col("nation").cast("long").alias("nation"), F.explode(columns.merged_counts(F.col("a"), F.col("b"))).alias("sym", "n"))


# --- the built text index


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


_LOC = "WITH l AS (SELECT doc_id, text, unnest(list_filter(range(0, length(text)), lambda i: text[i + 1 : i + {n}] = '{p}')) AS pos FROM documents WHERE contains(text, '{p}'))"


def text_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all documents, grown by five portions of ids, four of them merged; built by the first query over these files."""

    def build(folder: str) -> None:
        docs, index = _docs(spark, sf_dir), textindex.GrowingIndex(spark, folder)
        for k in range(5):
            index.add(docs.where(F.coalesce(F.pmod("doc_id", F.lit(5)), F.lit(0)) == k), f"portion {k}")
        while index.compact():
            pass

    return textindex.GrowingIndex(spark, built_once(spark, "text-index", [f"{sf_dir}/documents.parquet"], build)).read()


@query(_LOC.format(n=6, p="hahaha") + " SELECT doc_id, CAST(pos AS INTEGER) AS pos FROM l")
def index_locate(spark, sf_dir):
    return textindex.index_locate(text_index(spark, sf_dir), "hahaha")


@query(_LOC.format(n=2, p="ha") + " SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id")
def index_count(spark, sf_dir):
    return textindex.index_count(text_index(spark, sf_dir), "ha")


_SUFFIXES = "WITH s AS (SELECT p_partkey AS doc_id, i AS pos, p_name[i + 1 :] || chr(0) AS suffix FROM part, range(0, 1000) r(i) WHERE i <= length(p_name)), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY suffix) - 1 AS place, lag(suffix) OVER (PARTITION BY doc_id ORDER BY suffix) AS last FROM s)"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text"))


@query(_SUFFIXES + " SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(coalesce(list_max([n FOR n IN range(0, 200) IF n < length(suffix) AND n < length(last) AND suffix[:n] = last[:n]]), 0) AS INTEGER) AS lcp FROM o")
def common_prefixes(spark, sf_dir):
    return textindex.common_prefixes(_names(spark, sf_dir))


@query(_SUFFIXES + ", z AS (SELECT doc_id, max(pos) AS top FROM s GROUP BY doc_id) SELECT a.doc_id, CAST(a.place AS INTEGER) AS place, CAST(b.place AS INTEGER) AS back FROM o a JOIN z ON z.doc_id = a.doc_id JOIN o b ON b.doc_id = a.doc_id AND b.pos = CASE WHEN a.pos = 0 THEN top ELSE a.pos - 1 END")
def transform_steps(spark, sf_dir):
    return textindex.steps_back(_names(spark, sf_dir))


@query("WITH t AS (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil(length(text) / 100.0) AS BIGINT), 1))) AS part FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST(part AS INTEGER) AS part, text[part * 100 + 1 : part * 100 + 100] AS text FROM t")
def text_parts(spark, sf_dir):
    return textindex.split_parts(_docs(spark, sf_dir), 100)
