"""The registered queries of the graph engine and their SQL: whole tables in, scalars out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pathloom.operators import adapters, canonical, forest, graphs, kernels, labels, mapping, messages, paths, reactions, subgraphs, textindex, walks
from pathloom.plans import formats, sql, structures  # noqa: F401  the other two register their own
from pathloom.plans.registry import ORACLE_SQL, QUERIES, Query, query, rounded as _rounded  # noqa: F401
from pathloom.scratch import built_once, scratch_path
from pathloom.sinks import text as sink
from pathloom.sources import molfile, trees


def _order_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.path_table(*adapters.order_graphs(spark, sf_dir))


_P = "WITH RECURSIVE " + sql.paths(sql.ORDER)

# --- paths


@query(_P + " SELECT path, len, g, freq FROM p")
def path_frequencies(spark, sf_dir):
    return _order_paths(spark, sf_dir).select("path", "len", "g", "freq")


@query(_P + " SELECT path, len, count(*) AS n_graphs, CAST(sum(freq) AS BIGINT) AS total FROM p GROUP BY path, len HAVING count(*) > 50")
def shared_paths(spark, sf_dir):
    return paths.shared_paths(_order_paths(spark, sf_dir), 50)


@query(_P + " SELECT path, len, CAST(sum(freq) AS BIGINT) AS freq FROM p WHERE contains(path, '{') OR contains(path, '[') GROUP BY path, len")
def core_paths(spark, sf_dir):
    return paths.core_paths(_order_paths(spark, sf_dir))


@query(_P + " SELECT len, CAST(sum(freq) AS BIGINT) AS n_paths, count(DISTINCT path) AS n_distinct FROM p GROUP BY len")
def path_length_histogram(spark, sf_dir):
    return paths.length_histogram(_order_paths(spark, sf_dir))


def path_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written path index of the orders: built by the first query over these files, read by all."""

    def build(folder: str) -> None:
        sink.save_index(_order_paths(spark, sf_dir), folder)

    return trees.read_index(spark, built_once(spark, "path-index", [f"{sf_dir}/lineitem.parquet"], build))


PATTERNS = ["(A", "(N(N", "(A[R", "(N(N(N", "(R{A(N", "(Z"]
_IN = ", ".join(f"'{p}'" for p in PATTERNS)


@query(_P + f", asked AS (SELECT unnest([{_IN}]) AS path) SELECT asked.path, CAST(coalesce(sum(freq), 0) AS BIGINT) AS n FROM asked LEFT JOIN p ON p.path = asked.path GROUP BY asked.path")
def subpath_count(spark, sf_dir):
    return paths.subpath_count(path_index(spark, sf_dir), PATTERNS)


@query(_P + f" SELECT path, g, CAST(sum(freq) AS BIGINT) AS n FROM p WHERE path IN ({_IN}) GROUP BY path, g")
def subpath_freq(spark, sf_dir):
    return paths.subpath_freq(path_index(spark, sf_dir), PATTERNS)


@query(_P + " SELECT path, len, CAST(sum(freq) AS BIGINT) AS freq FROM p WHERE starts_with(path, '(N(N') GROUP BY path, len")
def descend_prefix(spark, sf_dir):
    return paths.descend(path_index(spark, sf_dir), "(N(N").groupBy("path", "len").agg(F.sum("freq").alias("freq"))


@query(_P + " SELECT DISTINCT path[5:6] AS step FROM p WHERE starts_with(path, '(N(N') AND path <> '(N(N'")
def child_symbols(spark, sf_dir):
    return paths.child_symbols(path_index(spark, sf_dir), "(N(N")


@query(_P + """, f AS (SELECT path, len, row_number() OVER (ORDER BY len, path) AS path_id FROM (SELECT DISTINCT path, len FROM p)),
q AS (SELECT g, row_number() OVER (ORDER BY g) AS graph_id FROM (SELECT DISTINCT g FROM p))
SELECT path_id, graph_id, freq FROM p JOIN f USING (path) JOIN q USING (g)""")
def feature_triples(spark, sf_dir):
    return paths.feature_triples(_order_paths(spark, sf_dir))


@query(_P + " SELECT g, " + ", ".join(f"CAST(sum(CASE WHEN path = '{p}' THEN freq ELSE 0 END) AS BIGINT) AS f{k}" for k, p in enumerate(PATTERNS, 1)) + " FROM p GROUP BY g")
def feature_pivot(spark, sf_dir):
    return paths.feature_pivot(_order_paths(spark, sf_dir), PATTERNS)


@query("WITH RECURSIVE " + sql.paths(sql.RING, 5) + " SELECT path, len, count(*) AS n_graphs, CAST(sum(freq) AS BIGINT) AS total FROM p GROUP BY path, len")
def ring_paths(spark, sf_dir):
    return paths.shared_paths(paths.path_table(*adapters.order_ring(spark, sf_dir), max_depth=5), 0)


@query("WITH " + sql.USER + """, g AS (
  SELECT g, '(' || sym AS p1, lead('(' || sym, 1) OVER w AS p2, lead('(' || sym, 2) OVER w AS p3, lead('(' || sym, 3) OVER w AS p4 FROM n WINDOW w AS (PARTITION BY g ORDER BY id))
SELECT path, g, count(*) AS freq FROM (
  SELECT g, p1 AS path FROM g UNION ALL SELECT g, p1 || p2 FROM g UNION ALL SELECT g, p1 || p2 || p3 FROM g UNION ALL SELECT g, p1 || p2 || p3 || p4 FROM g)
WHERE path IS NOT NULL GROUP BY path, g""")
def event_ngram_spectrum(spark, sf_dir):
    return paths.ngrams(adapters.user_chain(spark, sf_dir)[0], 4)


# --- kernels over path features (graphs are nations)


def _nation_paths(spark: SparkSession, sf_dir: str, depth: int = 50) -> DataFrame:
    return paths.path_table(*adapters.nation_graph(spark, sf_dir), max_depth=depth, strategy="parts")


def _kernel_sql() -> str:
    sums = []
    for cap in kernels.CAPS:
        for dp in ("ind", "float"):
            for kind in ("allpaths", "corepaths"):
                use = f"len <= {cap}" + (" AND core" if kind == "corepaths" else "")
                sums.append(f"SELECT {cap} AS l, '{dp}' AS dp, '{kind}' AS paths, i, j, 0.001 + sum(CASE WHEN d = 'ff' AND {use} THEN pow(0.9, len) * {dp}_ ELSE 0 END) AS ff, 0.001 + sum(CASE WHEN d = 'fb' AND {use} THEN pow(0.9, len) * {dp}_ ELSE 0 END) AS fb FROM c GROUP BY i, j")
    return "WITH RECURSIVE " + sql.paths(sql.NATION) + """,
c AS (
  SELECT a.g AS i, b.g AS j, a.len, contains(a.path, '{') OR contains(a.path, '[') AS core, 'ff' AS d, CAST(sum(a.freq * b.freq) AS DOUBLE) AS float_, count(*) AS ind_ FROM p a JOIN p b ON a.path = b.path GROUP BY ALL
  UNION ALL
  SELECT a.g, b.g, a.len, contains(a.path, '{') OR contains(a.path, '['), 'fb', CAST(sum(a.freq * b.freq) AS DOUBLE), count(*) FROM p a JOIN p b ON a.path = translate(b.path, '{[', '[{') GROUP BY ALL
  UNION ALL SELECT a.g, b.g, 0, false, 'none', 0, 0 FROM (SELECT DISTINCT g FROM n) a, (SELECT DISTINCT g FROM n) b),
k AS (""" + " UNION ALL ".join(sums) + """),
r AS (
  SELECT k.*, k.fb / sqrt(di.ff * dj.ff) AS x, t.fb / sqrt(di.ff * dj.ff) AS y, di.ff AS di, dj.ff AS dj
  FROM k JOIN k t ON (t.l, t.dp, t.paths, t.i, t.j) = (k.l, k.dp, k.paths, k.j, k.i)
  JOIN k di ON (di.l, di.dp, di.paths, di.i, di.j) = (k.l, k.dp, k.paths, k.i, k.i) JOIN k dj ON (dj.l, dj.dp, dj.paths, dj.i, dj.j) = (k.l, k.dp, k.paths, k.j, k.j)),
s AS (SELECT l, dp, paths, i, j, ff / sqrt(di * dj) AS f, x AS fb, 2 * ff * ff + 2 * x * y AS tensor, greatest(ff, x) AS max_ FROM r),
u AS (
  SELECT s.l, s.dp, s.paths, s.i, s.j, s.f, s.fb, s.tensor / sqrt(a.tensor * b.tensor) AS tensor, s.max_ / sqrt(a.max_ * b.max_) AS max_
  FROM s JOIN s a ON (a.l, a.dp, a.paths, a.i, a.j) = (s.l, s.dp, s.paths, s.i, s.i) JOIN s b ON (b.l, b.dp, b.paths, b.i, b.j) = (s.l, s.dp, s.paths, s.j, s.j)
  WHERE s.j <= s.i),
v AS (SELECT l, dp, paths, i, j, 'f' AS type, f AS k FROM u UNION ALL SELECT l, dp, paths, i, j, 'fb', fb FROM u UNION ALL SELECT l, dp, paths, i, j, 'tensor', tensor FROM u UNION ALL SELECT l, dp, paths, i, j, 'max', max_ FROM u)
SELECT l, dp, paths, type, 1 AS power, i, j, round(k, 6) AS k FROM v UNION ALL SELECT l, dp, paths, type, 2, i, j, round(k * k, 6) FROM v"""


@query(_kernel_sql())
def path_kernels_64(spark, sf_dir):
    return _rounded(kernels.path_kernels(_nation_paths(spark, sf_dir)), "k")


@query("SELECT concat_ws('_', paths, l, '90', dp, type, power) AS name, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, k FROM (" + _kernel_sql() + ")")
def kernel_file_cells(spark, sf_dir):
    """The 64 kernels as files of lines of commas, and what is read from them: file, line, place in the line, value."""
    table = sink.kernel_name(_rounded(kernels.path_kernels(_nation_paths(spark, sf_dir)), "k"))
    folder = scratch_path(spark, "kernel-lines")
    sink.write_files(sink.kernel_text(table), folder)
    files = spark.read.text(folder, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name"), "value")
    lines = files.select("name", F.posexplode(F.split("value", "\n")).alias("i", "line"))
    return lines.select("name", "i", F.posexplode(F.split("line", ",")).alias("j", "cell")).select("name", "i", "j", F.col("cell").cast("double").alias("k"))


_NP = "WITH RECURSIVE " + sql.paths(sql.NATION, 4)


def _plain(how: str) -> Query:
    def run(spark, sf_dir):
        features = _nation_paths(spark, sf_dir, 4).select("g", F.col("path").alias("feature"), F.col("freq").alias("n"), F.col("len").alias("size"))
        return _rounded(kernels.feature_kernel(features, how), "k")

    return run


for _how, _value in {"dot": "sum(a.freq * b.freq)", "ind": "count(*)", "min": "sum(least(a.freq, b.freq))"}.items():
    query(_NP + f" SELECT a.g AS i, b.g AS j, round(CAST({_value} AS DOUBLE), 6) AS k FROM p a JOIN p b ON a.path = b.path AND b.g <= a.g GROUP BY a.g, b.g", name=f"feature_kernel_{_how}")(_plain(_how))
query(_NP + """, s AS (SELECT g, len, sum(freq) AS t FROM p GROUP BY g, len)
SELECT a.g AS i, b.g AS j, round(sum(least(a.freq, b.freq) / (sqrt(x.t) * sqrt(y.t))), 6) AS k
FROM p a JOIN p b ON a.path = b.path AND b.g <= a.g JOIN s x ON x.g = a.g AND x.len = a.len JOIN s y ON y.g = b.g AND y.len = b.len GROUP BY a.g, b.g""", name="feature_kernel_minnorm")(_plain("minnorm"))


@query(_NP + """, k AS (SELECT a.g AS i, b.g AS j, CAST(sum(a.freq * b.freq) AS DOUBLE) AS k FROM p a JOIN p b ON a.path = b.path AND b.g <= a.g GROUP BY a.g, b.g)
SELECT k.i, k.j, round(k.k / sqrt(a.k * b.k), 6) AS k FROM k JOIN k a ON a.i = k.i AND a.j = k.i JOIN k b ON b.i = k.j AND b.j = k.j""")
def kernel_normalized(spark, sf_dir):
    features = _nation_paths(spark, sf_dir, 4).select("g", F.col("path").alias("feature"), F.col("freq").alias("n"))
    return _rounded(kernels.normalized(kernels.feature_kernel(features)), "k")


# --- graph statistics


@query("WITH " + sql.ORDER + " SELECT g, sym AS key, count(*) AS n FROM n GROUP BY g, sym")
def formula(spark, sf_dir):
    return graphs.formula(adapters.order_graph(spark, sf_dir)[0])


@query("WITH " + sql.ORDER + """ SELECT e.g, least(a.sym, b.sym) || chg || greatest(a.sym, b.sym) AS key, count(*) AS n
FROM e JOIN n a ON a.g = e.g AND a.id = e.src JOIN n b ON b.g = e.g AND b.id = e.dst GROUP BY ALL""")
def bond_spectrum(spark, sf_dir):
    return graphs.bond_spectrum(*adapters.order_graph(spark, sf_dir))


_NODE_SPECTRUM = """, near AS (SELECT a.g, a.src AS id, string_agg(b.sym, '' ORDER BY b.sym) AS near FROM adj a JOIN n b ON b.g = a.g AND b.id = a.dst GROUP BY a.g, a.src),
sp AS (SELECT n.g, n.sym || ':' || coalesce(near, '') AS key, count(*) AS n FROM n LEFT JOIN near ON near.g = n.g AND near.id = n.id GROUP BY ALL)"""


@query("WITH " + sql.ORDER + _NODE_SPECTRUM + " SELECT g, key, n FROM sp")
def node_spectrum(spark, sf_dir):
    return graphs.node_spectrum(*adapters.order_graph(spark, sf_dir))


@query("WITH " + sql.ORDER + _NODE_SPECTRUM + """, ids AS (SELECT g AS g1, lead(g) OVER (ORDER BY g) AS g2 FROM (SELECT DISTINCT g FROM n)),
pr AS (SELECT * FROM ids WHERE g2 IS NOT NULL),
u AS (SELECT g1, g2, key, sum(a) AS a, sum(b) AS b FROM (
  SELECT g1, g2, key, n AS a, 0 AS b FROM pr JOIN sp ON g = g1 UNION ALL SELECT g1, g2, key, 0, n FROM pr JOIN sp ON g = g2) GROUP BY ALL)
SELECT g1, g2, round((sum(a + b) - sum(abs(a - b))) / sum(a + b), 6) AS sim FROM u GROUP BY g1, g2""")
def spectrum_similarity(spark, sf_dir):
    nodes, edges = adapters.order_graph(spark, sf_dir)
    return _rounded(graphs.spectrum_similarity(graphs.node_spectrum(nodes, edges), graphs.neighbouring(nodes)), "sim")


@query("WITH " + sql.ORDER + sql.CORE + " SELECT g, id, CAST(dist AS INTEGER) AS dist FROM cd")
def core_distance(spark, sf_dir):
    return graphs.core_distance(*adapters.order_graphs(spark, sf_dir))


@query("WITH " + sql.RING + ", size AS (SELECT g, count(*) AS k FROM n GROUP BY g) SELECT x.g, x.id AS a, y.id AS b, CAST(least(abs(x.id - y.id), k - abs(x.id - y.id)) AS INTEGER) AS dist FROM n x JOIN n y ON y.g = x.g JOIN size ON size.g = x.g")
def all_pairs_distance(spark, sf_dir):
    return graphs.all_pairs(*adapters.order_ring(spark, sf_dir))


@query("WITH " + sql.RING + ", size AS (SELECT g, count(*) AS k FROM n GROUP BY g) SELECT g, 0 AS id, CAST(floor(k / 2) AS INTEGER) AS dist FROM size")
def farthest_node(spark, sf_dir):
    return graphs.farthest(*adapters.order_ring(spark, sf_dir))


@query("WITH " + sql.ORDER + sql.CORE + """, kept AS (SELECT g, id, row_number() OVER (PARTITION BY g ORDER BY id) - 1 AS new FROM cd WHERE dist IS NOT NULL)
SELECT k.g, k.new AS id, n.sym FROM kept k JOIN n ON n.g = k.g AND n.id = k.id""")
def reachable_nodes(spark, sf_dir):
    return graphs.reachable(*adapters.order_graph(spark, sf_dir))[0]


@query("WITH " + sql.ORDER + _NODE_SPECTRUM + """, bs AS (SELECT e.g, least(a.sym, b.sym) || chg || greatest(a.sym, b.sym) AS key, count(*) AS n FROM e JOIN n a ON a.g = e.g AND a.id = e.src JOIN n b ON b.g = e.g AND b.id = e.dst GROUP BY ALL),
h AS (SELECT g, string_agg(key || '=' || n, ',' ORDER BY key || '=' || n) AS c FROM sp GROUP BY g),
hb AS (SELECT g, string_agg(key || '=' || n, ',' ORDER BY key || '=' || n) AS b FROM bs GROUP BY g)
SELECT count(DISTINCT (c, coalesce(b, ''))) AS classes, count(*) AS n_graphs FROM h LEFT JOIN hb USING (g)""")
def canonical_hash_classes(spark, sf_dir):
    return graphs.canonical_hash(*adapters.order_graph(spark, sf_dir)).agg(F.countDistinct("hash").alias("classes"), F.count("*").alias("n_graphs"))


# --- product graphs and walks (graphs are nations)


@query("WITH " + sql.NATION + sql.PRODUCT + """, a AS (SELECT i, j, count(*) AS nodes FROM pn GROUP BY i, j), b AS (SELECT i, j, count(*) AS edges FROM pe GROUP BY i, j)
SELECT a.i, a.j, nodes, CAST(coalesce(edges, 0) AS BIGINT) AS edges FROM a LEFT JOIN b ON a.i = b.i AND a.j = b.j""")
def product_graph_size(spark, sf_dir):
    return walks.product_sizes(*adapters.nation_graph(spark, sf_dir))


@query("WITH " + sql.NATION + sql.PRODUCT + sql.CORE + """
SELECT i, j, count(*) AS nodes FROM pn JOIN cd x ON x.g = i AND x.id = a1 JOIN cd y ON y.g = j AND y.id = a2 WHERE coalesce(x.dist = 0, false) = coalesce(y.dist = 0, false) GROUP BY i, j""")
def reduced_product_graph_size(spark, sf_dir):
    nodes, edges = adapters.nation_graph(spark, sf_dir)
    return walks.product_sizes(nodes, edges, graphs.core_distance(nodes, edges))


_ONES = ", pw AS (SELECT i, j, a1, a2, 1.0::DOUBLE AS w FROM pn)"


@query("WITH " + sql.NATION + sql.PRODUCT + _ONES + sql.walk_levels("SELECT i, j, a1, a2, 1 AS f FROM pn", "1", 5) + " SELECT i, j, len, CAST(sum(f) AS BIGINT) AS n FROM fs GROUP BY i, j, len")
def walk_counts(spark, sf_dir):
    return walks.walk_counts(*adapters.nation_graph(spark, sf_dir), 5)


def _weights(dist: str) -> str:
    return f", wt AS (SELECT g, id, {dist} AS w FROM cd), pw AS (SELECT pn.*, x.w * y.w AS w FROM pn JOIN wt x ON x.g = i AND x.id = a1 JOIN wt y ON y.g = j AND y.id = a2)"


_WALK = sql.walk_levels("SELECT i, j, a1, a2, 0.8 * w AS f FROM pw", "0.8 * any_value(pw.w)", 5)


@query("WITH " + sql.NATION + sql.PRODUCT + sql.CORE + _weights("coalesce(pow(2.0, -dist), 0)") + _WALK + " SELECT i, j, round(sum(f), 4) AS k FROM fs GROUP BY i, j")
def walk_kernel_exp(spark, sf_dir):
    nodes, edges = adapters.nation_graph(spark, sf_dir)
    w = graphs.core_distance(nodes, edges).select("g", "id", walks.exponential(F.col("dist"), 2.0).alias("w"))
    return _rounded(walks.walk_kernel(nodes, edges, w, 0.8, 5), "k", digits=4)


@query("WITH " + sql.NATION + sql.PRODUCT + sql.CORE + _weights("coalesce(1 / (1 + exp(1.0 * (dist - 0.5))), 0)") + _WALK + " SELECT i, j, round(sum(f), 4) AS k FROM fs GROUP BY i, j")
def walk_kernel_logistic(spark, sf_dir):
    nodes, edges = adapters.nation_graph(spark, sf_dir)
    w = graphs.core_distance(nodes, edges).select("g", "id", walks.logistic(F.col("dist"), 1.0).alias("w"))
    return _rounded(walks.walk_kernel(nodes, edges, w, 0.8, 5), "k", digits=4)


@query("WITH " + sql.NATION + sql.PRODUCT + """,
m1 AS (SELECT i, j, a1, a2, b1, b2, 0.5::DOUBLE AS m FROM pe),
m2 AS (SELECT x.i, x.j, x.a1, x.a2, x.b1, x.b2, 0.5::DOUBLE * sum(m) AS m FROM pe x JOIN m1 p ON p.i = x.i AND p.j = x.j AND p.b1 = x.a1 AND p.b2 = x.a2 WHERE p.a1 <> x.b1 AND p.a2 <> x.b2 GROUP BY ALL),
m3 AS (SELECT x.i, x.j, x.a1, x.a2, x.b1, x.b2, 0.5::DOUBLE * sum(m) AS m FROM pe x JOIN m2 p ON p.i = x.i AND p.j = x.j AND p.b1 = x.a1 AND p.b2 = x.a2 WHERE p.a1 <> x.b1 AND p.a2 <> x.b2 GROUP BY ALL)
SELECT i, j, round(sum(f), 4) AS k FROM (SELECT i, j, 0.5::DOUBLE AS f FROM pn UNION ALL SELECT i, j, 0.5::DOUBLE * m FROM m1 UNION ALL SELECT i, j, 0.5::DOUBLE * m FROM m2 UNION ALL SELECT i, j, 0.5::DOUBLE * m FROM m3) GROUP BY i, j""")
def nontottering_kernel(spark, sf_dir):
    nodes, edges = adapters.nation_graph(spark, sf_dir)
    return _rounded(walks.nontottering_kernel(nodes, edges, walks.constant_weights(nodes), 0.5, 4), "k", digits=4)


@query("WITH " + sql.NATION + sql.PRODUCT + """,
sz AS (SELECT g, count(*) AS c FROM n GROUP BY g), dg AS (SELECT n.g, n.id, count(a.dst) AS d FROM n LEFT JOIN adj a ON a.g = n.g AND a.src = n.id GROUP BY n.g, n.id),
pw AS (SELECT pn.*, CASE WHEN x.d > 0 THEN 0.2 ELSE 1.0 END * CASE WHEN y.d > 0 THEN 0.2 ELSE 1.0 END AS e, 0.64 / (x.d * y.d) AS w, 1.0 / (p.c * q.c) AS s
       FROM pn JOIN dg x ON x.g = i AND x.id = a1 JOIN dg y ON y.g = j AND y.id = a2 JOIN sz p ON p.g = i JOIN sz q ON q.g = j)""" + sql.walk_levels("SELECT i, j, a1, a2, e::DOUBLE AS f FROM pw", "any_value(pw.w)", 5) + """
SELECT fs.i, fs.j, round(sum(f * s), 8) AS k FROM fs JOIN pw ON pw.i = fs.i AND pw.j = fs.j AND pw.a1 = fs.a1 AND pw.a2 = fs.a2 GROUP BY fs.i, fs.j""")
def marginal_kernel(spark, sf_dir):
    nodes, edges = adapters.nation_graph(spark, sf_dir)
    return _rounded(walks.marginal_kernel(nodes, edges, walks.constant_weights(nodes), 0.8, 5), "k", digits=8)


# --- long walks, and product graphs as rows (nations as chains of their suppliers)


@query("WITH " + sql.SUPPLIER + sql.PRODUCT + " SELECT i, j, a1, a2 FROM pn")
def product_graph_nodes(spark, sf_dir):
    return walks.product_nodes(adapters.supplier_graph(spark, sf_dir)[0])


@query("WITH " + sql.SUPPLIER + " SELECT x.g AS i, y.g AS j, count(*) AS pairs FROM n x JOIN n y ON y.g <= x.g GROUP BY x.g, y.g")
def product_graph_all_pairs(spark, sf_dir):
    found = walks.product_nodes(adapters.supplier_graph(spark, sf_dir)[0], match_labels=False)
    return found.groupBy("i", "j").agg(F.count("*").alias("pairs"))


@query("WITH " + sql.SUPPLIER + sql.PRODUCT + " SELECT i, j, a1, a2, b1, b2 FROM pe")
def product_graph_edges(spark, sf_dir):
    return walks.product_edges(*adapters.supplier_graph(spark, sf_dir))


@query("WITH " + sql.SUPPLIER + sql.PRODUCT + sql.CORE + """
SELECT i, j, a1, a2 FROM pn JOIN cd x ON x.g = i AND x.id = a1 JOIN cd y ON y.g = j AND y.id = a2 WHERE coalesce(x.dist = 0, false) = coalesce(y.dist = 0, false)""")
def reduced_product_graph_nodes(spark, sf_dir):
    nodes, edges = adapters.supplier_graph(spark, sf_dir)
    return walks.product_nodes(nodes, core=graphs.core_distance(nodes, edges))


@query("WITH " + sql.NATION + sql.PRODUCT + _ONES + sql.walk_levels("SELECT i, j, a1, a2, 1 AS f FROM pn", "1", 20) + " SELECT i, j, len, CAST(sum(f) AS BIGINT) AS n FROM fs GROUP BY i, j, len")
def long_walk_counts(spark, sf_dir):
    return walks.walk_counts(*adapters.nation_graph(spark, sf_dir), 20)


@query("WITH " + sql.SUPPLIER + sql.PRODUCT + sql.CORE + _weights("coalesce(pow(2.0, -dist), 0)") + sql.walk_levels("SELECT i, j, a1, a2, 0.2 * w AS f FROM pw", "0.2 * any_value(pw.w)", 50) + " SELECT i, j, round(sum(f), 4) AS k FROM fs GROUP BY i, j")
def walk_kernel_converged(spark, sf_dir):
    nodes, edges = adapters.supplier_graph(spark, sf_dir)
    w = graphs.core_distance(nodes, edges).select("g", "id", walks.exponential(F.col("dist"), 2.0).alias("w"))
    return _rounded(walks.walk_kernel(nodes, edges, w, 0.2, 500, epsilon=1e-13), "k", digits=4)


def _straight_levels(length):
    """CTEs r2..r<length>: walks of the product graph by their first step, none back to the point before."""
    out = ", r2 AS (SELECT *, 1 AS n FROM pe)"
    for k in range(3, length + 1):
        out += f""", r{k} AS (SELECT pe.i, pe.j, pe.a1, pe.a2, pe.b1, pe.b2, sum(r.n) AS n FROM pe JOIN r{k - 1} r ON r.i = pe.i AND r.j = pe.j AND r.a1 = pe.b1 AND r.a2 = pe.b2
          WHERE NOT (r.b1 = pe.a1 AND r.b2 = pe.a2) GROUP BY ALL)"""
    return out + ", rs AS (SELECT i, j, 1 AS len, count(*) AS n FROM pn GROUP BY i, j" + "".join(f" UNION ALL SELECT i, j, {k}, sum(n) FROM r{k} GROUP BY i, j" for k in range(2, length + 1)) + ")"


# On chains a walk that turns back in neither graph is a pair of simple paths, so the corrected counts are those of equal paths.
@query("WITH RECURSIVE " + sql.paths(sql.NATION, 4) + sql.PRODUCT + _straight_levels(4) + """,
like_paths AS (SELECT a.g AS i, b.g AS j, a.len, sum(a.freq * b.freq) AS n FROM p a JOIN p b ON a.path = b.path AND b.g <= a.g GROUP BY a.g, b.g, a.len)
SELECT rs.i, rs.j, CAST(rs.len AS INTEGER) AS len, CAST(rs.n AS BIGINT) AS n, CAST(coalesce(q.n, 0) AS BIGINT) AS corrected FROM rs LEFT JOIN like_paths q ON q.i = rs.i AND q.j = rs.j AND q.len = rs.len""")
def product_path_counts(spark, sf_dir):
    return walks.path_counts(*adapters.nation_graph(spark, sf_dir), 4)


def _sums(length):
    """CTEs h1..h<length>: walks from a node by the sum of their distances."""
    out = ", h1 AS (SELECT g, id, dist AS total, 1 AS n FROM cd WHERE dist IS NOT NULL)"
    for k in range(2, length + 1):
        out += f", h{k} AS (SELECT a.g, a.src AS id, h.total + d.dist AS total, sum(h.n) AS n FROM adj a JOIN h{k - 1} h ON h.g = a.g AND h.id = a.dst JOIN cd d ON d.g = a.g AND d.id = a.src GROUP BY ALL)"
    return out


@query("WITH " + sql.ORDER + sql.CORE + _sums(4) + " " + " UNION ALL ".join(f"SELECT g, id, {k} AS len, CAST(total AS BIGINT) AS total, CAST(n AS BIGINT) AS n FROM h{k}" for k in range(1, 5)))
def distance_sums(spark, sf_dir):
    nodes, edges = adapters.order_graph(spark, sf_dir)
    return walks.distance_sums(nodes, edges, graphs.core_distance(nodes, edges), 4)


def _product_sums(name, side, length):
    """CTEs <name>1..<length>: walks from a point of the product graph by the sum of one graph's distances."""
    g, a = ("i", "a1") if side == 1 else ("j", "a2")
    out = f", {name}1 AS (SELECT pn.*, {'x' if side == 1 else 'y'}.dist AS total, 1 AS n FROM pn JOIN cd x ON x.g = i AND x.id = a1 JOIN cd y ON y.g = j AND y.id = a2 WHERE x.dist + y.dist IS NOT NULL)"
    for k in range(2, length + 1):
        out += f""", {name}{k} AS (SELECT pe.i, pe.j, pe.a1, pe.a2, h.total + d.dist AS total, sum(h.n) AS n FROM pe JOIN {name}{k - 1} h ON h.i = pe.i AND h.j = pe.j AND h.a1 = pe.b1 AND h.a2 = pe.b2
          JOIN cd d ON d.g = pe.{g} AND d.id = pe.{a} GROUP BY ALL)"""
    return out


def _mean_weights(length):
    weight = "sum(n / (1 + exp(total / {k}::DOUBLE - 0.5)))"
    half = lambda k: 1 if k == 1 else 2
    own = " UNION ALL ".join(f"SELECT g, {k} AS len, {weight.format(k=k)} / {half(k)} AS z FROM h{k} GROUP BY g" for k in range(1, length + 1))
    of = lambda t, k: f"(SELECT i, j, a1, a2, {weight.format(k=k)} AS w FROM {t}{k} GROUP BY i, j, a1, a2)"
    met = " UNION ALL ".join(f"SELECT i, j, {k} AS len, sum(l.w * r.w) / {half(k)} AS z FROM {of('u', k)} l JOIN {of('v', k)} r USING (i, j, a1, a2) GROUP BY i, j" for k in range(1, length + 1))
    return f", z AS ({own}), zz AS ({met})"


@query("WITH " + sql.NATION + sql.PRODUCT + sql.CORE + _sums(4) + _product_sums("u", 1, 4) + _product_sums("v", 2, 4) + _mean_weights(4) + """
SELECT zz.i, zz.j, round(sum(pow(0.8, zz.len) * zz.z / (a.z * b.z)), 6) AS k FROM zz JOIN z a ON a.g = zz.i AND a.len = zz.len JOIN z b ON b.g = zz.j AND b.len = zz.len GROUP BY zz.i, zz.j""")
def distance_kernel(spark, sf_dir):
    nodes, edges = adapters.nation_graph(spark, sf_dir)
    return _rounded(walks.distance_kernel(nodes, edges, graphs.core_distance(nodes, edges), 1.0, 0.8, 4), "k")


# --- shortest paths and subgraphs (graphs are nations)


_SP = "WITH RECURSIVE " + sql.paths(sql.NATION, 1000)


@query(_SP + " SELECT a.g AS i, b.g AS j, round(CAST(sum(pow(0.9, a.len) * a.freq * b.freq) AS DOUBLE), 4) AS k FROM p a JOIN p b ON a.path = b.path AND b.g <= a.g WHERE a.len >= 2 GROUP BY a.g, b.g")
def shortest_path_kernel(spark, sf_dir):
    return _rounded(subgraphs.shortest_path_kernel(*adapters.nation_graph(spark, sf_dir), lam=0.9), "k", digits=4)


@query("WITH RECURSIVE " + sql.paths(sql.SUPPLIER, 1000) + " SELECT a.g AS i, b.g AS j, round(CAST(sum(pow(0.9, a.len) * a.freq * b.freq) AS DOUBLE), 4) AS k FROM p a JOIN p b ON a.path = b.path AND b.g <= a.g WHERE a.len >= 2 GROUP BY a.g, b.g")
def spread_shortest_path_kernel(spark, sf_dir):
    return _rounded(subgraphs.shortest_path_kernel(*adapters.supplier_graph(spark, sf_dir), lam=0.9, strategy="joins"), "k", digits=4)


_SUB = "WITH " + sql.NATION + """, iv AS (SELECT a.g, a.id, m, string_agg(b.sym, '' ORDER BY b.sym) AS s FROM n a, range(1, 6) r(m) JOIN n b ON b.g = a.g AND b.id >= a.id AND b.id < a.id + m GROUP BY a.g, a.id, m HAVING count(*) = m),
f AS (SELECT g, s || ':' || (m - 1) AS feature, m AS size, count(*) AS n FROM iv GROUP BY ALL)"""
_SUB = _SUB.replace("FROM n a, range(1, 6) r(m) JOIN n b", "FROM n a CROSS JOIN range(1, 6) r(m) JOIN n b")


def _subgraph(how: str) -> Query:
    def run(spark, sf_dir):
        return _rounded(subgraphs.subgraph_kernel(*adapters.nation_graph(spark, sf_dir), 5, how), "k")

    return run


for _how, _value in {"dot": "sum(a.n * b.n)", "ind": "count(*)", "min": "sum(least(a.n, b.n))"}.items():
    query(_SUB + f" SELECT a.g AS i, b.g AS j, round(CAST({_value} AS DOUBLE), 6) AS k FROM f a JOIN f b ON a.feature = b.feature AND b.g <= a.g GROUP BY a.g, b.g", name=f"subgraph_kernel_{_how}")(_subgraph(_how))
query(_SUB + """, s AS (SELECT g, size, sum(n) AS t FROM f GROUP BY g, size)
SELECT a.g AS i, b.g AS j, round(sum(least(a.n, b.n) / (sqrt(x.t) * sqrt(y.t))), 6) AS k
FROM f a JOIN f b ON a.feature = b.feature AND b.g <= a.g JOIN s x ON x.g = a.g AND x.size = a.size JOIN s y ON y.g = b.g AND y.size = b.size GROUP BY a.g, b.g""", name="subgraph_kernel_minnorm")(_subgraph("minnorm"))


@query("WITH " + sql.RING + """, size AS (SELECT g, count(*) AS k FROM n GROUP BY g)
SELECT g, CAST(k * least(4, k - 1) + CASE WHEN k <= 4 THEN 1 ELSE 0 END AS BIGINT) AS n FROM size""")
def subgraph_counts(spark, sf_dir):
    return subgraphs.subgraph_count(*adapters.order_ring(spark, sf_dir), 4)


@query(_P + """, full_ AS (SELECT p.g, min(path) AS key FROM p JOIN (SELECT g, count(*) AS k FROM n GROUP BY g) s ON s.g = p.g AND s.k = p.len GROUP BY p.g),
c AS (SELECT key, count(*) AS members FROM full_ GROUP BY key)
SELECT members, count(*) AS classes FROM c GROUP BY members""")
def isomorphism_classes(spark, sf_dir):
    found = canonical.isomorphism_classes(*adapters.order_graph(spark, sf_dir))
    return found.groupBy("class").agg(F.count("*").alias("members")).groupBy("members").agg(F.count("*").alias("classes"))


# --- forests


@query("WITH " + sql.FOREST_PATHS + """, lf AS (SELECT * FROM tp WHERE node NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL)),
q AS (SELECT unnest(['N', 'NA', 'NBO', 'NFFA', 'NZ']) AS prefix)
SELECT prefix, count(down) AS leaves FROM q LEFT JOIN lf ON starts_with(down, prefix) GROUP BY prefix""")
def subtree_leaves(spark, sf_dir):
    return forest.subtree_leaves(adapters.geo_forest(spark, sf_dir), {p: list(p) for p in ("N", "NA", "NBO", "NFFA", "NZ")})


@query("WITH " + sql.FOREST + """ SELECT count(DISTINCT entry) AS entries, count(DISTINCT (entry, tree)) AS trees, count(*) AS nodes,
CAST(sum(CASE WHEN node NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL) THEN 1 ELSE 0 END) AS BIGINT) AS leaves FROM t""")
def forest_totals(spark, sf_dir):
    return forest.totals(adapters.geo_forest(spark, sf_dir))


@query("WITH " + sql.FOREST_PATHS + " SELECT node, dense_rank() OVER (ORDER BY reverse(down)) AS rank FROM tp")
def upward_rank(spark, sf_dir):
    return forest.upward_rank(adapters.geo_forest(spark, sf_dir)).select("node", "rank")


_DEEP = "WITH RECURSIVE " + sql.NATION + """, t AS (SELECT g, id, sym, CASE WHEN id > 0 THEN id - CASE WHEN id % 3 = 1 THEN 1 ELSE 2 END END AS parent FROM n),
tp AS (SELECT g, id, sym AS up, format('{:09d}', id) AS down FROM t WHERE parent IS NULL
  UNION ALL SELECT t.g, t.id, t.sym || tp.up, tp.down || format('{:09d}', t.id) FROM tp JOIN t ON t.g = tp.g AND t.parent = tp.id)"""


@query(_DEEP + " SELECT g AS tree, id AS node, dense_rank() OVER (ORDER BY up) AS rank FROM tp")
def deep_upward_rank(spark, sf_dir):
    return forest.upward_rank(adapters.deep_forest(spark, sf_dir)).select("tree", "node", "rank")


@query(_DEEP + """, lf AS (SELECT tp.*, NOT EXISTS (SELECT 1 FROM t WHERE t.g = tp.g AND t.parent = tp.id) AS leaf FROM tp)
SELECT a.g AS tree, a.id AS node, dense_rank() OVER (PARTITION BY a.g ORDER BY a.down) - 1 AS pre, count(*) AS size, CAST(sum(b.leaf::INTEGER) AS BIGINT) AS leaves
FROM lf a JOIN lf b ON a.g = b.g AND starts_with(b.down, a.down) GROUP BY a.g, a.id, a.down""")
def subtree_intervals(spark, sf_dir):
    return forest.intervals(adapters.deep_forest(spark, sf_dir)).select("tree", "node", "pre", "size", "leaves")


@query("WITH " + sql.FOREST + """ SELECT node, node NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL) AS is_leaf,
lead(node) OVER (PARTITION BY entry, tree, parent ORDER BY node) IS NULL AS is_last FROM t""")
def last_sibling_flags(spark, sf_dir):
    return forest.with_flags(adapters.geo_forest(spark, sf_dir)).select("node", "is_leaf", "is_last")


@query("WITH " + sql.FOREST + ", k AS (SELECT parent, node, row_number() OVER (PARTITION BY entry, tree, parent ORDER BY node) AS r FROM t WHERE parent IS NOT NULL) SELECT parent, node AS child FROM k WHERE r = 2")
def kth_child(spark, sf_dir):
    return forest.kth_child(adapters.geo_forest(spark, sf_dir), 2)


@query("WITH " + sql.FOREST + " SELECT parent, count(*) AS degree FROM t WHERE parent IS NOT NULL GROUP BY parent")
def node_degrees(spark, sf_dir):
    return forest.degrees(adapters.geo_forest(spark, sf_dir))


@query("WITH " + sql.FOREST + ", c AS (SELECT sym, count(*) AS n FROM t GROUP BY sym) SELECT sym, n, CAST(sum(n) OVER (ORDER BY sym) AS BIGINT) AS cum FROM c")
def symbol_cumulative(spark, sf_dir):
    return forest.symbol_cumulative(adapters.geo_forest(spark, sf_dir))


@query("WITH " + sql.USER + " SELECT g, count(*) FILTER (sym = 'c' AND id <= 20) AS n FROM n GROUP BY g")
def rank_query(spark, sf_dir):
    return forest.rank_of(adapters.user_chain(spark, sf_dir)[0], "c", 20)


@query("WITH " + sql.USER + ", k AS (SELECT g, id, row_number() OVER (PARTITION BY g ORDER BY id) AS r FROM n WHERE sym = 'c') SELECT g, id FROM k WHERE r = 5")
def select_query(spark, sf_dir):
    return forest.select_of(adapters.user_chain(spark, sf_dir)[0], "c", 5)


# --- reactions

_SEG = """
x AS (SELECT CAST(c_nationkey AS BIGINT) AS reaction, 's' AS side, c_mktsegment[1:1] AS ligand FROM customer
      UNION ALL SELECT CAST(s_nationkey AS BIGINT), 'p', ['A', 'B', 'F', 'H', 'M'][s_suppkey % 5 + 1] FROM supplier),
sd AS (SELECT reaction, side, ligand, count(*) AS n FROM x GROUP BY ALL)"""
#: A molecule kernel: how near two letters are in the alphabet.
_MK = ", mk AS (SELECT a, b, 1.0::DOUBLE / (1 + abs(ascii(a) - ascii(b))) AS k FROM (SELECT unnest(['A', 'B', 'F', 'H', 'M']) AS a), (SELECT unnest(['A', 'B', 'F', 'H', 'M']) AS b))"
_CELLS = """, c AS (SELECT u.reaction AS i, v.reaction AS j, u.side || v.side AS w, sum(k) AS k FROM sd u JOIN mk ON a = u.ligand JOIN sd v ON v.ligand = b AND v.reaction <= u.reaction GROUP BY ALL),
g AS (SELECT i, j, coalesce(sum(k) FILTER (w = 'ss'), 0) AS ss, coalesce(sum(k) FILTER (w = 'pp'), 0) AS pp, coalesce(sum(k) FILTER (w = 'sp'), 0) AS sp, coalesce(sum(k) FILTER (w = 'ps'), 0) AS ps FROM c GROUP BY i, j)"""


def _letters(spark: SparkSession) -> DataFrame:
    letters = "ABFHM"
    return spark.createDataFrame([(a, b, 1.0 / (1 + abs(ord(a) - ord(b)))) for a in letters for b in letters], "a string, b string, k double")


@query("WITH " + _SEG + _MK + _CELLS + " SELECT i, j, round(ss + pp + sp + ps, 6) AS k FROM g")
def sum_of_reactants(spark, sf_dir):
    return _rounded(reactions.sum_of_reactants(adapters.segment_reaction(spark, sf_dir), _letters(spark)), "k")


@query("WITH " + _SEG + _MK + _CELLS + " SELECT i, j, round(ss + pp - sp - ps, 6) AS k FROM g")
def difference_of_reactants(spark, sf_dir):
    return _rounded(reactions.difference_of_reactants(adapters.segment_reaction(spark, sf_dir), _letters(spark)), "k")


@query("WITH " + _SEG + _MK + _CELLS + " SELECT i, j, round(ss * pp, 6) AS k FROM g")
def reactant_matching(spark, sf_dir):
    return _rounded(reactions.reactant_matching(adapters.segment_reaction(spark, sf_dir), _letters(spark)), "k")


_OR = "WITH o AS (SELECT l_orderkey AS reaction, CASE WHEN l_linestatus = 'O' THEN 's' ELSE 'p' END AS side, p_brand AS ligand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"


@query(_OR + ", d AS (SELECT reaction, ligand, sum(CASE WHEN side = 's' THEN n ELSE -n END) AS d FROM o GROUP BY ALL) SELECT reaction, max(abs(d)) = 0 AS balanced FROM d GROUP BY reaction")
def balanced_reactions(spark, sf_dir):
    return reactions.balanced(adapters.order_reaction(spark, sf_dir))


@query("""WITH o AS (SELECT DISTINCT l_orderkey AS reaction, l_partkey AS ligand FROM lineitem)
SELECT DISTINCT a.reaction AS r1, b.reaction AS r2 FROM o a JOIN o b ON a.ligand = b.ligand AND a.reaction < b.reaction""")
def reaction_adjacency(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return graphs.shared_ligands(lines.select(F.col("l_orderkey").alias("reaction"), F.lit("s").alias("side"), F.col("l_partkey").alias("ligand")))


# --- message passing


@query("WITH " + sql.ORDER + """ SELECT a.g, a.id, CAST(k AS INTEGER) AS k, string_agg(b.sym, '' ORDER BY b.sym) AS value
FROM n a CROSS JOIN range(0, 4) r(k) JOIN n b ON b.g = a.g AND abs(b.id - a.id) <= k GROUP BY ALL""")
def atom_distribution(spark, sf_dir):
    return messages.atom_distribution(*adapters.order_graphs(spark, sf_dir), context=3)


@query("WITH " + sql.ORDER + """, b AS (SELECT e.g, src, dst, least(x.sym, y.sym) || chg || greatest(x.sym, y.sym) AS bond FROM e JOIN n x ON x.g = e.g AND x.id = src JOIN n y ON y.g = e.g AND y.id = dst)
SELECT a.g, a.id, CAST(k AS INTEGER) AS k, string_agg(bond, ',' ORDER BY bond) AS value
FROM n a CROSS JOIN range(1, 4) r(k) JOIN b ON b.g = a.g AND least(abs(src - a.id), abs(dst - a.id)) < k GROUP BY ALL""")
def bond_distribution(spark, sf_dir):
    return messages.bond_distribution(*adapters.order_graphs(spark, sf_dir), context=3)


@query("WITH " + sql.ORDER + """, pr AS (SELECT a.g, a.id, k, x.id AS x, y.id AS y FROM n a CROSS JOIN range(1, 4) r(k) JOIN n x ON x.g = a.g AND abs(x.id - a.id) <= k JOIN n y ON y.g = a.g AND abs(y.id - a.id) <= k AND x.id < y.id),
s AS (SELECT g, id, k, sum(y - x) AS v FROM pr GROUP BY ALL)
SELECT n.g, n.id, CAST(r.k AS INTEGER) AS k, CAST(coalesce(v, 0) AS BIGINT) AS value FROM n CROSS JOIN range(1, 4) r(k) LEFT JOIN s ON s.g = n.g AND s.id = n.id AND s.k = r.k""")
def wiener_index(spark, sf_dir):
    return messages.wiener_index(*adapters.order_graphs(spark, sf_dir), context=3)


@query("WITH " + sql.RING + """, m0 AS (SELECT g, id, 1 AS v FROM n),
m1 AS (SELECT n.g, n.id, sum(m.v) AS v FROM n JOIN adj ON adj.g = n.g AND adj.src = n.id JOIN m0 m ON m.g = n.g AND m.id = adj.dst GROUP BY n.g, n.id),
m2 AS (SELECT n.g, n.id, sum(m.v) AS v FROM n JOIN adj ON adj.g = n.g AND adj.src = n.id JOIN m1 m ON m.g = n.g AND m.id = adj.dst GROUP BY n.g, n.id)
SELECT g, id, 0 AS k, CAST(v AS BIGINT) AS value FROM m0 UNION ALL SELECT g, id, 1, CAST(v AS BIGINT) FROM m1 UNION ALL SELECT g, id, 2, CAST(v AS BIGINT) FROM m2""")
def morgan_index(spark, sf_dir):
    return messages.morgan_index(*adapters.order_ring(spark, sf_dir), rounds=2)


@query("WITH " + sql.RING + " SELECT n.g, n.id, k = 5 AS in_ring FROM n JOIN (SELECT g, count(*) AS k FROM n GROUP BY g) s ON s.g = n.g")
def ring_membership(spark, sf_dir):
    return messages.ring_membership(*adapters.order_ring(spark, sf_dir), size=5)


@query("WITH " + sql.ORDER + " SELECT a.g, a.id, CAST(min(abs(a.id - b.id)) AS INTEGER) AS nearest, CAST(max(abs(a.id - b.id)) AS INTEGER) AS farthest FROM n a LEFT JOIN n b ON b.g = a.g AND b.id <> a.id GROUP BY a.g, a.id")
def distance_extremes(spark, sf_dir):
    return messages.distance_extremes(*adapters.order_graph(spark, sf_dir))


@query("WITH " + sql.ORDER + """, m1 AS (SELECT a.g, a.src, a.dst, ascii(n.sym) AS m FROM adj a JOIN n ON n.g = a.g AND n.id = a.src),
m2 AS (SELECT a.g, a.src, a.dst, sum(p.m) AS m FROM adj a JOIN m1 p ON p.g = a.g AND p.dst = a.src AND p.src <> a.dst GROUP BY ALL)
SELECT g, src, dst, 1 AS round, CAST(m AS BIGINT) AS m FROM m1 UNION ALL SELECT g, src, dst, 2, CAST(m AS BIGINT) FROM m2""")
def edge_messages(spark, sf_dir):
    nodes, edges = adapters.order_graph(spark, sf_dir)
    return messages.messages(nodes, edges, 2, nodes.select("g", "id", F.ascii("sym").cast("long").alias("m")))


@query("WITH " + sql.NATION + sql.CORE + " SELECT g, id, CAST(dist AS INTEGER) AS m FROM cd")
def stable_core_distance(spark, sf_dir):
    """Distances to the core as messages that go on until no state changes."""
    nodes, edges = adapters.nation_graph(spark, sf_dir)
    core = edges.where("chg <> 0").select("g", F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("m", F.lit(0))
    return messages.until_stable(nodes, edges, core, lambda m, _: m + 1, "min", lambda m, met: F.least(m, met))[0]


@query("WITH " + sql.ORDER + """, x AS (SELECT n.*, sum(CASE WHEN e.chg = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY n.g ORDER BY n.id) AS run FROM n LEFT JOIN e ON e.g = n.g AND e.dst = n.id)
SELECT g, id, list_sort(list_distinct(list(sym) OVER (PARTITION BY g, run))) AS m FROM x""")
def reachable_symbols(spark, sf_dir):
    """The symbols that a node reaches over unchanged edges, by a caller's aggregate of sets, until none grows."""
    union = lambda m: F.array_sort(F.array_distinct(F.flatten(m)))
    unchanged = lambda m, chg: F.when(chg == 0, m)
    return messages.settled(adapters.order_graphs(spark, sf_dir)[0], lambda s: F.array(s), unchanged, union, lambda m, met: F.array_sort(F.array_union(m, F.coalesce(met, m))))[0]


@query("WITH RECURSIVE " + sql.ORDER + """, pr AS (
  SELECT g, id AS k, list_sort([x.id FOR x IN atoms IF x.sym = n.sym AND x.id % 2 = n.id % 2]) AS lhs, list_sort([x.id FOR x IN atoms IF x.st = n.st]) AS rhs
  FROM n JOIN (SELECT g, list({'id': id, 'sym': sym, 'st': st}) AS atoms FROM n GROUP BY g) USING (g)),
s AS (SELECT g, -1 AS k, []::BIGINT[] AS l, []::BIGINT[] AS r FROM (SELECT DISTINCT g FROM n)
  UNION ALL
  SELECT g, k, list_concat(l, a[:least(len(a), len(b))]), list_concat(r, b[:least(len(a), len(b))]) FROM (
    SELECT s.g, pr.k, l, r, list_filter(lhs, lambda x: NOT list_contains(l, x)) AS a, list_filter(rhs, lambda x: NOT list_contains(r, x)) AS b FROM s JOIN pr ON pr.g = s.g AND pr.k = s.k + 1)),
f AS (SELECT g, l, r FROM s QUALIFY row_number() OVER (PARTITION BY g ORDER BY k DESC) = 1)
SELECT g AS reaction, CAST(unnest(l) AS INTEGER) AS lhs_atom, CAST(unnest(r) AS INTEGER) AS rhs_atom FROM f""")
def pair_assignment(spark, sf_dir):
    """Each line pairs the lines of its return flag and parity with those of its line status."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", *adapters.LINE_ORDER)
    own = Window.partitionBy("l_orderkey").orderBy(*adapters.LINE_ORDER)
    rows = lines.select(F.col("l_orderkey").alias("reaction"), (F.row_number().over(own) - 1).alias("id"), F.col("l_returnflag").alias("sym"), F.col("l_linestatus").alias("st"))
    atoms = rows.groupBy("reaction").agg(F.array_sort(F.collect_list(F.struct("id", "sym", "st"))).alias("atoms"))
    chosen = lambda test: F.transform(F.filter("atoms", test), lambda x: x["id"])
    pairs = rows.join(atoms, "reaction").select(
        "reaction", F.col("id").alias("ord"), chosen(lambda x: (x["sym"] == F.col("sym")) & (x["id"] % 2 == F.col("id") % 2)).alias("lhs"), chosen(lambda x: x["st"] == F.col("st")).alias("rhs")
    )
    return mapping.assign_pairs(pairs)


# --- labels and text


@query("SELECT doc_id, CAST(max(CASE WHEN lang = 'de' THEN 1 ELSE 0 END) AS INTEGER) AS is_de, CAST(max(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS INTEGER) AS is_en, CAST(max(CASE WHEN lang = 'es' THEN 1 ELSE 0 END) AS INTEGER) AS is_es, CAST(max(CASE WHEN lang = 'fr' THEN 1 ELSE 0 END) AS INTEGER) AS is_fr FROM documents JOIN (SELECT DISTINCT doc_id FROM labels) USING (doc_id) GROUP BY doc_id")
def multi_label_matrix(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    known = docs.join(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id").distinct(), "doc_id")
    out = labels.multi_label(known.select(F.col("doc_id").alias("item"), F.col("lang").alias("label")), ["de", "en", "es", "fr"])
    return out.withColumnRenamed("item", "doc_id")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


_LOC = "WITH l AS (SELECT doc_id, text, unnest(list_filter(range(0, length(text)), lambda i: text[i + 1 : i + {n}] = '{p}')) AS pos FROM documents WHERE contains(text, '{p}'))"


@query(_LOC.format(n=2, p="ha") + " SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id")
def text_count(spark, sf_dir):
    return textindex.count(_docs(spark, sf_dir), "ha")


@query(_LOC.format(n=6, p="hahaha") + " SELECT doc_id, CAST(pos AS INTEGER) AS pos FROM l")
def text_locate(spark, sf_dir):
    return textindex.locate(_docs(spark, sf_dir), "hahaha")


@query(_LOC.format(n=6, p="hahaha") + " SELECT doc_id, CAST(pos AS INTEGER) AS pos, text[greatest(pos - 10, 0) + 1 : pos + 16] AS context FROM l")
def text_grep_context(spark, sf_dir):
    return textindex.context(_docs(spark, sf_dir), "hahaha", 10)


@query("WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE contains(text, 'hahaha')) SELECT count(DISTINCT line) AS n FROM l WHERE contains(line, 'hahaha')")
def text_grep_count(spark, sf_dir):
    return textindex.grep_count(_docs(spark, sf_dir), "hahaha")


@query("SELECT doc_id, text[11:40] AS part FROM documents")
def text_display(spark, sf_dir):
    return textindex.display(_docs(spark, sf_dir), 10, 30)


@query("""WITH s AS (SELECT p_partkey AS doc_id, i AS pos, p_name[i + 1 :] || chr(0) AS suffix, CASE WHEN i = 0 THEN chr(0) ELSE p_name[i : i] END AS b FROM part, range(0, 1000) r(i) WHERE i <= length(p_name)),
o AS (SELECT doc_id, b, lag(b) OVER (PARTITION BY doc_id ORDER BY suffix, pos) AS l FROM s)
SELECT doc_id, count(*) AS length, count(*) FILTER (l IS NULL OR l <> b) AS runs FROM o GROUP BY doc_id""")
def transform_runs(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text"))
    return textindex.transform_runs(parts)


# --- mappings: an order's lines in their own order against the order of part keys


def _line_reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines are dealt once, packed and put in order within their row."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("reaction"), *adapters.LINE_ORDER)
    packed = lines.repartition("reaction").groupBy("reaction").agg(F.sort_array(F.collect_list(F.struct(*adapters.LINE_ORDER))).alias("l"))
    # The places of the lines in the order of part keys, and then their own.
    turned = F.sort_array(F.zip_with(F.col("l.l_partkey"), F.sequence(F.lit(0), F.size("l") - 1), lambda p, i: F.struct(p.alias("p"), i.alias("i"))))
    rows = packed.select("reaction", F.col("l.l_returnflag").alias("syms"), F.sequence(F.lit(0), F.size("l") - 1).alias("ids"), turned["i"].alias("turned"))
    ends = lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    other = F.sort_array(ends(F.col("turned")))
    return rows.select("reaction", F.col("syms").alias("syms1"), ends(F.col("ids")).alias("edges1"), F.col("syms").alias("syms2"), other.alias("edges2"))


def _mapped(algorithm: str) -> Query:
    def run(spark, sf_dir):
        found = mapping.map_reactions(_line_reactions(spark, sf_dir), algorithm)
        return found.groupBy("reaction").agg(F.max("cost").alias("cost"), F.count("*").alias("mapped"), F.max("status").alias("status"))

    return run


def _optimum(levels: int = 20) -> str:
    """The least cost, by dynamic programming over sets of used images and the last one: both sides are chains of the
    same lines, so a mapping costs twice the edges that it does not keep."""
    out = f"""WITH l AS (SELECT l_orderkey AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY {sql._LINES}) - 1 AS id, l_returnflag AS sym, l_partkey FROM lineitem),
r AS (SELECT g, id, lead(id) OVER (PARTITION BY g ORDER BY l_partkey, id) AS nx FROM l),
re AS (SELECT g, id AS a, nx AS b FROM r WHERE nx IS NOT NULL UNION ALL SELECT g, nx, id FROM r WHERE nx IS NOT NULL),
n AS (SELECT g, count(*) AS n FROM l GROUP BY g),
d0 AS (SELECT l.g, t.id AS last, 1::BIGINT << t.id AS used, 0 AS kept FROM l JOIN l t ON t.g = l.g AND t.sym = l.sym WHERE l.id = 0)"""
    for k in range(1, levels):
        out += f""",
d{k} AS (SELECT d.g, t.id AS last, d.used | (1::BIGINT << t.id) AS used, max(d.kept + CASE WHEN re.a IS NULL THEN 0 ELSE 1 END) AS kept
      FROM d{k - 1} d JOIN l ON l.g = d.g AND l.id = {k} JOIN l t ON t.g = d.g AND t.sym = l.sym AND (d.used >> t.id) & 1 = 0
      LEFT JOIN re ON re.g = d.g AND re.a = d.last AND re.b = t.id GROUP BY ALL)"""
    every = " UNION ALL ".join(f"SELECT g, {k + 1} AS n, max(kept) AS kept FROM d{k} GROUP BY g" for k in range(levels))
    return out + f", e AS ({every}) SELECT n.g AS reaction, CAST(2 * (n.n - 1 - e.kept) AS INTEGER) AS cost, n.n AS mapped, 'optimal' AS status FROM n JOIN e ON e.g = n.g AND e.n = n.n"


def _all_optima(levels: int = 20) -> str:
    """Every least-cost mapping, counted by the same dynamic programming: a way's value is its kept edges and then the
    differences of its nodes' neighbours; of a state's ways only those of greatest value are counted on."""
    around = lambda name, edges: f"""
{name} AS (SELECT l.g, l.id, count(*) FILTER (o.sym = 'A') AS na, count(*) FILTER (o.sym = 'N') AS nn, count(*) FILTER (o.sym = 'R') AS nr
      FROM l LEFT JOIN {edges} e ON e.g = l.g AND e.a = l.id LEFT JOIN l o ON o.g = l.g AND o.id = e.b GROUP BY l.g, l.id)"""  # noqa: E731
    out = f"""WITH l AS (SELECT l_orderkey AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY {sql._LINES}) - 1 AS id, l_returnflag AS sym, l_partkey FROM lineitem),
r AS (SELECT g, id, lead(id) OVER (PARTITION BY g ORDER BY l_partkey, id) AS nx FROM l),
re AS (SELECT g, id AS a, nx AS b FROM r WHERE nx IS NOT NULL UNION ALL SELECT g, nx, id FROM r WHERE nx IS NOT NULL),
le AS (SELECT x.g, x.id AS a, y.id AS b FROM l x JOIN l y ON y.g = x.g AND abs(y.id - x.id) = 1),{around("ln_", "le")},{around("rn", "re")},
n AS (SELECT g, count(*) AS n FROM l GROUP BY g),
pr AS (SELECT l.g, l.id AS a, t.id AS b, abs(x.na - y.na) + abs(x.nn - y.nn) + abs(x.nr - y.nr) AS d
      FROM l JOIN l t ON t.g = l.g AND t.sym = l.sym JOIN ln_ x ON x.g = l.g AND x.id = l.id JOIN rn y ON y.g = l.g AND y.id = t.id),
d0 AS (SELECT g, b AS last, 1::BIGINT << b AS used, -d AS v, 1::BIGINT AS ways FROM pr WHERE a = 0)"""
    for k in range(1, levels):
        out += f""",
d{k} AS (SELECT g, last, used, max(v) AS v, CAST(sum(ways) AS BIGINT) AS ways FROM (
      SELECT d.g, p.b AS last, d.used | (1::BIGINT << p.b) AS used, d.v - p.d + CASE WHEN re.a IS NULL THEN 0 ELSE 10000 END AS v, ways
      FROM d{k - 1} d JOIN pr p ON p.g = d.g AND p.a = {k} AND (d.used >> p.b) & 1 = 0 LEFT JOIN re ON re.g = d.g AND re.a = d.last AND re.b = p.b
      QUALIFY rank() OVER (PARTITION BY d.g, p.b, d.used | (1::BIGINT << p.b) ORDER BY d.v - p.d + CASE WHEN re.a IS NULL THEN 0 ELSE 10000 END DESC) = 1) GROUP BY ALL)"""
    every = " UNION ALL ".join(f"SELECT g, {k + 1} AS n, v, ways FROM d{k}" for k in range(levels))
    return out + f""", e AS ({every}), b AS (SELECT n.g, n.n, v, ways FROM n JOIN e ON e.g = n.g AND e.n = n.n QUALIFY rank() OVER (PARTITION BY n.g ORDER BY v DESC) = 1)
SELECT g AS reaction, CAST(2 * (n - 1 - ceil(v / 10000.0)) AS INTEGER) AS bonds, CAST(10000 * ceil(v / 10000.0) - v AS INTEGER) AS difference, CAST(sum(ways) AS BIGINT) AS optima FROM b GROUP BY g, n, v"""


@query(_all_optima())
def least_cost_mappings(spark, sf_dir):
    counted = lambda forms: mapping.optima_of(forms).groupBy("reaction").agg(F.max("bonds").alias("bonds"), F.max("difference").alias("difference"), F.count("*").alias("optima"))
    return mapping.by_form(_line_reactions(spark, sf_dir), counted)


@query()
def distinct_least_cost_mappings(spark, sf_dir):
    """How many optimal mappings of a reaction give different reaction graphs."""
    sides = _line_reactions(spark, sf_dir)
    return mapping.by_form(sides, lambda forms: canonical.distinct_mappings(mapping.optima_of(forms), forms).groupBy("reaction").agg(F.count("*").alias("classes")))


def _common_bonds(levels: int = 20) -> str:
    """The most common edges of neighbouring orders, by dynamic programming along the first: each line goes to a free
    line of the second with its symbol, or to none (-1)."""
    out = "WITH " + sql.ORDER + """, ids AS (SELECT g AS g1, lead(g) OVER (ORDER BY g) AS g2 FROM (SELECT DISTINCT g FROM n)),
p AS (SELECT * FROM ids WHERE g2 IS NOT NULL), sz AS (SELECT g, count(*) AS k FROM n GROUP BY g),
to_ AS (SELECT p.g1, p.g2, a.id AS a, b.id AS b FROM p JOIN n a ON a.g = p.g1 JOIN n b ON b.g = p.g2 AND b.sym = a.sym UNION ALL SELECT p.g1, p.g2, a.id, -1 FROM p JOIN n a ON a.g = p.g1),
ke AS (SELECT p.g1, x.src AS a, y.src AS b, y.dst AS c FROM p JOIN e x ON x.g = p.g1 JOIN adj y ON y.g = p.g2 AND y.chg = x.chg),
d0 AS (SELECT g1, g2, b AS last, CASE WHEN b < 0 THEN 0 ELSE 1::BIGINT << b END AS used, 0 AS kept FROM to_ WHERE a = 0)"""
    for k in range(1, levels):
        out += f""",
d{k} AS (SELECT d.g1, d.g2, t.b AS last, d.used | CASE WHEN t.b < 0 THEN 0 ELSE 1::BIGINT << t.b END AS used, max(d.kept + CASE WHEN ke.a IS NULL THEN 0 ELSE 1 END) AS kept
      FROM d{k - 1} d JOIN to_ t ON t.g1 = d.g1 AND t.a = {k} AND (t.b < 0 OR (d.used >> greatest(t.b, 0)) & 1 = 0)
      LEFT JOIN ke ON ke.g1 = d.g1 AND ke.a = {k - 1} AND ke.b = d.last AND ke.c = t.b GROUP BY ALL)"""
    every = " UNION ALL ".join(f"SELECT g1, g2, {k + 1} AS n, max(kept) AS kept FROM d{k} GROUP BY g1, g2" for k in range(levels))
    return out + f", b AS ({every}) SELECT b.g1, b.g2, CAST(kept AS INTEGER) AS bonds FROM b JOIN sz ON sz.g = b.g1 AND sz.k = b.n"


@query(_common_bonds())
def common_bonds(spark, sf_dir):
    nodes, edges = adapters.order_graph(spark, sf_dir)
    return subgraphs.common_bond_sizes(nodes, edges, graphs.neighbouring(nodes))


for _name in ("astar", "dfs"):
    query(_optimum(), name=f"atom_mapping_{_name}")(_mapped(_name))
for _name in ("greedy", "hungarian", "cliques"):
    query(name=f"atom_mapping_{_name}")(_mapped(_name))


@query("SELECT count(DISTINCT l_orderkey) AS reactions, 0::BIGINT AS greedy_below, 0::BIGINT AS hungarian_below, 0::BIGINT AS cliques_below, 0::BIGINT AS incomplete FROM lineitem")
def atom_mapping_bounds(spark, sf_dir):
    """No heuristic beats the optimum, and every one maps all atoms: both sides hold the same symbols. What a form's searches
    find counts for all its reactions."""
    heuristics = ("greedy", "hungarian", "cliques")
    found = mapping.compared(_line_reactions(spark, sf_dir), ("astar", *heuristics))
    below = [F.coalesce(F.sum(F.when(F.col(f"{name}_cost") < F.col("astar_cost"), F.col("members"))), F.lit(0)).alias(f"{name}_below") for name in heuristics]
    short = F.lit(False)
    for name in heuristics:
        short |= F.col(f"{name}_mapped") < F.col("size")
    incomplete = F.coalesce(F.sum(F.when(short, F.col("members"))), F.lit(0)).alias("incomplete")
    return found.agg(F.coalesce(F.sum("members"), F.lit(0)).alias("reactions"), *below, incomplete)


# --- files: written as text and parsed again


@query("WITH " + sql.ORDER + """, a AS (SELECT g, count(*) AS nodes, CAST(sum(ascii(sym)) AS BIGINT) AS labels FROM n GROUP BY g),
b AS (SELECT g, count(*) AS edges, CAST(sum(chg) AS BIGINT) AS changes FROM e GROUP BY g)
SELECT a.g, nodes, labels, CAST(coalesce(edges, 0) AS BIGINT) AS edges, CAST(coalesce(changes, 0) AS BIGINT) AS changes FROM a LEFT JOIN b USING (g)""")
def mol_roundtrip(spark, sf_dir):
    nodes, edges = adapters.order_graph(spark, sf_dir)
    graphs_ = nodes.select("g").distinct().select("g", F.concat(F.lit("O"), "g").alias("title"), F.lit("A => B").alias("second"))
    files = sink.mol_text(graphs_, nodes, edges.withColumns({"old": F.lit(1), "new": F.lit(1) + F.col("chg")})).withColumn("name", F.lit("x_0_f.mol"))
    _, atoms, bonds, _ = molfile.parse_reaction_graphs(files)
    a = atoms.groupBy("g").agg(F.count("*").alias("nodes"), F.sum(F.ascii("sym")).cast("long").alias("labels"))
    b = bonds.groupBy("g").agg(F.count("*").alias("edges"), F.sum("chg").alias("changes"))
    return a.join(b, "g", "left").na.fill(0, ["edges", "changes"])


@query("WITH " + sql.RING + """, size AS (SELECT g, count(*) AS k FROM n GROUP BY g)
SELECT g, CAST(2 * k * (k - 1) + k AS BIGINT) AS nodes, CAST(2 * k AS BIGINT) AS leaves, CAST(k AS INTEGER) AS depth FROM size""")
def sequence_roundtrip(spark, sf_dir):
    lines = sink.sequences(*adapters.order_graphs(spark, sf_dir, closed=True)).select(F.col("g").alias("entry"), F.col("start").cast("long").alias("tree"), "line")
    found = forest.parse_trees(lines)
    return found.groupBy(F.col("entry").alias("g")).agg(F.count("*").alias("nodes"), F.sum(F.col("is_leaf").cast("long")).alias("leaves"), F.max("depth").alias("depth"))


@query(_P + " SELECT path, count(*) AS graphs, CAST(sum(freq) AS BIGINT) AS freq FROM p GROUP BY path")
def frequency_lines(spark, sf_dir):
    lines = sink.frequencies(_order_paths(spark, sf_dir))
    w = F.split("value", " ")
    pairs = F.slice(w, F.lit(2), F.size(w) - 1)
    counts = F.transform(pairs, lambda p: F.split_part(p, F.lit(":"), F.lit(2)).cast("long"))
    return lines.select(w[0].alias("path"), F.size(pairs).cast("long").alias("graphs"), F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x).alias("freq"))
