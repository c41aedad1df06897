"""SQL fragments for the oracle of the registered queries (DuckDB dialect)."""

from __future__ import annotations

_LINES = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_returnflag, l_linestatus, l_discount, l_tax"

_EDGES = """
e AS (SELECT g, id AS src, id + 1 AS dst, CASE WHEN st = nx THEN 0 WHEN st = '{low}' THEN 1 ELSE -1 END AS chg
      FROM (SELECT *, lead(st) OVER (PARTITION BY g ORDER BY id) AS nx FROM n) WHERE nx IS NOT NULL)"""

_ADJ = """,
adj AS (SELECT g, src, dst, chg FROM e UNION ALL SELECT g, dst, src, chg FROM e)"""

ORDER = f"""
n AS (SELECT l_orderkey AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINES}) - 1 AS id, l_returnflag AS sym, l_linestatus AS st FROM lineitem),""" + _EDGES.format(low="O") + _ADJ
NATION = """
n AS (SELECT CAST(c_nationkey AS BIGINT) AS g, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS id, c_mktsegment[1:1] AS sym,
             CASE WHEN c_acctbal >= 0 THEN 'p' ELSE 'n' END AS st FROM customer),""" + _EDGES.format(low="p") + _ADJ
SUPPLIER = """
n AS (SELECT CAST(s_nationkey AS BIGINT) AS g, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS id, ['A', 'B', 'F', 'H', 'M'][s_suppkey % 5 + 1] AS sym,
             CASE WHEN s_acctbal >= 0 THEN 'p' ELSE 'n' END AS st FROM supplier),""" + _EDGES.format(low="p") + _ADJ
USER = """
n AS (SELECT user_id AS g, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS id, event_type[1:1] AS sym, 's' AS st FROM events),""" + _EDGES.format(low="s") + _ADJ
RING = f"""
n0 AS (SELECT l_orderkey AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINES}) - 1 AS id, l_returnflag AS sym, l_linestatus AS st FROM lineitem),
n AS (SELECT * FROM n0 WHERE g IN (SELECT g FROM n0 GROUP BY g HAVING count(*) >= 3)),
e AS (SELECT g, id AS src, id + 1 AS dst, CASE WHEN st = nx THEN 0 WHEN st = 'O' THEN 1 ELSE -1 END AS chg
      FROM (SELECT *, lead(st) OVER (PARTITION BY g ORDER BY id) AS nx FROM n) WHERE nx IS NOT NULL
      UNION ALL SELECT g, 0, max(id), 0 FROM n GROUP BY g)""" + _ADJ


def paths(graph: str, depth: int = 50) -> str:
    """CTEs up to ``p(g, path, len, freq)``, to go after WITH RECURSIVE."""
    return graph + f""",
w(g, cur, visited, path, len) AS (
  SELECT g, id, [id], '(' || sym, 1 FROM n
  UNION ALL
  SELECT w.g, a.dst, list_append(w.visited, a.dst), w.path || CASE a.chg WHEN 0 THEN '(' WHEN -1 THEN '{{' ELSE '[' END || n.sym, w.len + 1
  FROM w JOIN adj a ON a.g = w.g AND a.src = w.cur JOIN n ON n.g = a.g AND n.id = a.dst
  WHERE w.len < {depth} AND NOT list_contains(w.visited, a.dst)),
p AS (SELECT g, path, len, count(*) AS freq FROM w GROUP BY g, path, len)"""


FOREST = f"""
home AS (SELECT CAST(n_regionkey AS BIGINT) AS entry, CAST(n_nationkey AS BIGINT) AS tree FROM nation),
owned AS (SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS tree, entry, c_mktsegment[1:1] AS sym FROM customer JOIN home ON tree = c_nationkey),
placed AS (SELECT entry, tree, o_orderkey, o_custkey, o_orderstatus FROM orders JOIN owned ON o_custkey = c_custkey),
ln AS (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINES}) AS ln FROM lineitem),
t AS (
  SELECT entry, tree, CAST(1 + 10 * tree AS BIGINT) AS node, CAST(NULL AS BIGINT) AS parent, 'N' AS sym, 1 AS depth FROM home
  UNION ALL SELECT entry, tree, 2 + 10 * c_custkey, 1 + 10 * tree, sym, 2 FROM owned
  UNION ALL SELECT entry, tree, 3 + 10 * o_orderkey, 2 + 10 * o_custkey, o_orderstatus, 3 FROM placed
  UNION ALL SELECT entry, tree, 4 + 10 * (o_orderkey * 1000 + ln), 3 + 10 * o_orderkey, l_returnflag, 4 FROM placed JOIN ln ON l_orderkey = o_orderkey)"""

#: Labels from the root down, joined level by level.
FOREST_PATHS = FOREST + """,
tp AS (
  SELECT d1.*, d1.sym AS down FROM t d1 WHERE depth = 1
  UNION ALL SELECT d2.*, d1.sym || d2.sym FROM t d2 JOIN t d1 ON d2.parent = d1.node WHERE d2.depth = 2
  UNION ALL SELECT d3.*, d1.sym || d2.sym || d3.sym FROM t d3 JOIN t d2 ON d3.parent = d2.node JOIN t d1 ON d2.parent = d1.node WHERE d3.depth = 3
  UNION ALL SELECT d4.*, d1.sym || d2.sym || d3.sym || d4.sym FROM t d4 JOIN t d3 ON d4.parent = d3.node JOIN t d2 ON d3.parent = d2.node JOIN t d1 ON d2.parent = d1.node WHERE d4.depth = 4)"""

PRODUCT = """,
ad AS (SELECT a.*, x.sym AS s1, y.sym AS s2 FROM adj a JOIN n x ON x.g = a.g AND x.id = a.src JOIN n y ON y.g = a.g AND y.id = a.dst),
pn AS (SELECT x.g AS i, y.g AS j, x.id AS a1, y.id AS a2 FROM n x JOIN n y ON x.sym = y.sym AND y.g <= x.g),
pe AS (SELECT x.g AS i, y.g AS j, x.src AS a1, y.src AS a2, x.dst AS b1, y.dst AS b2
       FROM ad x JOIN ad y ON x.s1 = y.s1 AND x.s2 = y.s2 AND x.chg = y.chg AND y.g <= x.g)"""

#: Distance to the nearest end of a changed edge, on chains.
CORE = """,
ce AS (SELECT g, src AS c FROM e WHERE chg <> 0 UNION SELECT g, dst FROM e WHERE chg <> 0),
cd AS (SELECT n.g, n.id, min(abs(n.id - c)) AS dist FROM n LEFT JOIN ce ON ce.g = n.g GROUP BY n.g, n.id)"""


def walk_levels(first: str, scale: str, length: int, value: str = "sum(f.f)") -> str:
    """CTEs f1..f<length>(i, j, a1, a2, f) and the union ``fs``; ``scale`` multiplies a level's sums."""
    out = f",\nf1 AS ({first})"
    for k in range(2, length + 1):
        out += f""",
f{k} AS (SELECT pe.i, pe.j, pe.a1, pe.a2, {scale} * {value} AS f
      FROM pe JOIN f{k - 1} f ON f.i = pe.i AND f.j = pe.j AND f.a1 = pe.b1 AND f.a2 = pe.b2
      JOIN pw ON pw.i = pe.i AND pw.j = pe.j AND pw.a1 = pe.a1 AND pw.a2 = pe.a2
      GROUP BY pe.i, pe.j, pe.a1, pe.a2)"""
    return out + ",\nfs AS (" + " UNION ALL ".join(f"SELECT i, j, a1, a2, {k} AS len, f FROM f{k}" for k in range(1, length + 1)) + ")"
