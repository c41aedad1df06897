"""Reactions of orders are packed by one shuffle, and several searches go over their forms together."""

from collections import Counter

from pathloom.operators import mapping
from pathloom.plans import catalogue
from tests.conftest import SF_SMALL
from tests.test_dealt_once import LINE, exchanges


def test_line_reactions_shuffle_lines_once(spark, tmp_path):
    odd = [(k, p, 1, n, 1.0, 1.0, 0.0, 0.0, f, "O", None) for k, p, n, f in [(1, 5, 1, "A"), (1, 4, 2, "N"), (1, None, 3, None), (1, 4, 4, "R"), (2, 1, 1, "A"), (None, 2, 1, "A"), (None, 1, 2, "N")]]
    spark.createDataFrame(odd, LINE).write.parquet(f"{tmp_path}/lineitem.parquet")
    sides = catalogue._line_reactions(spark, str(tmp_path))
    assert exchanges(sides) == 1
    got = {r.reaction: (r.syms1, [tuple(e) for e in r.edges1], r.syms2, [tuple(e) for e in r.edges2]) for r in sides.collect()}
    assert got == {
        1: (["A", "N", None, "R"], [(0, 1), (1, 2), (2, 3)], ["A", "N", None, "R"], [(1, 3), (2, 1), (3, 0)]),
        2: (["A"], [], ["A"], []), None: (["A", "N"], [(0, 1)], ["A", "N"], [(1, 0)]),
    }


def test_compared_searches_are_those_of_each_algorithm(spark):
    sides = catalogue._line_reactions(spark, SF_SMALL)
    names = ("astar", "greedy", "cliques")
    rows = mapping.compared(sides, names).collect()
    assert sum(r.members for r in rows) == sides.count() > len(rows)
    for name in names:
        found = mapping.map_reactions(sides, name).groupBy("reaction").agg({"cost": "max", "lhs_atom": "count"}).collect()
        want = Counter((r["max(cost)"], r["count(lhs_atom)"]) for r in found)
        got: Counter = Counter()
        for r in rows:
            got[r[f"{name}_cost"], r[f"{name}_mapped"]] += r.members
        assert got == want


def test_bounds_write_forms_and_no_reactions(spark):
    from pathloom.scratch import scratch_made

    with scratch_made() as made:
        catalogue.QUERIES["atom_mapping_bounds"](spark, SF_SMALL)
    assert len(made) == 1
