"""Orders closed to rings are dealt once, and what reads no changes is made once for graphs that differ in them alone."""

import pyarrow as pa

from pathloom.operators import adapters, graphs, messages, paths
from pathloom.sources import flatfile
from tests.conftest import SF_SMALL
from tests.test_dealt_once import LINE, as_sets, exchanges


def test_closed_orders_are_the_rings(spark, tmp_path):
    odd = [(k, p, 1, n, 1.0, 1.0, 0.0, 0.0, f, s, None) for k, p, n, f, s in [
        (1, 2, 1, "A", "F"), (1, 1, 1, "N", "O"), (1, 3, None, "R", None), (2, 1, 1, None, "O"), (2, 2, 1, "A", "O"), (3, 1, 1, "A", "O"), (None, 1, 1, "A", "O"), (None, 1, 2, "A", "F"), (None, 1, 3, "A", "F"),
    ]]
    spark.createDataFrame(odd, LINE).write.parquet(f"{tmp_path}/lineitem.parquet")
    for folder in (str(tmp_path), SF_SMALL):
        want = as_sets(paths.as_graphs(*adapters.order_ring(spark, folder)))
        assert as_sets(adapters.order_graphs(spark, folder, closed=True)[0]) == want and want


def test_facts_of_rings_shuffle_lines_once(spark):
    assert exchanges(messages.feature_facts(*adapters.order_graphs(spark, SF_SMALL, closed=True), 0, 5, ("ATOM_DISTRIBUTION", "RING"))) == 1


def test_graphs_that_differ_in_changes_are_one_form_where_these_are_not_read(spark):
    rows = [(g, [0, 1], ["a", "b"], [0], [1], [g % 3 - 1]) for g in range(9)]
    packed = spark.createDataFrame(rows, "g long, ids array<int>, syms array<string>, src array<int>, dst array<int>, chg array<int>").coalesce(1)

    def calls(changes):
        made = []

        def one(ids, syms, src, dst, chg):
            made.append(1)
            yield (len(made),)

        return {r.n for r in graphs.by_form(packed, None, [("n", pa.int32(), "int")], one, changes=changes).collect()}

    assert (calls(False), calls(True)) == ({1}, {1, 2, 3})


def test_lines_of_features_with_and_without_branches(spark, tmp_path):
    lines = ["1:0:A:0=(R)", "1:1:A:1=(AR,2=A,0=R,)", "1:2:A:1=(2=A)", "1:3:A:1=(2=A,R,S)", "1:4:A:2=()", "1:5:RING:3=True", "1:6:A:1=(X,3=a=b)"]
    spark.createDataFrame([(v,) for v in lines], "value string").write.text(f"{tmp_path}/f")
    got = {r.atom: (r.context, r.value, r.dirs) for r in flatfile.read_features(spark, f"{tmp_path}/f", skip=()).collect()}
    assert got == {0: (0, "R", {}), 1: (1, "AR", {0: "R", 2: "A"}), 2: (1, None, {2: "A"}), 3: (1, "R", {2: "A"}), 4: (2, "", {}), 5: (3, "True", {}), 6: (1, "X", {3: "a"})}
