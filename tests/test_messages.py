import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pathloom import scratch
from pathloom.operators import graphs, mapping, messages, paths, textindex
from tests.test_searches import random_graphs, tables


def test_least_label_reaches_all_of_a_piece(spark):
    nodes, edges = random_graphs(3, 6)
    n, e = tables(spark, nodes, edges)
    states, _ = messages.until_stable(n, e, n.select("g", "id", F.col("id").alias("m")), lambda m, _: m, "min", lambda m, met: F.least(m, met))
    piece = {(g, i): i for g, i, _ in nodes}
    for _ in nodes:
        for g, a, b, _ in edges:
            piece[g, a] = piece[g, b] = min(piece[g, a], piece[g, b])
    assert {(r.g, r.id): r.m for r in states.collect()} == piece


def test_rounds_end_when_nothing_changes_or_as_asked(spark):
    n = spark.createDataFrame([(1, k, "x") for k in range(9)], "g long, id int, sym string")
    e = spark.createDataFrame([(1, k, k + 1, k % 2) for k in range(8)], "g long, src int, dst int, chg int")
    start = spark.createDataFrame([(1, 0, 0)], "g long, id int, m int")
    hop = lambda m, _: m + 1
    states, rounds = messages.until_stable(n, e, start, hop, "min", lambda m, met: F.least(m, met))
    assert rounds == 8 and {r.id: r.m for r in states.collect()} == {k: k for k in range(9)}
    states, rounds = messages.until_stable(n, e, start, hop, "min", lambda m, met: F.least(m, met), within=3)
    assert rounds == 3 and {r.id: r.m for r in states.collect()} == {k: k if k < 4 else None for k in range(9)}
    changed, _ = messages.until_stable(n, e, start, lambda m, chg: m + chg, lambda m: F.max(m), lambda m, met: F.coalesce(m, met))
    assert {r.id: r.m for r in changed.collect()} == {k: k // 2 for k in range(9)}
    assert messages.until_stable(n.limit(0), e.limit(0), start, hop, "min", lambda m, met: F.least(m, met))[0].collect() == []


def test_messages_take_a_callers_aggregate(spark):
    n, e = tables(spark, *random_graphs(5, 4))
    start = n.select("g", "id", (F.col("id") + 1).cast("long").alias("m"))
    got = {(r.g, r.src, r.dst, r["round"]): r.m for r in messages.messages(n, e, 3, start, lambda m: F.sum(m * m)).collect()}
    arcs = {(r.g, a, b) for r in e.collect() for a, b in ((r.src, r.dst), (r.dst, r.src))}
    want = {(g, a, b, 1): a + 1 for g, a, b in arcs}
    for k in (2, 3):
        for g, a, b in arcs:
            before = [want[g, c, a, k - 1] for h, c, d in arcs if (h, d) == (g, a) and c != b and (g, c, a, k - 1) in want]
            if before:
                want[g, a, b, k] = sum(x * x for x in before)
    assert got == want


def test_pairs_go_to_the_first_unmapped_atom(spark):
    rng = random.Random(4)
    rows = [(r, k, rng.sample(range(8), rng.randrange(4)), rng.sample(range(8), rng.randrange(4))) for r in range(60) for k in range(5)] + [(70, 0, None, [1])]
    want = set()
    for r in range(60):
        left, right = {}, set()
        for _, k, lhs, rhs in rows:
            if _ == r:
                for a in lhs:
                    for b in rhs:
                        if a not in left and b not in right:
                            left[a] = b
                            right.add(b)
                            break
        want |= {(r, a, b) for a, b in left.items()}
    table = spark.createDataFrame(rows, "reaction long, ord int, lhs array<int>, rhs array<int>").repartition(4)
    assert {tuple(x) for x in mapping.assign_pairs(table).collect()} == want


def test_an_index_that_grows(spark, tmp_path):
    rng = random.Random(8)
    docs = [(i, "".join(rng.choice("ab ") for _ in range(rng.randrange(60)))) for i in range(90)]
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index = textindex.GrowingIndex(spark, f"file://{tmp_path}/index", fan=3)
    assert index.read().count() == 0 and not index.compact()
    for k in range(5):
        assert index.add(table(docs[k * 15 : k * 15 + 15]), f"p{k}")
        found = {(r.doc_id, r.pos) for r in textindex.index_locate(index.read(), "ab a").collect()}
        assert found == {(i, p) for i, t in docs[: k * 15 + 15] for p in range(len(t)) if t.startswith("ab a", p)}
        while index.compact():
            pass
    assert not index.add(table(docs[:15]), "p0")  # again, and merged meanwhile
    with pytest.raises(ValueError):
        index.add(table(docs[75:]), "p0")
    lines = table(docs[75:]).select("doc_id", F.col("text").alias("value"))
    assert index.add_lines(lines, "rest") and sorted(r.level for r in index.manifest().collect()) == [0, 0, 0, 1]
    before = index.read()
    assert index.compact()
    for part in (before, index.read()):  # who reads the old manifest goes on
        assert {(r.doc_id, r.n) for r in textindex.index_count(part, "aba").collect()} == {(i, n) for i, t in docs if (n := sum(t.startswith("aba", p) for p in range(len(t))))}
    with pytest.raises(ValueError):
        textindex.index_locate(index.read(), "")


def test_built_again_when_files_change(spark, tmp_path):
    source, made = f"file://{tmp_path}/t", []
    spark.range(3).write.parquet(source)
    build = lambda: scratch.built_once(spark, "test", [source], lambda folder: (made.append(folder), spark.read.parquet(source).write.parquet(folder)))
    assert build() == build() and len(made) == 1
    spark.range(7).write.mode("overwrite").parquet(source)
    assert spark.read.parquet(build()).count() == 7 and len(made) == 2


def behind(near, v, u, k):
    """What ``v`` hears from ``u`` after ``k`` rounds, as messages pass it on."""
    return {u}.union(*(behind(near, u, x, k - 1) for x in near[u] if x != v)) if k > 1 else {u}


@pytest.mark.parametrize("centre, whole", [(True, False), (False, False), (True, True)])
def test_directed_distributions_against_messages_written_out(spark, centre, whole):
    nodes, edges = random_graphs(11, 6)
    nodes, edges = nodes + [(90, 0, "x"), (91, 0, "x"), (91, 1, "y")], edges + [(91, 0, 1, 0)]
    n, e = tables(spark, nodes, edges)
    got = {(r.g, r.id, r.k): (r.value, [tuple(b) for b in r.branches]) for r in messages.directed_distribution(n, e, 0, 6, whole, centre).collect()}
    want = {}
    for g in {g for g, _, _ in nodes}:
        sym = {i: s for h, i, s in nodes if h == g}
        near = {i: {b if a == i else a for h, a, b, _ in edges if h == g and i in (a, b)} for i in sym}
        before = None
        for k in range(7):
            now = {}
            for v in sym:
                heard = {u: behind(near, v, u, k) for u in near[v]} if k else {}
                own = ({v} if centre else set()).union(*heard.values())
                spell = lambda s: "".join(sorted(sym[i] for i in s))
                now[v] = spell(own), [(u, spell(heard[u])) for u in sorted(heard)]
            want |= {(g, v, k): x for v, x in now.items()}
            if now == before and not whole:
                break
            before = now
    assert got == want
    late = messages.directed_distribution(n, e, 2, 6, whole, centre).collect()
    assert {(r.g, r.id, r.k): (r.value, [tuple(b) for b in r.branches]) for r in late} == {key: x for key, x in want.items() if key[2] >= 2}


def test_ring_sizes_against_all_orders_of_nodes(spark):
    from itertools import permutations

    nodes, edges = random_graphs(12, 5)
    n, e = tables(spark, nodes, edges)
    arcs = {(g, a, b) for g, x, y, _ in edges for a, b in ((x, y), (y, x))}
    want = set()
    for g in {g for g, _, _ in nodes}:
        ids = [i for h, i, _ in nodes if h == g]
        for size in range(3, 6):
            for ring in permutations(ids, size):
                if all((g, a, b) in arcs for a, b in zip(ring, ring[1:] + ring[:1])):
                    want |= {(g, i, size) for i in ring}
    assert {tuple(r) for r in messages.ring_sizes(n, e, 5).collect()} == want and want


def test_feature_facts_of_nothing_and_of_unknown_kinds(spark):
    n, e = tables(spark, [(1, 0, "x")], [(1, 0, 0, 0)])
    assert messages.feature_facts(n.limit(0), e.limit(0), kinds=messages.FEATURES[:3]).collect() == []
    assert messages.feature_facts(n, e, kinds=()).columns == ["g", "id", "feature", "context", "value"]
    with pytest.raises(ValueError, match="WEINER"):
        messages.feature_facts(n, e, kinds=("WEINER",))
    alone = messages.feature_facts(n, e.limit(0), 0, 1000, messages.FEATURES[:2]).orderBy("feature", "context").collect()
    assert [(r.feature, r.context, r.value) for r in alone] == [(f, k, v) for f, v in (("ATOM_DISTRIBUTION", "(x)"), ("ATOM_DISTRIBUTION_EXCLUDE", "()")) for k in (0, 1)]


def test_features_shuffle_graphs_and_not_their_rows(spark):
    nodes, edges = random_graphs(13, 6)
    n, e = tables(spark, nodes, edges)
    plain = lambda df: df._jdf.queryExecution().executedPlan().toString()
    dealt = plain(paths.as_graphs(n, e)).count("Exchange")
    found = [messages.feature_facts(n, e, 0, 3, messages.FEATURES), messages.atom_distribution(n, e, 3), messages.wiener_index(n, e, 3), messages.bond_distribution(n, e, 3)]
    assert [plain(df).count("Exchange") for df in found] == [dealt] * len(found)


def test_rows_of_equal_graphs_are_made_once(spark, tmp_path):
    n, e = tables(spark, [(g, i, "x") for g in range(50) for i in range(3 if g else 70)], [(g, i, i + 1, 0) for g in range(50) for i in range(2 if g else 69)])
    seen = str(tmp_path / "seen")

    def one(ids, syms, src, dst, chg):
        with open(seen, "a") as log:
            log.write("x")
        return ((i, "s" * i) for i in ids)

    fields = [("id", pa.int32(), "int"), ("text", pa.string(), "string")]
    got = {(r.g, r.id): r.text for r in graphs.by_form(n.coalesce(1), e.coalesce(1), fields, one).coalesce(1).collect()}
    assert got == {(g, i): "s" * i for g in range(50) for i in range(3 if g else 70)}
    tasks = spark.conf.get("spark.sql.shuffle.partitions")
    assert len(open(seen).read()) <= 1 + int(tasks)


def test_texts_ranked_together_are_ranked_as_alone(spark):
    rng = random.Random(14)
    docs = [(i, None if i % 9 == 8 else "".join(rng.choice("ab\0é😀") for _ in range(rng.randrange(9)))) for i in range(80)]
    table = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    runs, steps, shared = {}, set(), set()
    for i, text in docs:
        if text is None:
            continue
        order = sorted(range(len(text) + 1), key=lambda k: [ord(c) + 1 for c in text[k:]] + [0])
        before = [text[k - 1] if k else None for k in order]
        runs[i] = len(order), 1 + sum(a != b for a, b in zip(before, before[1:]))
        steps |= {(i, p, order.index(k - 1 if k else len(text))) for p, k in enumerate(order)}
        common = lambda a, b: next((n for n, (x, y) in enumerate(zip(text[a:], text[b:])) if x != y), min(len(text) - a, len(text) - b))
        shared |= {(i, k, common(order[p - 1], k) if p else 0) for p, k in enumerate(order)}

    assert len(textindex.suffix_ranks(["ab", "", "ba"])[0]) == 3
    assert {r.doc_id: (r.length, r.runs) for r in textindex.transform_runs(table).collect()} == runs
    assert {tuple(r) for r in textindex.steps_back(table).collect()} == steps
    assert {tuple(r) for r in textindex.common_prefixes(table).collect()} == shared
