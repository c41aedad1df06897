import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from pathloom.llm import neardup
from pathloom.llm.common import words
from pathloom.llm.components import components


def shingles(text, width):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(docs, width):
    sets = {i: shingles(t, width) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def corpus(seed, near=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, docs = text(60), []
    for _ in range(40):
        docs.append(text(rng.choice([1, 2, 3, 5, 20, 100, 400])))
    for _ in range(30):
        docs.append(text(rng.randrange(5, 60)) + passage + text(rng.randrange(5, 60)))  # a passage alone links nothing
    for base in (text(80), text(300), text(900)):
        for _ in range(near):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 40)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            docs.append(own)
    chain = text(200)
    for _ in range(12):  # neighbours are alike, the ends are not
        chain = chain[3:] + text(3)
        docs.append(chain)
    docs += [docs[0]] * 3 + [docs[60]] * 30
    rng.shuffle(docs)
    return [(i * 7, " ".join(w)) for i, w in enumerate(docs)]


@pytest.mark.parametrize("short_list, family", [(64, 1000), (64, 20), (4, 1)])
def test_against_all_pairs(spark, monkeypatch, short_list, family):
    monkeypatch.setattr(neardup, "SHORT_LIST", short_list)
    monkeypatch.setattr(neardup, "FAMILY", family)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "OUTSIDE_BLOCK", 8)
    docs = corpus(short_list)
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width=4).collect()
    want = brute(docs, 4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def at_the_threshold(seed):
    """Pairs of texts whose sets fit into the sketch, while their union is larger and holds just over four fifths in common."""
    rng = random.Random(seed)
    docs = []
    for k in range(40):
        for union, common in ((100, 80), (101, 81), (102, 82), (103, 83), (104, 84), (105, 84), (105, 85)):
            left = rng.randrange(max(0, union - common - 95 + common), min(95 - common, union - common) + 1)
            own = [f"u{len(docs)}x{i}" for i in range(common + 3)]  # 4 words a shingle
            more = lambda side, n: [f"{side}{len(docs)}x{i}" for i in range(n)]
            docs += [own + more("l", left), own + more("r", union - common - left)]
    return [(i, " ".join(w)) for i, w in enumerate(docs)]


@pytest.mark.parametrize("family", [1000, 1, 0])
def test_whole_sets_with_a_larger_union(spark, monkeypatch, family):
    monkeypatch.setattr(neardup, "FAMILY" if family else "FAMILY_SHINGLES", family)
    docs = at_the_threshold(4)
    sizes = [len(shingles(t, 4)) for _, t in docs]
    assert 80 <= min(sizes) and max(sizes) < neardup.SKETCH
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs, 4)


def test_odd_rows(spark):
    long_text = " ".join(f"w{i % 7919}x{i % 13}" for i in range(60_000))
    docs = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "oNE TWO"), (6, "one two three four"), (None, "one two"), (8, "z y"), (8, "one two"), (9, long_text), (10, long_text)]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("class", F.lit(1)).withColumn("v", F.lit(None))
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(table, width=4).collect()), key=str)
    n = len(shingles(long_text, 4))
    assert got == sorted([(0, 1, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (8, 1, 8, True), (8, 1, 4, False), (9, n, 9, True), (10, n, 9, False)], key=str)
    assert neardup.near_duplicates(table.limit(0)).collect() == []


def test_repeated_ids_link_nothing(spark):
    rng = random.Random(5)
    a = [f"a{rng.randrange(999)}" for _ in range(60)]
    near, other = " ".join([*a, "more"]), " ".join(f"b{k}" for k in range(60))
    docs = [(3, near), (5, " ".join(a)), (5, other), (9, other), (9, other), (9, f"{other} x"), (11, "y z")]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width=4).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 5, True), (9, 5, False), (9, 5, False), (9, 5, False), (11, 11, True)]


def test_ids_of_other_types(spark):
    rows = [(f"k{i}", f"one two three four five {i // 3}") for i in range(9)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string").select("doc_id", "text"), width=4).collect()}
    assert got == {f"k{i}": f"k{i - i % 3}" for i in range(9)}


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 200)] + [(5, 5)]
    parent = {}
    root = lambda x: x if parent.setdefault(x, x) == x else root(parent[x])
    for a, b in links:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(parent)}
