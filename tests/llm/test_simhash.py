import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from pathloom.llm import simhash


def plain(text, width):
    words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)] * bool(words)
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(prints, distance):
    parent = list(range(len(prints)))
    for a, b in combinations(range(len(prints)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= distance:
            x, y = simhash._root(parent, a), simhash._root(parent, b)
            parent[max(x, y)] = min(x, y)
    return [simhash._root(parent, i) for i in range(len(prints))]


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(2000)]
    docs = [[rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 4, 30, 120]))] for _ in range(120)]
    base = [rng.choice(vocabulary) for _ in range(400)]
    for _ in range(150):
        own = list(base)
        for _ in range(rng.randrange(0, 8)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        docs.append(own)
    docs += [docs[5]] * 20
    rng.shuffle(docs)
    return [(3 * i + 1, " ".join(d)) for i, d in enumerate(docs)]


@pytest.mark.parametrize("part, block", [(4096, 2048), (16, 8), (2, 3)])
def test_against_all_pairs(spark, monkeypatch, part, block):
    monkeypatch.setattr(simhash, "PART", part)
    monkeypatch.setattr(simhash, "BLOCK", block)
    docs = corpus(part)
    want = [plain(t, 4) for _, t in docs]
    component = roots(want, 4)
    got = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width=4).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{p:016x}", docs[c][0]) for (i, _), p, c in zip(docs, want, component)}
    assert len(got) == len(docs) and len(set(component)) < len(docs) - 100


@pytest.mark.parametrize("distance, depth", [(4, 3), (4, 4), (4, 1), (2, 3), (0, 8), (7, 1)])
def test_lists_find_every_pair(spark, monkeypatch, distance, depth):
    monkeypatch.setattr(simhash, "PART", 6)
    monkeypatch.setattr(simhash, "BLOCK", 4)
    rng = random.Random(distance)
    prints = [rng.getrandbits(64) for _ in range(20)] + [0, 1, (1 << 64) - 1]
    for p in list(prints):
        for flips in (1, distance, distance, distance + 1):
            own = p
            for b in rng.sample(range(64), flips):
                own ^= 1 << b
            prints.append(own)
    prints = sorted(set(prints))
    nodes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    found = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.links(nodes, distance, depth, []).collect()]
    assert all((a ^ b).bit_count() <= distance for a, b in found)
    parent = {p: p for p in prints}
    for a, b in found:
        x, y = simhash._root(parent, a), simhash._root(parent, b)
        parent[max(x, y)] = min(x, y)
    assert [simhash._root(parent, p) for p in prints] == [prints[i] for i in roots(prints, distance)]


def test_many_alike_are_not_listed_pair_by_pair():
    rng = np.random.default_rng(1)
    flips = rng.integers(0, 32, (3000, 2))
    fp = np.unique((1 << flips[:, 0] ^ 1 << flips[:, 1]).astype(np.int64))
    found = simhash.list_links(fp, np.zeros(len(fp)), 4)
    assert len(found) == len(fp) - 1


def test_odd_rows(spark):
    long_text = " ".join(f"w{i % 7919}x{i % 13}" for i in range(150_000))
    docs = [(9, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "oNE\ttwo"), (6, "one two three four"), (None, "one two"), (None, "q"), (8, "z y"), (8, "one two"), (7, long_text)]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"fp": F.lit("x"), "at": F.lit(1), "component": F.lit(None)})
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(table, width=4).collect()), key=str)
    p = lambda t: f"{plain(t, 4):016x}"
    zero = "0" * 16
    assert got == sorted([(9, zero, 2), (2, zero, 2), (3, zero, 2), (4, p("one two"), 4), (5, p("one two"), 4), (6, p("one two three four"), 6), (None, p("one two"), 4), (None, p("q"), None), (8, p("z y"), 8), (8, p("one two"), 4), (7, p(long_text), 7)], key=str)
    assert simhash.near_duplicates(table.limit(0)).collect() == []


def test_bits_set_in_half_the_hashes_do_not_count():
    a, b = (xxh64_intdigest(s.encode(), 42) for s in ("x y", "y z"))
    assert simhash.fingerprint("x y z", 2) & (1 << 64) - 1 == a & b


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 91}" for i in range(500))
    whole = simhash.fingerprint(text, 4)
    monkeypatch.setattr(simhash, "SHINGLES_AT_ONCE", 7)
    assert simhash.fingerprint(text, 4) == whole == (plain(text, 4) ^ 1 << 63) - (1 << 63)
