import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import decontam
from pathloom.llm.common import words


def best_stretch(same):
    """The most matches of a maximal segment of one alignment, token by token."""
    best = total = top = count = matched = 0
    for good in [*same, None]:
        if good:
            if total == 0:
                top = count = 0
            total, count = total + 2, count + 1
            if total >= top:
                top, matched = total, count
        elif total:
            total -= 3
            if total <= 0 or good is None:
                best, total = max(best, matched), 0
    return best


def brute(passage, items):
    """Every alignment of every item, not only those with a hit."""
    found = {}
    tokens = words(passage)
    for item, text in items:
        own = words(text)
        for shift in range(-len(own) + 1, len(tokens)):
            same = [tokens[shift + k] == w if 0 <= shift + k < len(tokens) else False for k, w in enumerate(own)]
            if own and sum(same) >= min(decontam.MIN_MATCHED, len(own)):
                matched = best_stretch(same)
                if matched >= min(decontam.MIN_MATCHED, len(own)) and matched >= min(decontam.MIN_COVER * len(own), decontam.LONG_MATCH):
                    found[item] = max(found.get(item, 0), matched)
    return found


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([6, 15, 25, 40]))) for i in range(12)] + [(50, None), (51, "  ")]
    docs = [(i, text(rng.randrange(0, 200))) for i in range(40)]
    for k in range(40):
        own = words(items[k % 12][1])
        changed = [w if rng.random() > 0.12 else b"other" for w in own]
        piece = b" ".join(changed[: len(own) if k % 3 else max(9, 2 * len(own) // 3)]).decode().upper()
        docs.append((100 + k, f"{text(30)} {piece}\n{text(20)}"))
    docs += [(None, items[2][1]), (300, None), (301, ""), (302, "\t "), (0, docs[0][1]), (400, f"{text(4_000)} {items[3][1]} {text(10)}")]
    return items, docs


def hit(passage, text):
    """Whether some seed meets an aligned window of the texts: what the method can find at all."""
    tokens, own = words(passage), words(text)
    for kept, span in decontam.seeds_of(len(own)):
        windows = {tuple(own[k + x] for x in kept) for k in range(len(own) - span + 1)}
        if any(tuple(tokens[k + x] for x in kept) in windows for k in range(len(tokens) - span + 1)):
            return True
    return False


def test_against_all_alignments(spark):
    items, docs = corpus()
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("matched", F.lit("x"))
    got = decontam.contamination(table, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(docs)
    want, missed = Counter(), 0
    for d, t in docs:
        found = brute(t, items)
        met = sorted(i for i in found if hit(t, dict(items)[i]))
        missed += len(found) - len(met)
        want[d, bool(met), tuple(met)] += 1
    assert Counter((r.doc_id, r.contaminated, tuple(r.item_ids)) for r in got) == want
    assert missed <= 1 and sum(n for (_, bad, _), n in want.items() if bad) >= 25


@pytest.mark.parametrize("bits", [27, 6])
def test_the_filter_changes_nothing(spark, monkeypatch, bits):
    monkeypatch.setattr(decontam, "FILTER_BITS", bits)
    items, docs = corpus(5)
    docs = docs[:80]
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, tuple(r.item_ids), r.matched) for r in decontam.contamination(table, bench).collect()}
    assert got == {(d, tuple(m := sorted(i for i in f if hit(t, dict(items)[i]))), max((f[i] for i in m), default=0)) for d, t in docs for f in [brute(t, items)]}


def test_ids_and_repeated_rows(spark):
    one, two = " ".join(f"a{k}" for k in range(12)), " ".join(f"b{k}" for k in range(5))
    bench = spark.createDataFrame([(None, one), (-1, one), (-1, one), (7, one), (7, two)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {one} y"), (1, f"x {one} y"), (2, f"{two.upper()} z"), (3, "b0 b1 b2 b3"), (4, f"{two} {one}")], "doc_id long, text string").withColumn("key", F.lit(1))
    got = sorted((r.doc_id, r.n_items, r.item_ids, r.best_item, r.matched, r.begin, r.end) for r in decontam.contamination(docs, bench).collect())
    hit_one = (1, 3, [-1, 7, None], -1, 12, 1, 13)
    assert got == [hit_one, hit_one, (2, 1, [7], 7, 5, 0, 5), (3, 0, [], None, 0, None, None), (4, 4, [-1, 7, 7, None], -1, 12, 5, 17)]


def test_a_repeated_word(spark):
    item = np.array(decontam.word_hashes([b"w"] * 30))
    for tokens in (np.repeat(item[:1], 20_000), np.tile(decontam.word_hashes([b"w", b"v"]), 10_000)):
        began = time.time()
        own = np.concatenate([decontam.spaced_hashes(item, *s) for s in decontam.seeds_of(30)])
        at = [np.flatnonzero(np.isin(decontam.spaced_hashes(tokens, *s), own)) for s in decontam.LONG_SEEDS]
        pairs = [{"at": a, "places": range(30 - s[1] + 1)} for a, s in zip(at, decontam.LONG_SEEDS)]
        found = decontam.verified(tokens, item, decontam._shifts(len(tokens), 30, pairs))
        assert time.time() - began < 1 and found == ((30, 0, 30) if tokens[1] == tokens[0] else None)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [r.contaminated for r in decontam.contamination(docs, none).collect()] == [False]
    assert decontam.contamination(docs.limit(0), none).collect() == []


def test_runs_of_eight(spark):
    items = [(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in range(8, 17)]
    docs = []
    for n, t in items:
        own = t.split()
        docs += [f"a b {' '.join(own[k : k + 8])} c d" for k in range(n - 7)]
    nine = items[1][1].split()
    docs += [" ".join(["a", *nine[1:]]), " ".join([*nine[:-1], "a"])] + [" ".join([*nine[:k], "a", *nine[k + 1 :]]) for k in range(2, 7)]
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontam.contamination(table, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {i: sorted(brute(t, items)) for i, t in enumerate(docs)}
    assert got == want and all(want.values())
