import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pathloom.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often, covered, seen, duplicates = Counter(windows), set(), set(), 0
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= set(range(i, i + 8))
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            duplicates += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), duplicates, len(covered)


def test_measures(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "The", "né", "日本", "x#", "<b>", "!!", "\x1c", " "])
    docs = [(i, "".join(word() + rng.choice(" \n\t\x0b\r") for _ in range(rng.randrange(0, 60)))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, "one two three four five six seven eight"), (None, "x"), (5, "again and again " * 20)]
    docs.append((300, " ".join(f"w{i % 5000}" for i in range(60_000))))
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_words", F.lit("x"))
    got = quality.measures(table).collect()
    have = Counter((r.doc_id, *(r[c] for c in quality.COUNTS)) for r in got)
    assert have == Counter((i, *brute(t)) for i, t in docs)
    assert quality.measures(table.limit(0)).collect() == []


def test_base_rule_and_empty_labels(spark):
    docs = [(1, "few words"), (2, " ".join(f"w{i}" for i in range(20))), (3, "a b c d e f g h i j " * 5), (4, None)]
    measured = quality.measures(spark.createDataFrame(docs, "doc_id long, text string"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rules = quality.learn(*quality.sample(measured, quality.sampled(labels)))
    assert rules == []
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.judge(measured, rules).collect()}
    assert got == {1: (True, False), 2: (False, True), 3: (True, False), 4: (True, False)}


def test_learned_rules_hold_on_unseen_rows():
    rng = np.random.default_rng(0)

    def draw(n):
        x = {c: rng.uniform(0, 1, n) for c in quality.RATIOS}
        bad = (x["symbol_rate"] > 0.7) & (x["mark_rate"] < 0.6) | (x["upper_rate"] > 0.9)
        return x, bad

    rules = quality.learn(*draw(6000))
    x, bad = draw(4000)
    rejected = np.logical_or.reduce([r.covers(x) for r in rules])
    assert 1 <= len(rules) <= quality.MAX_RULES
    assert (rejected & bad).sum() >= 0.9 * bad.sum() and (rejected & ~bad).sum() <= 0.02 * rejected.sum()


def plain_learn(x, bad):
    """Sequential covering, threshold by threshold and row by row."""
    n, left, out = len(bad), set(range(len(bad))), []
    holds = lambda c, i: x[c[0]][i] >= c[2] if c[1] else x[c[0]][i] < c[2]
    for _ in range(quality.MAX_RULES):
        grow = [i for i in left if i % 3 != 2]
        if sum(bad[i] for i in grow) <= quality.LEAST:
            break
        conditions = []
        while len(conditions) < quality.MAX_CONDITIONS:
            p = sum(bad[i] for i in grow)
            if not p or p == len(grow):
                break
            best = None
            for name in quality.RATIOS:
                values = sorted({x[name][i] for i in grow})
                for above in (False, True):
                    for a, b in zip(values, values[1:]):
                        c = (name, above, (a + b) / 2)
                        covered = [i for i in grow if holds(c, i)]
                        pp = sum(bad[i] for i in covered)
                        gain = pp * (np.log2(pp / len(covered)) - np.log2(p / len(grow))) if pp else -1
                        if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                            best = gain, c
            if best is None:
                break
            conditions.append(best[1])
            grow = [i for i in grow if holds(best[1], i)]
        if not conditions:
            break

        def covered(k):
            return [i for i in left if i % 3 == 2 and all(holds(c, i) for c in conditions[:k])]

        def worth(k):
            found = covered(k)
            return (2 * sum(bad[i] for i in found) - len(found)) / len(found) if found else -1.0

        k = max(range(1, len(conditions) + 1), key=lambda k: (worth(k), -k))
        tested = covered(k)
        p = sum(bad[i] for i in tested)
        if p > quality.LEAST and p >= quality.PRECISION * len(tested):
            out.append(conditions[:k])
        left -= {i for i in left if all(holds(c, i) for c in conditions[:k])}
    return out


def test_learns_what_the_plain_covering_learns():
    for seed in range(4):
        rng = np.random.default_rng(seed)
        x = {c: np.round(rng.uniform(0, 1, 150), 2) for c in quality.RATIOS}
        bad = (x["symbol_rate"] > 0.6) & (x["mark_rate"] < 0.7) | (x["upper_rate"] > 0.85) | (rng.random(150) < 0.02)
        got = [[(c.name, c.above, c.value) for c in r.conditions] for r in quality.learn(x, bad)]
        assert got == plain_learn(x, bad) and got


def test_repeated_ids_train_once(spark):
    docs = [(1, "a b " * 20)] * 500 + [(1, "c! " * 20), (2, "d e f " * 9), (3, None)]
    measured = quality.measures(spark.createDataFrame(docs, "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, 0), (4, 1), (None, 1), (5, None)], "doc_id long, quality int")
    x, bad = quality.sample(measured, quality.sampled(labels))
    assert len(bad) == 3 and sorted(bad.tolist()) == [False, True, True]
    assert sorted(x["mark_rate"].tolist()) == [0.0, 0.0, 0.0]


def test_noise_teaches_nothing():
    rng = np.random.default_rng(1)
    x = {c: rng.uniform(0, 1, 3000) for c in quality.RATIOS}
    assert quality.learn(x, rng.random(3000) < 0.1) == []


def test_expression_follows_the_order(spark):
    rules = [quality.Rule((quality.Condition("symbol_rate", True, 0.5), quality.Condition("mark_rate", False, 4.0))), quality.Rule((quality.Condition("upper_rate", True, 0.5),))]
    docs = [(1, "a# b# " * 15 + " ".join(f"v{i}" for i in range(30))), (2, " ".join(f"UPPER{i}" for i in range(30))), (3, " ".join(f"plain{i}" for i in range(30)))]
    judged = quality.judge(quality.measures(spark.createDataFrame(docs, "doc_id long, text string")), rules)
    got = {r.doc_id: (r.kept, r.rule_no) for r in judged.collect()}
    assert got[2] == (False, 2) and got[3] == (True, None)
    assert quality.as_text(rules).splitlines()[-1] == "else: keep"
