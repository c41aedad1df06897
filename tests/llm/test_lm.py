import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pathloom.llm import lm
from pathloom.llm.common import words


def stream(text):
    return ["<s>", *words(text), "</s>"]


def brute(docs):
    """Scores with dictionaries of counts; weights by the operator's own EM on a table made here."""
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5
    uni, bi, ctx = ({k: Counter() for k in ("part", "all")} for _ in range(3))
    for i, t in docs:
        s = stream(t)
        for kind in (["all"] if fold(i) != 1 else []) + (["part"] if fold(i) not in (1, 4) else []):
            uni[kind].update(s[1:])
            ctx[kind].update(s[:-1])
            bi[kind].update(zip(s, s[1:]))
    n, v = sum(uni["all"].values()), len(uni["all"])
    m = sum(uni["part"].values())
    cells = Counter()
    for i, t in docs:
        if fold(i) == 4:
            s = stream(t)
            for a, b in zip(s, s[1:]):
                c1 = ctx["part"][a]
                pair, single = (bi["part"][a, b] / c1 if c1 else 0) * (v + 1), uni["part"][b] / max(m, 1) * (v + 1)
                cells[int(lm.context_bucket(np.array([c1]))[0]) * lm.GRID**2 + int(lm._cell(np.array([pair]))[0]) * lm.GRID + int(lm._cell(np.array([single]))[0])] += 1
    w = lm.learn_weights(pd.DataFrame(sorted(cells.items()), columns=["cell", "k"]))
    out = defaultdict(list)
    for i, t in docs:
        s, base, score, known = stream(t), 0.0, 0.0, 0
        for a, b in zip(s, s[1:]):
            c, c1 = uni["all"][b], ctx["all"][a]
            w2, w1, w0 = w[int(lm.context_bucket(np.array([c1]))[0])]
            base += math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
            score += math.log10((w2 * bi["all"][a, b] / c1 if c1 else 0) + w1 * c / max(n, 1) + w0 / (v + 1))
            known += c > 0
        out[i].append((fold(i) == 1, len(s) - 1, known, n, round(base, 6), round(score, 6)))
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(200):
        w, text = rng.choice(vocabulary), []
        for _ in range(rng.randrange(0, 50)):
            w = vocabulary[(int(w[1:]) * 7 + rng.choice([1, 1, 1, 5, 11])) % 60] if rng.random() < 0.9 else f"rare{rng.randrange(999)}"
            text.append(w.upper() if rng.random() < 0.1 else w)
            w = w if w[1:].isdigit() else "w0"
        docs.append((i * 3, "\t ".join(text)))
    return docs + [(None, "w1 w2"), (None, None), (7000, None), (7001, ""), (7001, "w3"), (3, docs[1][1])]


@pytest.mark.parametrize("chunk, buckets, fan", [(2_000_000, None, 4096), (400, 5, 4096), (60, 1, 4096), (400, 9, 3), (100, 8, 2), (100, 7, 3)])
def test_against_dictionaries(spark, monkeypatch, chunk, buckets, fan):
    """With a fan of 3 or 2 counts and answers pass two or three levels."""
    monkeypatch.setattr(lm, "CHUNK", chunk)
    monkeypatch.setattr(lm, "FAN", fan)
    docs = corpus()
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("chunk", F.lit(1))
    got = lm.score(table, buckets=buckets).collect()
    have = defaultdict(list)
    for r in got:
        have[r.doc_id].append((r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)))
    want = brute(docs)
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # contexts help on unseen documents


def test_no_training_documents_and_empty_table(spark):
    only = [i for i in range(100) if lm.fold(i) == 1][:3]
    got = lm.score(spark.createDataFrame([(i, "a b") for i in only], "doc_id long, text string")).collect()
    assert [(r.n_known, r.train_tokens) for r in got] == [(0, 0)] * 3 and all(math.isfinite(r.score) for r in got)
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_copies_of_whole_chunks(spark):
    rows = [(i, f"w{i % 3} w1 w2") for i in range(30)]
    part = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got, once = lm.score(part.union(part)).collect(), lm.score(part).collect()
    assert len(got) == 60 and got[0].train_tokens == 2 * once[0].train_tokens


def test_very_long_text(spark):
    got = lm.score(spark.createDataFrame([(0, "a b c " * 100_000), (2, "a b")], "doc_id long, text string")).collect()
    assert sorted(r.n_tokens for r in got) == [3, 300_001]


def test_totals_over_32_bits():
    """Counts of a word and a bigram in two chunks that add up to more than 2^32, through the exchange."""
    chunk = lm.Chunk.of([1], [np.array([5, 9, lm.END], np.uint64)])
    big = lm.Counts.of(chunk, "counting")
    big.pair_n[0] = big.word_n[0] = [4_000_000_000, 1, 2]
    none = np.zeros((2, 3), np.uint64)
    tuning, held = ((n[::-1], w[::-1]) if k else (n, w) for k, n, w in ((1, big.pair_n, big.word_n), (0, none, none)))
    parts = [lm.Counts(big.pairs, n, big.words, w, s) for (n, w), s in (((big.pair_n, big.word_n), (3_000_000_000, 0)), (tuning, (0, 3_000_000_000)), (held, (0, 0)))]
    part = pd.DataFrame({"node": 0, "slot": 0, "asker": ["a", "b", "c"], "role": ["counting", "tuning", "held"], "blob": [p.dump() for p in parts]})
    answers = lm._add_up(part)
    assert answers.iloc[0][["n", "v", "n_counting", "starts", "starts_counting"]].tolist() == [2 * 4_000_000_003, 3, 4_000_000_003, 6_000_000_000, 3_000_000_000]
    both = pd.DataFrame({"slot": [-1, 0], "asker": "a", "blob": [chunk.dump(), answers["blob"].iloc[0]]})
    _, _, c12, c1, c2 = lm._answered(both, 1, 6_000_000_000)
    assert sorted(c12.tolist()) == sorted(c2.tolist()) == [2.0, 4.0, 8_000_000_000.0] and c1[0] == 6_000_000_000
    assert lm._answered(both, 0, 3_000_000_000)[4].max() == 4_000_000_000


def test_what_is_sent_grows_with_the_chunks():
    """Ranges grow with the input as chunks do; what a chunk sends does not."""
    for terabytes in (0.001, 0.1, 1, 100):
        ranges = int(terabytes * 1e12) // lm.RANGE_BYTES
        exchange = lm.Exchange.of(ranges)
        assert exchange.fan <= lm.FAN and ranges <= exchange.fan**exchange.levels < 1.1 * ranges + 100
        assert exchange.levels == (1 if ranges <= lm.FAN else 2)


def test_ranges_are_cut_within_ranges():
    rng = np.random.default_rng(5)
    keys = lambda bits: np.unique(rng.integers(0, 1 << bits, 500, np.uint64, endpoint=False))
    pairs, words_ = keys(48), keys(63) * np.uint64(2)
    whole = lm.Counts(pairs, np.ones((2, len(pairs)), np.uint64), words_, np.ones((2, len(words_)), np.uint64), (7, 3))
    twice = [b for k, a in enumerate(whole.cut(0, 3, 3)) for b in a.cut(3 * k, 3, 9)]
    once = list(whole.cut(0, 9, 9))
    assert [(x.pairs.tolist(), x.words.tolist()) for x in twice] == [(x.pairs.tolist(), x.words.tolist()) for x in once]
    back, _ = lm.Counts.merged([lm.Counts.load(x.dump()) for x in once])
    assert back.pairs.tolist() == pairs.tolist() and back.words.tolist() == words_.tolist() and back.starts == (7, 3)
