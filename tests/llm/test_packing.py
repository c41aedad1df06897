import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pathloom.llm import packing, queries
from pathloom.llm.tokens import Encoder, encoder

PATH = queries.tokenizer_path()


@given(st.lists(st.integers(1, 50), max_size=60), st.sampled_from(["norm", "dot"]), st.integers(2, 9), st.integers(2500, 6000))
@settings(max_examples=60, deadline=None)
def test_no_constraint_is_broken(lengths, rule, documents, cost):
    limits = packing.Limits(tokens=50, documents=documents, cost=cost, rule=rule)
    sizes = np.array(lengths, np.int64)
    bins, offsets = packing.best_fit(sizes, limits)
    held = defaultdict(list)
    for b, o, n in zip(bins, offsets, sizes):
        held[b].append((o, n))
    for pieces in held.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:]))
        assert sum(n for _, n in pieces) <= 50 and len(pieces) <= documents and sum(n * n for _, n in pieces) <= cost


def plain_best_fit(lengths, limits):
    """The rule in the docstring, word for word: every open bin is looked at for every piece."""
    caps, bins, out = (limits.tokens, limits.documents, limits.cost), [], [None] * len(lengths)
    for at in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = [x / c for x, c in zip((lengths[at], 1, lengths[at] ** 2), caps)]
        best = None
        for k, free in enumerate(bins):
            if all(f >= x - 1e-12 for f, x in zip(free, need)):
                if limits.rule == "norm":
                    score = sum(w * (f - x) ** 2 for w, f, x in zip(limits.weights, free, need))
                else:
                    score = -sum(w * f * x for w, f, x in zip(limits.weights, free, need))
                if best is None or score < best[0] - 1e-12:
                    best = score, k
        if best is None:
            bins.append([1.0, 1.0, 1.0])
            best = 0, len(bins) - 1
        out[at] = best[1]
        bins[best[1]] = [f - x for f, x in zip(bins[best[1]], need)]
    return out


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("documents, cost", [(4, 2500), (9, 3000), (50, 6000)])
def test_is_the_plain_best_fit(rule, documents, cost):
    rng = np.random.default_rng(documents)
    limits = packing.Limits(tokens=50, documents=documents, cost=cost, weights=(1.0, 0.31, 0.17), rule=rule)
    for _ in range(20):
        lengths = rng.integers(1, 50, rng.integers(1, 60))
        bins, _ = packing.best_fit(lengths, limits)
        assert bins.tolist() == plain_best_fit(lengths.tolist(), limits)


def test_the_rules_and_capacities_differ():
    lengths = np.random.default_rng(2).integers(1, 50, 300)
    most = lambda **k: packing.best_fit(lengths, packing.Limits(tokens=50, **k))[0]
    assert (most(documents=50, cost=2500) != most(documents=50, cost=2500, rule="dot")).any()
    lengths = lengths % 12 + 1
    assert most(documents=2, cost=2500).max() > most(documents=50, cost=2500).max()
    assert max(np.bincount(most(documents=2, cost=2500))) == 2


def test_identical_rows_spread(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 20_000)
    pieces = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(1).cast("long").alias("length"))
    got = packing.pack(pieces, packing.Limits(documents=512)).groupBy("sequence_id").agg(F.count("*").alias("n"), F.max("offset").alias("last")).collect()
    shards = {r.sequence_id >> 32 for r in got}
    assert len(shards) == 5 and sum(r.n for r in got) == 100_000 and all(r.n == r.last + 1 <= 512 for r in got)
    assert len(got) <= 100_000 // 512 + 1 + len(shards)


def test_packs_near_the_bound_and_rejects_what_cannot_fit():
    sizes = np.minimum(4096, np.random.default_rng(1).lognormal(6, 1.2, 4000).astype(int) + 1)
    bins, _ = packing.best_fit(sizes, packing.Limits())
    assert bins.max() + 1 <= sizes.sum() / 4096 + 2
    with pytest.raises(ValueError):
        packing.best_fit(np.array([9]), packing.Limits(tokens=8))


ODD = ["ẖ H̱x Å É. don't I'M we'll, 12abc a1.b ﬁx İ ΣΑΣ.", "\x1c a\x1cb\t x　y 日本語 한국", "<|endoftext|> a", "", None, "  \n ", "a_b _. ½. ²", "K. \x00 z"]


def test_ids_are_the_library_ids():
    own = Encoder(PATH)
    for text, ids in zip(ODD, own.encode(ODD)):
        assert np.frombuffer(ids, "<u4").tolist() == own.library.encode(text or "", add_special_tokens=False).ids


def test_contract_on_small_documents(spark):
    long_text = " ".join(f"word{i}." for i in range(9000))
    rows = [(i, t) for i, t in enumerate([*ODD, long_text, "same", "same"])] + [(None, "x"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit(1)).withColumn("sequence_id", F.lit("x"))
    got = packing.pack_documents(docs, PATH).collect()
    library = encoder(PATH).library
    want = defaultdict(list)
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want[i].append([(s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for s in range(0, len(ids), 4096)])
    have = defaultdict(list)
    for r in got:
        have[r.doc_id].append((r.start, r.length, r.ids_crc32))
        assert r.start == 4096 * r.piece
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(sum(v, [])) for k, v in want.items()}
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for pieces in held.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and sum(n for _, n in pieces) <= 4096


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
