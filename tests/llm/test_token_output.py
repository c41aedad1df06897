import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pathloom.llm import queries, token_output
from pathloom.llm.tokens import encoder

PATH = queries.tokenizer_path()


@given(st.lists(st.integers(1, 30), max_size=80))
@settings(max_examples=80, deadline=None)
def test_best_fit_decreasing_is_the_textbook_rule(lengths):
    row_of, column_of, n = token_output.best_fit_decreasing(lengths, 30)
    free, count = [], 0
    for size in sorted(lengths, reverse=True):
        fits = [f for f in free if f >= size]
        if fits:
            free[free.index(min(fits))] -= size
        else:
            free.append(30 - size)
    assert n == len(free)
    held = defaultdict(list)
    for r, c, size in zip(row_of, column_of, lengths):
        held[r].append((c, size))
    for pieces in held.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + s == b for (a, s), (b, _) in zip(pieces, pieces[1:])) and sum(s for _, s in pieces) <= 30


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(token_output, "CHUNK_TOKENS", 3000)
    rows = [(i, f"Text number {i}. " * (i % 40)) for i in range(200)] + [(None, "x"), (7, None), (7, "a  b"), (9, " ".join(f"w{i}" for i in range(6000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("file", F.lit(0)).coalesce(2)
    manifest = token_output.write_token_files(docs, PATH, token_output.scratch_folder(docs))
    got = token_output.read_token_files(manifest).collect()
    assert manifest.count() >= 2 and manifest.agg(F.sum("n_segments")).first()[0] == len(got)
    library, want = encoder(PATH).library, Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        for p, s in enumerate(range(0, len(ids), 4096)):
            want[i, p, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r.file, r.row].append((r.offset, r.length))
    for pieces in held.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + s == b for (a, s), (b, _) in zip(pieces, pieces[1:])) and sum(s for _, s in pieces) <= 4096


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_output.read_token_files(token_output.write_token_files(docs, PATH, token_output.scratch_folder(docs))).collect() == []
