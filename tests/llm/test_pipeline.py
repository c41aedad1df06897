import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pathloom.llm import pii, queries
from pathloom.llm.common import words
from pathloom.llm.tokens import encoder


def fixture(folder, spark):
    rng = random.Random(11)
    vocabulary = [f"word{i}" for i in range(4000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    clean = {i: text(rng.randrange(30, 90)) for i in range(0, 120)}
    junk = {i: " ".join(f"{w}###" for w in text(40).split()) for i in range(200, 260)}
    benchmark = [(k, text(30)) for k in range(5)]
    docs = [*clean.items(), *junk.items()]
    docs += [(300 + k, clean[k]) for k in range(10)]  # copies
    near = {400 + k: clean[20 + k] + " added" for k in range(10)}  # near copies
    docs += near.items()
    docs += [(500 + k, f"{text(30)} {benchmark[k % 5][1]} {text(20)}") for k in range(8)]
    private = {600 + k: f"{text(25)} write to a{k}.b@mail.example today {text(10)}" for k in range(6)}
    docs += private.items()
    long = {700: text(9000)}
    docs += long.items()
    odd = [(800, None), (801, ""), (802, "few words only"), (None, text(30)), (3, clean[3])]  # the last row is a repeated one
    docs += odd
    labels = [(i, 1, 0) for i in clean] + [(i, 0, 0) for i in junk if i % 2] + [(None, 0, 0), (5, None, 1), (99999, 0, 0)]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None, "x") for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long, __gone string")
    frame.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    survivors = {**clean, **private, **long, None: odd[3][1]}
    return frame.columns, survivors


def expected_text(text):
    spans, out, at = pii.base_spans(text), [], 0
    for a, kind, b in spans:
        out += [text[at:a], f"[{pii.KINDS[kind].upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def test_stages_against_what_was_planted(spark, tmp_path):
    columns, survivors = fixture(str(tmp_path), spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(docs.count())
        if name == "pii":
            got = {r.doc_id: r for r in docs.collect()}
            # A term that only ever stands near addresses may go too.
            assert {i: " ".join(words(r.text.replace("write", "").replace("today", "")) and r.text.split()) for i, r in got.items() if i is None or i < 600 or i > 606} == {i: " ".join(t.split()) for i, t in survivors.items() if i is None or i < 600 or i > 606}
            for i in range(600, 606):
                assert "[EMAIL]" in got[i].text and "@" not in got[i].text and got[i].n_chars == len(got[i].text)
            texts = {i: r.text for i, r in got.items()}
    assert counts[:4] == [len(survivors) + 10 + 10 + 8 + 1, len(survivors) + 8, len(survivors), len(survivors)]
    library = encoder(queries.tokenizer_path()).library
    want = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    have = {}
    for r in docs.collect():
        have[r.doc_id] = have.get(r.doc_id, 0) + r.length
    assert have == want

    whole = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.piece, r.length, r.ids_crc32)
    assert sorted(map(key, whole.collect())) == sorted(map(key, docs.collect()))


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_the_session_and_the_documents_of_a_sequence(spark, tmp_path, monkeypatch):
    fixture(str(tmp_path), spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    monkeypatch.setattr(corpus_pipeline, "SEQUENCE_DOCUMENTS", 5)
    docs = corpus_pipeline.run(spark, str(tmp_path))
    assert spark.conf.get(name, None) == before
    held = docs.groupBy("sequence_id").agg(F.count("*").alias("n"), F.sum("length").alias("tokens")).collect()
    assert max(r.n for r in held) == 5 and max(r.tokens for r in held) <= 4096
