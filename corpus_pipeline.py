"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``docs``. Rows are told apart by a key of 128 bits made of id
and text, so null and repeated ids are handled row by row: identical rows share
every decision, and near-duplicate removal keeps one of them.

Defined results: an empty table passes through every stage; a null text is
rejected by the quality rules; extra columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from pathloom.llm import decontam, neardup, packing, pii, quality
from pathloom.llm.common import discard, free_name, materialise, row_key, scratch_made, sent
from pathloom.llm.queries import tokenizer_path

#: Rows that go to Python at a time. Documents are long; ten times as many, the default, fill a worker's memory.
BATCH_ROWS = "1000"
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Of a packed sequence, besides 4096 tokens: it mixes no more documents than these.
SEQUENCE_DOCUMENTS = 32


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Plans that run inside send ``BATCH_ROWS`` rows to Python at a time; the session's setting comes back."""
    before = spark.conf.get(_BATCH_SETTING, None)
    spark.conf.set(_BATCH_SETTING, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.unset(_BATCH_SETTING) if before is None else spark.conf.set(_BATCH_SETTING, before)


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of id and text, and the key's name."""
    row = free_name(docs, "__row")
    return docs.withColumn(row, row_key("doc_id", "text")), row


def _without(keyed: DataFrame, row: str, removed: DataFrame) -> DataFrame:
    """The rows whose key is not in ``removed`` (one column of keys)."""
    gone = free_name(keyed, "__gone")
    removed = materialise(removed.toDF(gone).distinct(), "removed")
    return keyed.join(sent(removed), F.col(row) == F.col(gone), "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned list rejects go."""
    with small_batches(spark):
        labels = quality.sampled(spark.read.parquet(f"{sf_dir}/labels.parquet"))
        labelled = docs.select("doc_id", "text").join(F.broadcast(labels.select("doc_id")), "doc_id", "left_semi")
        rules = quality.learn(*quality.sample(quality.measures(labelled), labels))
    prefix = free_name(docs, "__q_")
    return quality.with_measures(docs, prefix).where(quality.as_expression(rules, prefix)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the least id, one row of it."""
    with small_batches(spark):
        keyed, row = _keyed(docs)
        # Ids in the order of preference: known ones first, then by number, then by key.
        ranked = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", F.col(row).alias("key"))
        found = neardup.near_duplicates(keyed.select(ranked.alias("rank"), "text"), width=5, id_column="rank")
        found = found.where("n_shingles > 0").select(F.col("doc_id.key").alias("key"), "kept")
        left = _without(keyed, row, found.where("not kept").select("key"))
        # Rows that occur several times with equal id and text are few; only they are shuffled.
        again = free_name(keyed, "__again")
        twice = materialise(found.where("kept").groupBy(F.col("key").alias(again)).count().where("count > 1").select(again), "twice")
        if twice.isEmpty():
            return left.select(*docs.columns)
        once = left.join(sent(twice), F.col(row) == F.col(again), "left_anti")
        several = left.join(sent(twice), F.col(row) == F.col(again), "left_semi").dropDuplicates([row])
        return once.union(several).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    with small_batches(spark):
        keyed, row = _keyed(docs)
        judged = decontam.contamination(keyed.select(row, "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_column=row)
        return _without(keyed, row, judged.where("contaminated").select("doc_id")).select(*docs.columns)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind, and terms that disclose it are generalised or removed."""
    with small_batches(spark):
        clean = pii.sanitise(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)
    return clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 4096 tokens and ``SEQUENCE_DOCUMENTS`` pieces."""
    with small_batches(spark):
        return packing.pack_documents(docs, tokenizer_path(), packing.Limits(tokens=4096, documents=SEQUENCE_DOCUMENTS))


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_neardup", near_dedup),
    ("decontamination", decontaminate),
    ("pii", remove_personal_data),
    ("best_fit_packing", pack),
]
#: Learned rules, sketches and tokenizers are beyond SQL; tests compare the result with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each one's result written and read again, and only the last one kept."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        written: list[str] = []
        with scratch_made() as made, small_batches(spark):
            docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}", written)
        discard(spark, [*before, *(path for path in made if path not in written)])
        before = written
    return docs
