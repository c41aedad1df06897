"""Bracketed tree files, symbol dictionaries, frequency files and index folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pathloom.operators.forest import parse_trees
from pathloom.scratch import numbered

INDEX_VERSION = "pathloom-paths-1"


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(entry, title, tree, line) of files with ``>title`` rows, each followed by one bracket string per tree.

    Entries count titles from 0, trees count within their entry; a last line without an end is kept.
    """
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("at", "line"))
    lines = lines.where(F.trim("line") != "")
    # Entries are numbered over all files in order: within a file by a running sum, and after the files before it.
    mark = F.col("line").startswith(">").cast("long")
    files = lines.groupBy("file").agg(F.sum(mark).alias("titles"))
    files = files.select(F.col("file").alias("f"), (F.sum("titles").over(Window.orderBy("file")) - F.col("titles")).alias("before"))
    numbered = lines.withColumn("own", F.sum(mark).over(Window.partitionBy("file").orderBy("at")) - 1)
    titled = numbered.join(F.broadcast(files), F.col("file") == F.col("f")).withColumn("entry", F.col("own") + F.col("before"))
    own = Window.partitionBy("entry").orderBy("file", "at")
    titled = titled.withColumn("title", F.regexp_replace(F.first("line").over(own), r"^>|\.seqs$", ""))
    trees = titled.where(~F.col("line").startswith(">"))
    return trees.select("entry", "title", (F.row_number().over(own) - 1).cast("long").alias("tree"), "line")


def read_forest(spark: SparkSession, path: str) -> DataFrame:
    """The nodes of a sequence file's trees."""
    return parse_trees(read_sequences(spark, path).select("entry", "tree", "line"))


def input_size(sequences: DataFrame) -> DataFrame:
    """One row: entries, trees, nodes."""
    nodes = F.sum(F.size(F.regexp_extract_all("line", F.lit(r"([({\[])"), F.lit(1))))
    return sequences.agg(F.count_distinct("entry").alias("entries"), F.count("*").alias("trees"), nodes.cast("long").alias("nodes"))


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    """(code, label) from rows ``otoi['c'] = "label";``."""
    row = r"^otoi\['(.)'\]\s*=\s*\"([^\"]*)\";"
    return spark.read.text(path).where(F.col("value").rlike(row)).select(F.regexp_extract("value", row, 1).alias("code"), F.regexp_extract("value", row, 2).alias("label"))


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """(entry, title, suspicious): titles; a colon in one would break frequency files."""
    found = read_sequences(spark, path).select("entry", "title").distinct()
    return found.withColumn("suspicious", F.col("title").contains(":"))


def read_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """(path, graph, freq) from lines ``path graph:count graph:count ..``; the count is the whole number after the last colon."""
    w = F.split(F.trim("value"), " ")
    rows = spark.read.text(path).where(F.trim("value") != "").select(w[0].alias("path"), F.explode(F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0)))).alias("pair"))
    return rows.select("path", F.regexp_extract("pair", r"^(.*):\d+$", 1).alias("graph"), F.regexp_extract("pair", r":(\d+)$", 1).cast("long").alias("freq"))


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """A saved path index; another version is refused."""
    version = spark.read.text(f"{folder}/version").first()
    if version is None or version[0] != INDEX_VERSION:
        raise ValueError("not a path index of this version")
    return spark.read.parquet(f"{folder}/paths")


def graph_list(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(name, index): files of a folder in the order of names."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    return numbered(names, "index", "name", start=0)
