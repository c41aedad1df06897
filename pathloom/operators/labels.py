"""Label extraction: codes of entries, multi-label matrices, files of entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed pattern: three dotted fields of digits or a dash, then a fourth.
EC = r"(?:\d+|-)\.(?:\d+|-)\.(?:\d+|-)\.(?:[A-Za-z]?\d+|-)"


def codes(text: Column) -> Column:
    """The distinct codes in a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({EC})"), F.lit(1))))


def multi_label(labels: DataFrame, values: list[str]) -> DataFrame:
    """(item, 0/1 for each of ``values``) from (item, label)."""
    return labels.groupBy("item").agg(*(F.max((F.col("label") == v).cast("int")).alias(f"is_{v}") for v in values))


def label_values(labels: DataFrame) -> DataFrame:
    """The distinct labels with their column number, from 0 in sorted order."""
    from pyspark.sql import Window

    return labels.select("label").distinct().withColumn("column", F.row_number().over(Window.orderBy("label")) - 1)


def graph_files(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Files (name) of entries (id): names that begin with the id, a file once for an id that several entries have. Ids of one
    length meet in an equi-join on the prefix."""
    entries = entries.select("id").distinct()
    lengths = [r[0] for r in entries.select(F.length("id")).distinct().collect()]
    keyed = files.select("name", F.explode(F.array(*[F.substring("name", 1, n) for n in lengths])).alias("id")) if lengths else files.select("name", F.lit(None).cast("string").alias("id"))
    return keyed.join(entries, "id")
