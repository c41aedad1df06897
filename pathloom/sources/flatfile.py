"""Keyword flat files (12-column keywords, ``///`` between entries), reaction lists, features, mappings, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pathloom.operators.labels import codes
from pathloom.operators.reactions import expand_equation, valid
from pathloom.scratch import numbered, running


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """(record, entry, keyword, ord, data): one row per line of an entry; continued lines have the keyword before them.

    Records are split by Spark at their end mark, so files of any size are read in parallel. ``record`` tells entries of
    one name apart.
    """
    records = spark.read.option("lineSep", "\n///").text(path)
    clean = records.select(F.ltrim(F.regexp_replace("value", "\r", ""), F.lit("\n")).alias("r")).where(F.trim("r") != "")
    entry = F.regexp_extract("r", r"(?m)^ENTRY\s+(?:EC )?(\S+)", 1)
    lines = clean.select(F.monotonically_increasing_id().alias("record"), "r").select("record", entry.alias("entry"), F.posexplode(F.split("r", "\n")).alias("ord", "line"))
    keyword = F.trim(F.substring("line", 1, 12))
    w = Window.partitionBy("record").orderBy("ord")
    filled = F.last(F.when(keyword != "", keyword), ignorenulls=True).over(w)
    return lines.where(F.trim("line") != "").select("record", "entry", filled.alias("keyword"), "ord", F.trim(F.expr("substring(line, 13)")).alias("data"))


def blocks(entries: DataFrame) -> DataFrame:
    """(record, entry, keyword, data): the lines of a keyword joined by a blank."""
    return entries.groupBy("record", "entry", "keyword").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "data"))), lambda x: x["data"]), " ").alias("data"))


def reactions(entries: DataFrame) -> DataFrame:
    """(id, equation, subs, prods, rpairs, ec): reactions with their sides in order; every field is its own entry's."""
    wide = blocks(entries).groupBy("record", "entry").pivot("keyword", ["EQUATION", "RPAIR", "ENZYME"]).agg(F.first("data"))
    halves = F.split("EQUATION", "<=>")
    ids = lambda c, p: F.regexp_extract_all(c, F.lit(p), F.lit(1))
    return wide.select(
        F.col("entry").alias("id"), F.col("EQUATION").alias("equation"),
        ids(F.element_at(halves, 1), r"([CG]\d{5})").alias("subs"), ids(F.element_at(halves, 2), r"([CG]\d{5})").alias("prods"),
        F.coalesce(ids(F.col("RPAIR"), r"(RP\d{5}|C\d{5}_C\d{5})"), F.array().cast("array<string>")).alias("rpairs"),
        F.coalesce(codes(F.col("ENZYME")), F.array().cast("array<string>")).alias("ec"),
    )


def reaction_list(found: DataFrame) -> DataFrame:
    """(id, ligands): the expanded equations of valid reactions, ``p`` between the sides."""
    return found.where(valid(F.col("equation"))).select("id", expand_equation(F.col("equation")).alias("ligands"))


def read_reaction_list(spark: SparkSession, path: str) -> DataFrame:
    """(id, natoms, subs, prods) from lines ``id natoms C.. p C..``."""
    parts = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("w"))
    at = F.array_position("w", F.lit("p")).cast("int")
    return parts.select(F.element_at("w", 1).alias("id"), F.element_at("w", 2).cast("int").alias("natoms"), F.slice("w", F.lit(3), at - 3).alias("subs"), F.slice("w", at + 1, F.size("w") - at).alias("prods"))


def read_features(spark: SparkSession, path: str, skip: tuple[str, ...] = ("RING",)) -> DataFrame:
    """(mol, atom, feature, context, value, dirs) from lines ``mol:atom:FEATURE:context=(value,neighbour=value..)``; values
    of branches are sorted, a comma at the end is harmless."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"^[^:]+:\d+:[A-Z_]+:\d+=")).select(F.split("value", ":", 4).alias("w"))
    told = F.rtrim(F.regexp_extract(F.col("w")[3], r"^\d+=\(?([^)]*)\)?\s*$", 1), F.lit(","))
    rows = lines.select(F.col("w")[0].alias("mol"), F.col("w")[1].cast("int").alias("atom"), F.col("w")[2].alias("feature"), F.split_part(F.col("w")[3], F.lit("="), F.lit(1)).cast("int").alias("context"), told.alias("told"))
    rows = rows.where(~F.col("feature").isin(*skip)) if skip else rows
    rows = rows.withColumn("parts", F.split("told", ","))
    first, any_ = F.get("parts", F.lit(0)), F.col("told").contains("=")  # most lines have no branch, and a value in front; these take no search
    branches = F.filter("parts", lambda p: p.contains("="))
    entries = F.sort_array(F.transform(branches, lambda p: F.struct(F.substring_index(p, "=", 1).cast("int").alias("key"), F.substring_index(F.substring_index(p, "=", 2), "=", -1).alias("value"))))
    own = F.filter("parts", lambda p: ~p.contains("="))
    value = F.when(any_ & first.contains("="), F.try_element_at(own, F.lit(1))).otherwise(first)
    dirs = F.map_from_entries(F.when(any_, entries).otherwise(F.array().cast("array<struct<key:int,value:string>>")))
    return rows.select("mol", "atom", "feature", "context", value.alias("value"), dirs.alias("dirs"))


def read_reaction_sides(spark: SparkSession, path: str) -> DataFrame:
    """(reaction, side, at, ligand) from files of one reaction each: its name is in the first six characters, and the second
    line says ``A B => C``. ``at`` counts the ligands of a side from 0, repeated ones too. Lines after the second are
    left to other readers; without an arrow all ligands are substrates, and without a second line there are none."""
    lines = spark.read.text(path, wholetext=True).select(F.split("value", r"\r?\n").alias("l"))
    words = F.filter(F.split(F.trim(F.coalesce(F.try_element_at("l", F.lit(2)), F.lit(""))), r"\s+"), lambda w: w != "")
    found = lines.select(F.trim(F.substring(F.col("l")[0], 1, 6)).alias("reaction"), words.alias("w"))
    cut = F.array_position(F.transform("w", lambda w: w.contains("=>")), F.lit(True)).cast("int")
    found = found.withColumn("cut", F.when(cut > 0, cut - 1).otherwise(F.size("w"))).select("reaction", "cut", F.posexplode("w").alias("k", "ligand")).where("k <> cut")
    return found.select("reaction", F.when(F.col("k") < F.col("cut"), "s").otherwise("p").alias("side"), F.when(F.col("k") < F.col("cut"), F.col("k")).otherwise(F.col("k") - F.col("cut") - 1).alias("at"), "ligand")


def read_rpair_definitions(spark: SparkSession, path: str, placed: bool = False) -> DataFrame:
    """(reaction, sub, prod, type) from lines of four words; ``placed`` adds ``place``, which rises along each file."""
    w = F.split(F.trim("value"), r"\s+")
    place = [F.monotonically_increasing_id().alias("place")] if placed else []
    lines = spark.read.text(path).select("value", *place)
    return lines.where(F.size(w) >= 4).select(w[0].alias("reaction"), w[1].alias("sub"), w[2].alias("prod"), w[3].alias("type"), *(["place"] if placed else []))


def rpairs(entries: DataFrame) -> DataFrame:
    """(id, name, reactions, align): pair entries; align is the list of (left atom, right atom) numbers."""
    wide = blocks(entries).groupBy("record", "entry").pivot("keyword", ["NAME", "REACTION", "ALIGN"]).agg(F.first("data"))
    pairs = F.transform(F.regexp_extract_all("ALIGN", F.lit(r"(\d+:\S+\s+\d+:\S+)"), F.lit(1)), lambda p: F.struct(F.regexp_extract(p, r"^(\d+):", 1).cast("int").alias("a"), F.regexp_extract(p, r"\s(\d+):", 1).cast("int").alias("b")))
    return wide.select(F.col("entry").alias("id"), F.col("NAME").alias("name"), F.regexp_extract_all("REACTION", F.lit(r"(R\d{5})"), F.lit(1)).alias("reactions"), pairs.alias("align"))


def read_mapping_report(spark: SparkSession, path: str) -> DataFrame:
    """(reaction, lhs_atom, rhs_atom) from mapping reports: the atom rows of each report, under the last REACTION line.

    Reports are split by Spark at that line, so files of any size are read in parallel and a task holds a report at a time.
    """
    texts = spark.read.option("lineSep", "\nREACTION").text(path).select(F.monotonically_increasing_id().alias("report"), "value")
    # What follows the mark begins with a blank; only the first report of a file still has it.
    texts = texts.select("report", F.when(F.col("value").rlike(r"^[ \t]"), F.concat(F.lit("REACTION"), "value")).otherwise(F.col("value")).alias("value"))
    name = F.nullif(F.regexp_extract("value", r"^REACTION\s+(\S+)", 1), F.lit(""))
    lines = texts.select("report", name.alias("reaction"), F.posexplode(F.split("value", "\n")).alias("ord", "line"))
    w = Window.partitionBy("report").orderBy("ord")
    head = F.when(F.col("line").rlike("^[A-Z]{3,}"), F.regexp_extract("line", "^([A-Z]+)", 1))
    filled = lines.withColumn("section", F.last(head, ignorenulls=True).over(w))
    filled = filled.where("section <> 'BONDS'")
    row = r"^\s*(\d+)\s+\S+\s+(\d+)\s+\S+\s*$"
    return filled.where(F.col("line").rlike(row)).select("reaction", F.regexp_extract("line", row, 1).cast("int").alias("lhs_atom"), F.regexp_extract("line", row, 2).cast("int").alias("rhs_atom"))


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) from lines of two numbers."""
    w = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.col("value").rlike(r"^\s*\d+\s+\d+")).select(w[0].cast("int").alias("src"), w[1].cast("int").alias("dst"))


def read_tagged(spark: SparkSession, path: str) -> DataFrame:
    """(tag, ord, fields): tagged records, one per line, in the order of the file."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\r", ""), "\n")).alias("ord", "line"))
    w = F.split(F.trim("line"), r"\s+")
    return whole.where(F.trim("line") != "").select(w[0].alias("tag"), "ord", F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))).alias("fields"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(row_no, line): the lines of a file, or of a folder's files in the order of their names, numbered from 0.

    Lines are read in splits; a split knows its file and where it begins, and the lines in it stand in order, so they are
    numbered by ranges (``scratch.numbered``) and no task holds more than a split.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    return numbered(lines, "row_no", "file", "start", "at", start=0).select("row_no", F.col("value").alias("line"))


def read_code_table(spark: SparkSession, path: str) -> DataFrame:
    """(row_no, codes, used, forward): rows of integers in the file's order; used rows have a first number above 0 and
    alternate between forward and backward."""
    rows = numbered_lines(spark, path).select(F.col("row_no").cast("int").alias("row_no"), F.transform(F.regexp_extract_all("line", F.lit(r"(-?\d+)"), F.lit(1)), lambda x: x.cast("int")).alias("codes"))
    rows = rows.where(F.size("codes") > 0).withColumn("used", F.coalesce(F.get("codes", F.lit(0)) > 0, F.lit(False)))
    counted = running(rows.withColumn("one", F.col("used").cast("int")), "before", "one", "row_no").drop("one")
    return counted.withColumn("forward", F.when(F.col("used"), F.col("before") % 2 == 0)).drop("before")


def read_triples(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(path_id, graph_id, freq) from a sparse triple file whose first line holds the sizes (value 0)."""
    raw = spark.read.option("sep", " ").schema("path_id long, graph_id long, freq long").csv(path)
    return raw.where("freq <> 0") if header else raw


def transpose(triples: DataFrame) -> DataFrame:
    return triples.select(F.col("graph_id").alias("path_id"), F.col("path_id").alias("graph_id"), "freq")
