"""Molecule and reaction-graph files in fixed-column MOL form, and MOL2 files, as node and edge tables.

Files are read whole, one row per file; lines, sections and fields come from
built-in functions, so parsing runs inside the JVM on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pathloom.functions.columns import fixed
from pathloom.scratch import numbered


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of the files under ``path``."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), F.col("value").alias("text"))


def number_graphs(files: DataFrame) -> DataFrame:
    """``files`` with g, their number from 0 in the order of names."""
    return files.join(numbered(files.select("name").distinct(), "g", "name", start=0), "name")


def _lines(files: DataFrame) -> DataFrame:
    """``files`` with their lines and the counts of atoms and bonds from the fourth line."""
    lines = files.withColumn("lines", F.split(F.regexp_replace("text", "\r", ""), "\n"))
    head = F.element_at("lines", 4)
    return lines.withColumns({"n_atoms": fixed(head, 0, 3).cast("int"), "n_bonds": fixed(head, 3, 6).cast("int")})


def _atoms(lines: DataFrame) -> DataFrame:
    rows = lines.where("n_atoms > 0").select("g", F.posexplode(F.slice("lines", F.lit(5), F.col("n_atoms"))).alias("at", "line"))
    field = F.split(F.trim("line"), r"\s+")
    return rows.select("g", F.col("at").alias("id"), field[3].alias("sym"), field[0].cast("double").alias("x"), field[1].cast("double").alias("y"))


def _bonds(lines: DataFrame, reaction: bool) -> DataFrame:
    rows = lines.where("n_bonds > 0").select("g", F.posexplode(F.slice("lines", F.col("n_atoms") + 5, F.col("n_bonds"))).alias("at", "line"))
    part = lambda k: fixed(F.col("line"), 3 * k, 3 * k + 3).cast("int")
    ends = [F.col("g"), F.col("at").alias("edge"), (part(0) - 1).alias("src"), (part(1) - 1).alias("dst")]
    if reaction:
        return rows.select(*ends, part(2).alias("chg"), part(3).alias("old"), part(4).alias("new"))
    return rows.select(*ends, F.lit(0).alias("chg"), part(2).alias("type"))


def _without_hydrogen(atoms: DataFrame, bonds: DataFrame) -> tuple[DataFrame, DataFrame]:
    heavy = atoms.where(~F.col("sym").isin("H", "H+"))
    number = heavy.select("g", "id", (F.row_number().over(Window.partitionBy("g").orderBy("id")) - 1).alias("now"))
    nodes = heavy.join(number, ["g", "id"]).select("g", F.col("now").alias("id"), "sym", "x", "y")
    edges = bonds
    for end in ("src", "dst"):
        new = number.select(F.col("g").alias("ng"), F.col("id").alias("w"), F.col("now").alias(f"n_{end}"))
        edges = edges.join(new, (F.col("g") == F.col("ng")) & (F.col(end) == F.col("w"))).drop("ng", "w")
    edges = edges.withColumns({"src": F.col("n_src"), "dst": F.col("n_dst")}).drop("n_src", "n_dst")
    return nodes, edges


def read_molecules(spark: SparkSession, path: str, keep_hydrogen: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(graphs, nodes, edges) of molecule files; nodes (g, id, sym, x, y), edges (g, edge, src, dst, chg, type)."""
    files = number_graphs(read_files(spark, path))
    lines = _lines(files)
    atoms, bonds = _atoms(lines), _bonds(lines, reaction=False)
    graphs = files.select("g", F.regexp_replace("name", r"\.mol$", "").alias("name"))
    if keep_hydrogen:
        return graphs, atoms, bonds
    return (graphs, *_without_hydrogen(atoms, bonds))


def direction(name: Column) -> Column:
    """1 for names with ``_f``, -1 for names with ``_b``, else 0."""
    return F.when(name.rlike(r"_f(?:[_.]|$)"), 1).when(name.rlike(r"_b(?:[_.]|$)"), -1).otherwise(0)


def read_reaction_graphs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(graphs, nodes, edges, sides): graphs (g, name, ligand, direction, map_num, ec_codes), edges with chg, old and
    new types, sides (g, side, ord, ligand) from the second line ``A B => C``."""
    return parse_reaction_graphs(number_graphs(read_files(spark, path)))


def parse_reaction_graphs(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """As ``read_reaction_graphs``, from files (g, name, text)."""
    lines = _lines(files)
    head = F.split(F.trim(F.element_at("lines", 1)), r"\s+")
    parts = F.split("name", "_")
    number = F.when(F.size(parts) > 1, F.regexp_extract(F.element_at(parts, 2), r"^\d+", 0))
    graphs = lines.select("g", "name", head[0].alias("ligand"), direction(F.col("name")).alias("direction"), number.cast("int").alias("map_num"), F.slice(head, 2, F.greatest(F.size(head) - 1, F.lit(0))).alias("ec_codes"))
    halves = F.split(F.element_at("lines", 2), "=>")
    both = lines.select("g", halves.alias("h")).where("size(h) = 2").select("g", F.explode(F.array(F.struct(F.lit("s").alias("side"), F.element_at("h", 1).alias("t")), F.struct(F.lit("p").alias("side"), F.element_at("h", 2).alias("t")))).alias("x"))
    sides = both.select("g", "x.side", F.posexplode(F.regexp_extract_all("x.t", F.lit(r"(\S+)"), F.lit(1))).alias("ord", "ligand"))
    return graphs, _atoms(lines), _bonds(lines, reaction=True), sides


def read_mol2(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(graphs, nodes, edges) of files with ``@<TRIPOS>`` sections; a line belongs to the last section before it."""
    files = number_graphs(read_files(spark, path)).where(F.col("text").contains("TRIPOS"))
    rows = files.select("g", "name", F.posexplode(F.split(F.regexp_replace("text", "\r", ""), "\n")).alias("at", "line"))
    mark = F.when(F.col("line").startswith("@<TRIPOS>"), F.regexp_extract("line", r"^@<TRIPOS>(\w+)", 1))
    w = Window.partitionBy("g").orderBy("at")
    rows = rows.withColumn("section", F.last(mark, ignorenulls=True).over(w)).where(~F.col("line").startswith("@") & (F.trim("line") != ""))
    field = F.split(F.trim("line"), r"\s+")
    number = F.row_number().over(Window.partitionBy("g", "section").orderBy("at")) - 1
    atoms = rows.where("section = 'ATOM'").select("g", number.alias("id"), field[0].cast("int").alias("file_id"), F.split_part(field[5], F.lit("."), F.lit(1)).alias("sym"), field[2].cast("double").alias("x"), field[3].cast("double").alias("y"))
    bonds = rows.where("section = 'BOND'").select("g", number.alias("edge"), field[1].cast("int").alias("a"), field[2].cast("int").alias("b"), field[3].alias("type"))
    for end, was in (("src", "a"), ("dst", "b")):
        ids = atoms.select(F.col("g").alias("ag"), "file_id", F.col("id").alias(end))
        bonds = bonds.join(ids, (F.col("g") == F.col("ag")) & (F.col(was) == F.col("file_id"))).drop("ag", "file_id")
    return files.select("g", "name"), atoms.drop("file_id"), bonds.select("g", "edge", "src", "dst", F.lit(0).alias("chg"), "type")


def running_offsets(nodes: DataFrame, order: DataFrame) -> DataFrame:
    """(reaction, ord, g, offset): where the atoms of each molecule of a reaction begin in one numbering.

    ``order`` is (reaction, ord, g): the molecules of a reaction in their order.
    """
    sizes = nodes.groupBy("g").agg(F.count("*").alias("size"))
    w = Window.partitionBy("reaction").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return order.join(sizes, "g").withColumn("offset", F.coalesce(F.sum("size").over(w), F.lit(0))).select("reaction", "ord", "g", "offset")
