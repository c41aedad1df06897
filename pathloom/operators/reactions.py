"""Reactions over molecule kernels, balance, equations and label extraction from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _sides(sides: DataFrame, kernel: DataFrame) -> DataFrame:
    """(r1, r2, s1, s2, k): molecule similarities summed over the sides of two reactions r2 <= r1.

    ``kernel`` (a, b, k) is symmetric and full. Ligands meet through the kernel's rows, so sides never meet directly.
    """
    one = sides.select(F.col("reaction").alias("r1"), F.col("side").alias("s1"), F.col("ligand").alias("a"))
    two = sides.select(F.col("reaction").alias("r2"), F.col("side").alias("s2"), F.col("ligand").alias("b"))
    return one.join(kernel, "a").join(two, "b").where("r2 <= r1").groupBy("r1", "r2", "s1", "s2").agg(F.sum("k").alias("k"))


def _cell(s1: str, s2: str) -> Column:
    return F.sum(F.when((F.col("s1") == s1) & (F.col("s2") == s2), F.col("k")).otherwise(0.0))


def sum_of_reactants(sides: DataFrame, kernel: DataFrame) -> DataFrame:
    """(i, j, k): similarities summed over all pairs of ligands of either side."""
    return _sides(sides, kernel).groupBy(F.col("r1").alias("i"), F.col("r2").alias("j")).agg(F.sum("k").alias("k"))


def difference_of_reactants(sides: DataFrame, kernel: DataFrame) -> DataFrame:
    """(i, j, k): K(SS) + K(PP) - K(SP) - K(PS)."""
    value = _cell("s", "s") + _cell("p", "p") - _cell("s", "p") - _cell("p", "s")
    return _sides(sides, kernel).groupBy(F.col("r1").alias("i"), F.col("r2").alias("j")).agg(value.alias("k"))


def reactant_matching(sides: DataFrame, kernel: DataFrame) -> DataFrame:
    """(i, j, k): K(SS) * K(PP)."""
    return _sides(sides, kernel).groupBy(F.col("r1").alias("i"), F.col("r2").alias("j")).agg((_cell("s", "s") * _cell("p", "p")).alias("k"))


def balanced(sides: DataFrame) -> DataFrame:
    """(reaction, balanced): whether both sides hold every ligand equally often."""
    signed = F.sum(F.when(F.col("side") == "s", F.col("n")).otherwise(-F.col("n")))
    apart = sides.groupBy("reaction", "ligand").agg(signed.alias("d"))
    return apart.groupBy("reaction").agg((F.max(F.abs("d")) == 0).alias("balanced"))


def expand_equation(equation: Column) -> Column:
    """Ligands of an equation in order, with ``p`` between the sides: ``2 A + n B <=> C`` is [A, A, B, B, p, C].

    A coefficient is a number, ``n`` or ``m`` (2), a number before one of them (times), or a sum or difference of these
    in brackets; ``n`` and ``m`` are 3 if the equation holds ``(n-1)`` or ``(m-1)``, so that no ligand vanishes.
    """
    n = F.when(equation.contains("(n-1)"), 3).otherwise(2)
    m = F.when(equation.contains("(m-1)"), 3).otherwise(2)

    def amount(c: Column) -> Column:
        plain = F.regexp_replace(c, r"[()\s]", "")
        terms = F.split(F.regexp_replace(plain, "-", "+-"), r"\+")
        value = lambda t: F.when(F.length(t) == 0, 0).otherwise(
            F.when(t.startswith("-"), -1).otherwise(1)
            * F.coalesce(F.nullif(F.regexp_extract(t, r"(\d+)", 1), F.lit("")).cast("int"), F.lit(1))
            * F.when(t.endswith("n"), n).when(t.endswith("m"), m).otherwise(1)
        )
        return F.aggregate(F.transform(terms, value), F.lit(0), lambda a, b: a + b)

    def ligands(side: Column) -> Column:
        parts = F.split(F.trim(side), r"\s+\+\s+")

        def one(part: Column) -> Column:
            part = F.trim(part)
            tail = F.regexp_extract(part, r"\(([^()]*)\)$", 1)  # C00001(n+1)
            bare = F.when(F.length(tail) > 0, F.regexp_replace(part, r"\([^()]*\)$", "")).otherwise(part)
            words = F.split(bare, r"\s+")
            lead = F.when(F.size(words) > 1, F.element_at(words, 1)).otherwise(F.lit("1"))
            return F.array_repeat(F.element_at(words, -1), F.greatest(amount(lead), F.lit(0)))

        return F.flatten(F.transform(parts, one))

    sides = F.split(equation, "<=>")
    return F.concat(ligands(F.element_at(sides, 1)), F.array(F.lit("p")), ligands(F.element_at(sides, 2)))


def valid(equation: Column) -> Column:
    """An equation of compounds only: glycans (``G`` and digits) are left out."""
    return equation.isNotNull() & ~equation.rlike(r"\bG\d+")


def has_hydrogens(nodes: DataFrame) -> DataFrame:
    """(g, has_h): whether a graph has a node H or H+."""
    return nodes.groupBy("g").agg(F.bool_or(F.col("sym").isin("H", "H+")).alias("has_h"))


def balanced_atoms(atoms: DataFrame) -> DataFrame:
    """(reaction, balanced) from (reaction, side, sym): the sorted symbols of both sides are equal."""
    return balanced(atoms.groupBy("reaction", "side", F.col("sym").alias("ligand")).agg(F.count("*").alias("n")))


# Edge types of ligand graphs; any other name is 0.
EDGE_TYPES = {"main": 1, "leave": 2, "cofac": 3, "trans": 4, "ligase": 5}


def _edge_type() -> Column:
    code = F.lit(0)
    for name, n in EDGE_TYPES.items():
        code = F.when(F.col("type") == name, n).otherwise(code)
    return code


def ligand_graph(sides: DataFrame, rpairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (g, id, sym) and edges (g, src, dst, chg) of reactions as graphs of ligands.

    ``rpairs`` (reaction, sub, prod, type) joins a substrate and a product in either order; ligands of one side that
    no pair joins are joined among themselves by an edge of type 0. ``chg`` holds the edge type.
    """
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("reaction").orderBy("side", "ligand")) - 1
    own = sides.select("reaction", "side", "ligand").distinct().withColumn("id", number)
    nodes = own.select(F.col("reaction").alias("g"), "id", F.col("ligand").alias("sym"))
    a = own.where("side = 's'").select("reaction", F.col("ligand").alias("x"), F.col("id").alias("src"))
    b = own.where("side = 'p'").select("reaction", F.col("ligand").alias("y"), F.col("id").alias("dst"))
    pairs = rpairs.select("reaction", F.col("sub").alias("x"), F.col("prod").alias("y"), _edge_type().alias("chg"))
    turned = pairs.select("reaction", F.col("y").alias("x"), F.col("x").alias("y"), "chg")
    joined = pairs.union(turned).join(a, ["reaction", "x"]).join(b, ["reaction", "y"]).groupBy("reaction", "src", "dst").agg(F.max("chg").alias("chg"))
    left = own.select("reaction", "side", F.col("id").alias("src"))
    right = own.select(F.col("reaction").alias("r"), F.col("side").alias("t"), F.col("id").alias("dst"))
    group = left.join(right, (F.col("reaction") == F.col("r")) & (F.col("side") == F.col("t")) & (F.col("src") < F.col("dst"))).select("reaction", "src", "dst")
    group = group.join(joined, ["reaction", "src", "dst"], "left_anti").withColumn("chg", F.lit(0))
    return nodes, joined.unionByName(group).select(F.col("reaction").alias("g"), "src", "dst", "chg")


def molecule_graph(sides: DataFrame, rpairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (g, id, sym) and edges (g, src, dst, chg) of reactions as graphs of molecules, one for each time it is named.

    ``sides`` (reaction, side, at, ligand) numbers the substrates, then the products. A pair of ``rpairs`` (reaction, sub,
    prod, type, place) joins all its molecules in either order, of whatever sides; the pair of the least ``place`` gives
    the type. Molecules of one side that no pair joins are joined among themselves by an edge of type 0. No molecule
    is joined with itself, though it may be with another of its name; a null name is joined by no pair.
    """
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("reaction").orderBy(F.desc("side"), "at")) - 1
    own = sides.select("reaction", "side", "ligand", number.alias("id"))
    both = F.explode(F.array(F.struct(F.col("sub").alias("x"), F.col("prod").alias("y")), F.struct(F.col("prod").alias("x"), F.col("sub").alias("y")))).alias("p")
    pairs = rpairs.select("reaction", both, "place", _edge_type().alias("chg")).groupBy("reaction", "p.x", "p.y").agg(F.min_by("chg", "place").alias("chg"))
    a = own.select("reaction", F.col("ligand").alias("x"), F.col("id").alias("src"))
    b = own.select("reaction", F.col("ligand").alias("y"), F.col("id").alias("dst"))
    joined = pairs.join(a, ["reaction", "x"]).join(b, ["reaction", "y"]).where("src < dst").select("reaction", "src", "dst", "chg")
    left, right = (own.select("reaction", "side", F.col("id").alias(end)) for end in ("src", "dst"))
    group = left.join(right, ["reaction", "side"]).where("src < dst").join(joined, ["reaction", "src", "dst"], "left_anti")
    every = joined.unionByName(group.select("reaction", "src", "dst", F.lit(0).alias("chg")))
    return own.select(F.col("reaction").alias("g"), "id", F.col("ligand").alias("sym")), every.select(F.col("reaction").alias("g"), "src", "dst", "chg")
