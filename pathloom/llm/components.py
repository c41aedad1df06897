"""Connected components of a graph given as a table of links, by alternating star steps.

The large-star step hangs every larger neighbour of a node on the least node of
its neighbourhood, the small-star step does so with the smaller ones; repeated,
every component becomes a star around its least node. A step sends each link to
a constant number of places, so a node with very many links makes no more rows
than it has links; its least neighbour is found by a pre-aggregated minimum and
joined back, where adaptive execution splits the hot side. Links are written to
the shared scratch folder between rounds, never collected.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from pathloom.llm.common import discard, materialise

#: Links per task of a round: rounds over few links don't pay for many tasks.
LINKS_A_TASK = 100_000


def _star(links: DataFrame, tasks: int) -> DataFrame:
    """Large-star, then small-star, of links (a, b) with a > b."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.where("a <> b").coalesce(tasks).distinct().coalesce(tasks)
    low = large.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks).select(F.col("a").alias("u"), "m")
    small = large.join(low, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("l"))
    return small.select("l.a", "l.b").where("a <> b").coalesce(tasks).distinct().coalesce(tasks)


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(links: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """(node, component): the least node reachable, for every node of ``links`` (a, b). Loops and nulls are ignored."""
    spark, held = links.sparkSession, []
    now = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialise(now, "links", held)
    mark = _mark(now)
    while mark[0]:
        after = materialise(_star(now, math.ceil(mark[0] / LINKS_A_TASK) + 3), "links", held)
        seen = _mark(after)
        discard(spark, held[:-1])
        del held[:-1]
        now, same, mark = after, seen == mark, seen
        if same:
            break
    if scratch is not None:
        scratch += held
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.union(leaves.select(F.col("component").alias("node"), "component").distinct())
