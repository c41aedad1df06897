"""The tables of the engine. A graph is rows of ``nodes`` and ``edges`` that share ``g``."""

from __future__ import annotations

from pyspark.sql import types as T

NODES = T.StructType([T.StructField("g", T.LongType()), T.StructField("id", T.IntegerType()), T.StructField("sym", T.StringType())])
#: ``chg`` is 0 for an edge that stays, -1 for one that is cleaved and +1 for one that is formed.
EDGES = T.StructType([T.StructField("g", T.LongType()), T.StructField("src", T.IntegerType()), T.StructField("dst", T.IntegerType()), T.StructField("chg", T.IntegerType())])
PATHS = T.StructType([T.StructField("g", T.LongType()), T.StructField("path", T.StringType()), T.StructField("len", T.IntegerType()), T.StructField("freq", T.LongType())])
KERNEL = T.StructType([T.StructField("i", T.LongType()), T.StructField("j", T.LongType()), T.StructField("k", T.DoubleType())])
TREE_NODES = T.StructType([T.StructField("entry", T.LongType()), T.StructField("tree", T.LongType()), T.StructField("node", T.LongType()), T.StructField("parent", T.LongType()), T.StructField("sym", T.StringType()), T.StructField("depth", T.IntegerType())])

#: Brackets before a label: the edge that leads to it stays, is cleaved, or is formed.
BRACKETS = {0: "(", -1: "{", 1: "["}
