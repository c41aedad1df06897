"""Incremental path counts.

The engine's sources are batch files; this is its one streaming form, for graphs
that arrive whole. A graph's paths depend on itself alone, so each micro-batch
adds its own rows and nothing that came before is read again. Batches are
written under their number, so a batch that runs twice after a failure replaces
itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pathloom.operators.paths import path_table


def append_paths(graphs: DataFrame, folder: str, checkpoint: str, max_depth: int = 50):
    """A streaming writer of path rows from a stream of (g, n, e), n and e being the arrays of node and edge structs."""

    def add(batch: DataFrame, number: int) -> None:
        nodes = batch.select("g", F.explode("n").alias("x")).select("g", "x.id", "x.sym")
        edges = batch.select("g", F.explode("e").alias("x")).select("g", "x.src", "x.dst", "x.chg")
        path_table(nodes, edges, max_depth).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return graphs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True)
