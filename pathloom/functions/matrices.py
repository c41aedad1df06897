"""Matrix functions of single graphs: the diffusion kernel and node weights from it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pathloom.operators.paths import as_graphs


def exponential(matrix: np.ndarray) -> np.ndarray:
    """The exponential of a symmetric matrix, by its eigenvectors."""
    values, vectors = np.linalg.eigh(matrix)
    return (vectors * np.exp(values)) @ vectors.T


def diffusion_matrix(n: int, edges: list[tuple[int, int]], beta: float) -> np.ndarray:
    """exp(beta (A - D)) of a graph on 0..n-1."""
    h = np.zeros((n, n))
    for a, b in edges:
        h[a, b] = h[b, a] = 1.0
    h -= np.diag(h.sum(axis=0))
    return exponential(beta * h)


def is_kernel(matrix: np.ndarray) -> bool:
    """Bounded by one and positive semidefinite, within tolerances."""
    return bool(matrix.max() < 1.001 and np.linalg.eigvalsh(matrix).min() > -1e-4)


def diffusion_weights(nodes: DataFrame, edges: DataFrame, beta: float) -> DataFrame:
    """(g, id, w): the greatest diffusion value between a node and an end of a changed edge, for a negative ``beta``
    one less that; 0 (or 1) where nothing changes. One dense matrix per graph."""
    schema = pa.schema([("g", pa.int64()), ("id", pa.int32()), ("w", pa.float64())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for g, ids, _, src, dst, chg in zip(*(c.to_pylist() for c in batch.columns)):
                place = {i: k for k, i in enumerate(ids)}
                links = [(place[a], place[b]) for a, b in zip(src or (), dst or ())]
                core = sorted({k for (a, b), c in zip(links, chg or ()) if c for k in (a, b)})
                spread = diffusion_matrix(len(ids), links, abs(beta))
                for i in ids:
                    top = max((float(spread[k, place[i]]) for k in core), default=0.0)
                    for values, v in zip(out, (g, i, top if beta >= 0 else 1.0 - top)):
                        values.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema)], schema=schema)

    return as_graphs(nodes, edges).mapInArrow(walk, "g long, id int, w double")
