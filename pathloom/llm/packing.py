"""Packing documents into sequences of bounded length by vector best-fit.

A bin (sequence) has three capacities: tokens, documents, and attention cost
(the sum of squared piece lengths). Pieces come in decreasing length; each goes
to the open bin that fits under *every* constraint and scores best, by

* ``norm``: the least weighted norm of what would stay free, or
* ``dot``: the greatest weighted dot product of the piece with what is free,

and opens a bin where none fits. Documents over the token capacity are cut
losslessly into full pieces and a rest.

Scale: texts are read once and leave the map side as (id, piece, length,
checksum); only these few bytes per piece are dealt out. Pieces are dealt to
shards by the hash of a running number, so identical pieces spread like any
others, with as many shards as keep a shard at ``SHARD_BINS`` sequences' tokens and
at ``SHARD_ROWS`` pieces: a task is bounded at any size. A shard wastes part of its
last sequence, about 1 in 4000.

Defined results: null text packs as an empty document (its end id alone);
repeated rows and repeated or null ids are packed as documents of their own;
an empty table gives no rows. A piece that breaks the cost bound on its own is
an error, as it could not be placed anywhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pathloom.llm.common import batched, materialise, rows
from pathloom.llm.tokens import END_ID, encoder

SHARD_BINS = 2000
SHARD_ROWS = 200_000


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence. The defaults for documents and cost bind only where the tokens do."""

    tokens: int = 4096
    documents: int = 4096
    cost: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)
    rule: str = "norm"


def best_fit(lengths: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each piece. Ties go to the bin opened first."""
    caps = np.array([limits.tokens, limits.documents, limits.cost], float)
    weights = np.array(limits.weights)
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    need = np.stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2], 1) / caps
    if len(need) and need.max() > 1 + 1e-12:
        raise ValueError("a piece is over the limits of a sequence")
    free = np.empty((max(len(lengths), 1), 3))  # of open bins, in units of the capacity
    ids = np.empty(len(free), np.int64)
    used: list[int] = []
    n_open = 0
    smallest = need[order[-1]] if len(need) else None
    for at in order:
        item = need[at]
        view = free[:n_open]
        best = -1
        if n_open:
            fits = np.flatnonzero((view >= item - 1e-12).all(axis=1))
            if len(fits):
                rest = view[fits]
                score = ((rest - item) ** 2) @ weights if limits.rule == "norm" else -(rest @ (weights * item))
                best = int(fits[np.argmin(score)])
        if best < 0:
            best, n_open = n_open, n_open + 1
            free[best], ids[best] = 1.0, len(used)
            used.append(0)
        b = int(ids[best])
        bins[at], offsets[at] = b, used[b]
        used[b] += int(lengths[at])
        free[best] -= item
        if (free[best] < smallest - 1e-12).any():  # full: no later piece fits
            n_open -= 1
            free[best : n_open], ids[best : n_open] = free[best + 1 : n_open + 1], ids[best + 1 : n_open + 1]
    return bins, offsets


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids and end id, cut at ``capacity``."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                    data = memoryview(ids + end)
                    for piece, start in enumerate(range(0, len(data), capacity * 4)):
                        own = data[start : start + capacity * 4]
                        yield doc_id, piece, start // 4, len(own) // 4, zlib.crc32(own)

    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(lambda it: batched(cut(it), schema), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``pieces`` (with a ``length`` column) with sequence_id and offset. Read twice: give it materialised."""
    total, n = pieces.agg(F.sum("length"), F.count("*")).first()
    shards = max(1, int((total or 0) // (limits.tokens * SHARD_BINS)), -(-n // SHARD_ROWS))
    kept = [f for f in pieces.schema.fields if f.name not in ("sequence_id", "offset", "__shard", "__number")]
    names = [f.name for f in kept]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long"

    def place(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("__number", kind="stable")
        bins, offsets = best_fit(shard["length"].to_numpy(), limits)
        return shard[names].assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    # The number is of a row's partition and place in it: a task that runs again gives its rows the same ones.
    numbered = pieces.select(*names, F.monotonically_increasing_id().alias("__number"))
    dealt = numbered.withColumn("__shard", F.pmod(F.xxhash64("__number"), F.lit(shards)))
    return dealt.groupBy("__shard").applyInPandas(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(materialise(token_pieces(docs, tokenizer, limits.tokens, id_column, text), "pieces"), limits)
