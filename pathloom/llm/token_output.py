"""Token ids as binary training files: packed matrices, cumulative segment lengths, position resets.

Every map task gathers documents until ``CHUNK_TOKENS`` ids are at hand, packs
them by best-fit-decreasing (the fullest row that still fits, found by a search
over a segment tree of free capacities) and writes four files to the shared
folder:

* ``.ids``     the matrix, rows x capacity unsigned 16- or 32-bit ids, padded with ``pad``;
* ``.cu``      cumulative segment lengths, int64, from 0, over all segments in row order;
* ``.resets``  for each segment, row and column where positions start again at 0, int32 pairs;
* ``.segs``    for each segment, document id (null: the least int64), piece and start, int64 triples.

No shuffle is needed, memory is bounded by the chunk, and a lost executor only
repeats its own chunks: files have names of their own and only those that the
committed manifest names are ever read. Files are dealt to readers one by one.

Defined results: null and empty texts are one end id; documents over the
capacity are cut losslessly; repeated rows are written as often as they occur;
an empty table gives an empty manifest.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from pathloom.llm.common import batched, materialise, rows, scratch_path, spread
from pathloom.llm.tokens import END_ID, encoder

CHUNK_TOKENS = 6_000_000
NULL_ID = np.iinfo(np.int64).min


class CapacityTree:
    """A segment tree over free capacities 0..n: for each, whether a row has it."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        at = free + self.leaves
        while at:
            self.counts[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The (free, row) with the least free capacity of at least ``need``, removed."""
        at = need + self.leaves
        if not self.counts[at]:
            while at > 1 and (at & 1 or not self.counts[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.counts[2 * at] else 2 * at + 1
        free = at - self.leaves
        row = self.rows[free].pop()
        while at:
            self.counts[at] -= 1
            at >>= 1
        return free, row


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int], int]:
    """Row and column of each piece, and the number of rows."""
    tree, n = CapacityTree(capacity), 0
    row_of, column_of = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        found = tree.take(lengths[i])
        free, row = found if found else (capacity, n)
        n += found is None
        row_of[i], column_of[i] = row, capacity - free
        if free > lengths[i]:
            tree.add(free - lengths[i], row)
    return row_of, column_of, n


def _write_chunk(folder: str, pieces: list[tuple[int, int, int, bytes]], capacity: int, wide: bool, pad: int) -> tuple:
    lengths = [len(p[3]) // 4 for p in pieces]
    row_of, column_of, n = best_fit_decreasing(lengths, capacity)
    matrix = np.full((n, capacity), pad, "<u4" if wide else "<u2")
    order = sorted(range(len(pieces)), key=lambda i: (row_of[i], column_of[i]))
    for i in order:
        matrix[row_of[i], column_of[i] : column_of[i] + lengths[i]] = np.frombuffer(pieces[i][3], "<u4")
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    name = uuid.uuid4().hex
    parts = {
        "ids": matrix,
        "cu": np.cumsum([0] + [lengths[i] for i in order], dtype="<i8"),
        "resets": np.array([(row_of[i], column_of[i]) for i in order], "<i4"),
        "segs": np.array([pieces[i][:3] for i in order], "<i8"),
    }
    for kind, data in parts.items():
        with store.open_output_stream(f"{root}/{name}.{kind}") as out:
            out.write(memoryview(np.ascontiguousarray(data)).cast("B"))
    return f"{folder}/{name}", n, len(pieces), int(sum(lengths)), matrix.dtype.itemsize


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, capacity: int = 4096, pad: int = 0, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files under ``folder`` and return their manifest: file, n_rows, n_segments, n_tokens, width."""
    schema = pa.schema([("file", pa.string()), ("n_rows", pa.int64()), ("n_segments", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32())])
    end = np.array([END_ID], "<u4").tobytes()

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        own = encoder(tokenizer)
        wide, held, size = own.size > 65536, [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for doc_id, ids in zip(part.column(0).to_pylist(), own.encode(part.column(1).to_pylist())):
                    data = ids + end
                    for piece, start in enumerate(range(0, len(data), capacity * 4)):
                        held.append((NULL_ID if doc_id is None else doc_id, piece, start // 4, data[start : start + capacity * 4]))
                    size += len(data) // 4
                if size >= CHUNK_TOKENS:
                    yield _write_chunk(folder, held, capacity, wide, pad)
                    held, size = [], 0
        if held:
            yield _write_chunk(folder, held, capacity, wide, pad)

    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    written = chosen.mapInArrow(lambda it: batched(chunks(it), schema, 64), "file string, n_rows long, n_segments long, n_tokens long, width int")
    return materialise(written, "token-manifest")


def read_token_files(manifest: DataFrame, capacity: int = 4096) -> DataFrame:
    """One row per segment, read back from the files: doc_id, piece, start, length, file, row, offset, ids_crc32."""
    names = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("file", pa.string()), ("row", pa.int32()), ("offset", pa.int32()), ("ids_crc32", pa.int64())]
    schema = pa.schema(names)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for file, n, width in rows(batches, "file", "n_rows", "width"):
            store, path = fs.FileSystem.from_uri(file)

            def load(kind: str, dtype: str) -> np.ndarray:
                with store.open_input_stream(f"{path}.{kind}") as source:
                    return np.frombuffer(source.read(), dtype)

            matrix = load("ids", f"<u{width}").reshape(n, capacity)
            cumulative, resets = load("cu", "<i8"), load("resets", "<i4").reshape(-1, 2)
            lengths = np.diff(cumulative).tolist()
            for (doc_id, piece, start), length, (row, column) in zip(load("segs", "<i8").reshape(-1, 3).tolist(), lengths, resets.tolist()):
                ids = matrix[row, column : column + length].astype("<u4")
                yield (None if doc_id == NULL_ID else doc_id), piece, start, length, file.rpartition("/")[2], row, column, zlib.crc32(ids.tobytes())

    ddl = "doc_id long, piece int, start long, length long, file string, row int, offset int, ids_crc32 long"
    n, size = manifest.agg(F.count("*"), F.sum(F.col("n_rows") * F.col("width")) * capacity).first()
    return spread(manifest, n, size or 0).mapInArrow(lambda it: batched(segments(it), schema), ddl)


def scratch_folder(docs: DataFrame) -> str:
    return scratch_path(docs.sparkSession, "token-files")
