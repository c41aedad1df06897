"""What the corpus operators share: scratch tables, column names, words and word hashes.

Words are maximal runs of characters other than U+0020 and U+0009..U+000D.
``bytes.split()`` without arguments separates at exactly these characters, and
``bytes.lower()`` changes A-Z only, so both run in C over the UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh3_64_intdigest

from pathloom.scratch import discard, materialise, scratch_made, scratch_path, sent  # noqa: F401  the operators' own

def spread(df: DataFrame, rows_: int, size: int, task: int = 128_000_000) -> DataFrame:
    """``df``, of ``rows_`` rows that each stand for a file, dealt one by one: to a task for each ``task`` of all
    ``size`` bytes, and to no fewer than keep the cores busy."""
    tasks = max(-(-size // task), 2 * df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(max(1, min(rows_, tasks)))


def row_key(*columns: str) -> Column:
    """128 bits that tell rows apart by numbers and, last, a text."""
    told = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns[:-1]]
    return F.unhex(F.md5(F.concat_ws(":", *told, F.coalesce(F.concat(F.lit("="), F.col(columns[-1])), F.lit("-")))))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that is no column of ``df`` and begins none."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name += "_"
    return name


def words(text: str | None) -> list[bytes]:
    """The words of ``text`` with A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, tokens), np.uint64, len(tokens))


_MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64
)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = values ^ (values >> np.uint64(32))
    x = x * _MULTIPLIERS[3]
    x ^= x >> np.uint64(29)
    x = x * _MULTIPLIERS[4]
    return x ^ (x >> np.uint64(32))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for each window of ``width`` words; order matters. Fewer words
    make one hash of the whole sequence, no words make none."""
    n = len(hashes)
    if not n:
        return hashes
    width, whole = min(width, n), n < width
    out = hashes[: n - width + 1].copy()
    for k in range(1, width):
        out *= _MULTIPLIERS[0]
        out ^= out >> np.uint64(29)
        out += hashes[k : n - width + 1 + k]
    return mix(out + np.uint64(n if whole else 0))


def rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The named columns of Arrow batches, row by row; a few rows at a time become Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            yield from zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names))


def batched(records: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Tuples gathered into record batches of at most ``size`` rows."""
    held: list[tuple] = []
    for record in records:
        held.append(record)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
