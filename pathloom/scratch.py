"""Scratch tables in the folder that driver and executors share, and what may be sent to all tasks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

_LOCAL_SCRATCH: list[str] = []
#: Scratch tables of this process lie in folders of this name, which are deleted when it ends.
_RUN = f"pathloom-{uuid.uuid4().hex}"
_FOLDERS: set[str] = set()
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the setting is absent, a temporary folder serves, but only if driver
    and executors are one process; on a cluster its absence is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL_SCRATCH:
        _LOCAL_SCRATCH.append(tempfile.mkdtemp(prefix="pathloom-"))
        atexit.register(shutil.rmtree, _LOCAL_SCRATCH[0], ignore_errors=True)
    return f"file://{_LOCAL_SCRATCH[0]}"


def _delete(folder: str) -> None:
    with suppress(Exception):  # nothing to delete, or the store is gone
        store, path = fs.FileSystem.from_uri(folder)
        store.delete_dir(path)


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared scratch folder. What is there lives until it is discarded or the process ends."""
    folder = f"{scratch_root(spark)}/{_RUN}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_delete, folder)
    path = f"{folder}/{tag}-{uuid.uuid4().hex}"
    if (made := _MADE.get()) is not None:
        made.append(path)
    return path


@contextmanager
def scratch_made() -> Iterator[list[str]]:
    """The scratch paths that are made inside, for the caller to discard when no result needs them."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield made
    finally:
        _MADE.reset(token)


def materialise(df: DataFrame, tag: str, keep: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: a cut of the
    lineage that survives lost executors. The path is added to ``keep``."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    if keep is not None:
        keep.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_BUILT: dict[tuple, str] = {}


def fingerprint(spark: SparkSession, paths: Iterable[str]) -> tuple:
    """What tells whether files have been written anew: each file's path, length and time of change."""
    found = []
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files = store.listFiles(where, True)
        while files.hasNext():
            one = files.next()
            found.append((one.getPath().toString(), one.getLen(), one.getModificationTime()))
    return tuple(sorted(found))


def built_once(spark: SparkSession, tag: str, sources: list[str], build: Callable[[str], None]) -> str:
    """The scratch folder that ``build(folder)`` has filled from the files of ``sources``; built again when they change."""
    key = spark.sparkContext.applicationId, tag, fingerprint(spark, sources)
    if key not in _BUILT:
        folder = scratch_path(spark, tag)
        build(folder)
        _BUILT[key] = folder
    return _BUILT[key]


def discard(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete scratch tables that no later step reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: What may be sent to all tasks: so many rows, and so many bytes in them; more is joined by a shuffle.
SENT_ROWS = 500_000
SENT_BYTES = 64_000_000


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: lengths of texts, binaries, arrays and maps, and 8 for what has a fixed size."""

    def size(value: Column, kind: DataType) -> Column:
        if isinstance(kind, (StringType, BinaryType)):
            return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 8
        if isinstance(kind, ArrayType):
            total = F.aggregate(value, F.lit(8).cast("long"), lambda n, x: n + size(x, kind.elementType))
            return F.coalesce(total, F.lit(8).cast("long"))
        if isinstance(kind, MapType):
            return size(F.map_keys(value), ArrayType(kind.keyType)) + size(F.map_values(value), ArrayType(kind.valueType))
        if isinstance(kind, StructType):
            return sum((size(value[f.name], f.dataType) for f in kind.fields), F.lit(8).cast("long"))
        return F.lit(8).cast("long")

    return sum((size(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(8).cast("long"))


def sent(small: DataFrame) -> DataFrame:
    """A side of a join that is sent to all tasks if it has few rows and few bytes, and left to a shuffle if not."""
    rows, size = small.limit(SENT_ROWS + 1).agg(F.count("*"), F.sum(row_bytes(small))).first()
    return F.broadcast(small) if rows <= SENT_ROWS and (size or 0) <= SENT_BYTES else small


def _ranged(df: DataFrame, prefix: str, *order: str) -> tuple[DataFrame, str, str]:
    """``df`` written in sorted ranges, with the names of the columns for the range and the place in it."""
    part, own = (f"__{prefix}_{k}" for k in ("part", "own"))
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    return materialise(ranged.withColumns({part: F.shiftright(place, 33), own: place.bitwiseAND((1 << 33) - 1)}), "ranged"), part, own


def numbered(df: DataFrame, name: str, *order: str, start: int = 1) -> DataFrame:
    """``df`` with ``name``, the place of each row in the order of ``order``, which tells rows apart.

    Rows are sorted in ranges, written once, and numbered within their range after the rows of the ranges before it:
    the only sort that one task does is of one row for each range.
    """
    written, part, own = _ranged(df, name, *order)
    before = f"__{name}_before"
    sizes = written.groupBy(F.col(part).alias("p")).count()
    offsets = sizes.select("p", (F.sum("count").over(Window.orderBy("p")) - F.col("count")).alias(before))
    return written.join(F.broadcast(offsets), F.col(part) == F.col("p")).withColumn(name, F.col(own) + F.col(before) + start).drop("p", part, own, before)


def running(df: DataFrame, name: str, value: str, *order: str) -> DataFrame:
    """``df`` with ``name``, the sum of ``value`` over the rows before each in the order of ``order``, by ranges as ``numbered``."""
    written, part, own = _ranged(df, name, *order)
    before = f"__{name}_before"
    sums = written.groupBy(F.col(part).alias("p")).agg(F.sum(value).alias("sum"))
    offsets = sums.select("p", (F.sum("sum").over(Window.orderBy("p")) - F.col("sum")).alias(before))
    within = F.sum(value).over(Window.partitionBy(part).orderBy(own)) - F.col(value)
    return written.withColumn(name, within).join(F.broadcast(offsets), F.col(part) == F.col("p")).withColumn(name, F.col(name) + F.col(before)).drop("p", part, own, before)
