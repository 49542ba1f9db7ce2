"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocabshift.session import checkpoint_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by Spark's reader (any file system that Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet under the shared checkpoint folder and read back.

    Cuts the lineage with files that every executor sees, so a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if heap_filled(spark):
        release(spark)
    if not _stored_at:
        atexit.register(_discard_all, spark)
    _stored_at.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


_stored_at: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*tables: DataFrame) -> None:
    """Remove the files of ``stored`` tables that nothing will read again."""
    for table in tables:
        _remove(table.sparkSession, table.stored_at)
        _stored_at.discard(table.stored_at)


def release(spark: SparkSession) -> None:
    """Free what finished jobs left: shuffle files, broadcasts and plans that nothing refers to any more.

    Spark removes them only when the driver's garbage is collected, which in a chain of many short jobs may be long after.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def heap_filled(spark: SparkSession) -> bool:
    """Whether more than half of the driver's heap is in use, mostly by what finished jobs left."""
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    return 2 * (runtime.totalMemory() - runtime.freeMemory()) > runtime.maxMemory()


def _discard_all(spark: SparkSession) -> None:
    """At the end of the driver: remove what is left of the ``stored`` tables, if the session still runs."""
    with contextlib.suppress(Exception):
        for path in _stored_at:
            _remove(spark, path)


def many_to_one(rows: DataFrame, table: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Inner join of ``rows`` with a table of distinct ``keys`` that says by ``weight`` how many rows have a key.

    Keys with at least one in ``HEAVY`` of all rows are at most ``HEAVY`` and are broadcast, so their rows are not shuffled;
    the others are joined by a shuffle in which no key weighs much.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    heavy = F.col(weight) * HEAVY >= total
    some = table.where(heavy).limit(1).count() if total else 0
    if not some:
        return rows.join(table, keys)
    few = F.broadcast(table.where(heavy))
    rest = rows.join(F.broadcast(table.where(heavy).select(*keys)), keys, "left_anti").join(table.where(~heavy), keys)
    return rows.join(few, keys).unionByName(rest)


HEAVY = 2_000


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null ids: -1, a remainder that no fold uses)."""
    crc = F.crc32(F.col(column).cast("string").cast("binary"))
    return F.coalesce(crc % F.lit(modulus), F.lit(-1).cast("long"))


def map_rows(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow``: batches are bounded in bytes by Spark, so long texts do not pile up in a worker.

    A worker outlives its task, so what its allocators hold in reserve goes back at the end of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return unused memory of Arrow's pool and (where the C library can) of the heap to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_slices(batch: pa.RecordBatch, at: int, most_bytes: int, most_rows: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """A batch in slices of at most ``most_rows`` rows and (single long texts aside) ``most_bytes``, with their texts.

    Only a slice's texts are Python objects at a time.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        upto = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most_bytes, side="right"))
        end = min(max(upto, start + 1), start + most_rows, batch.num_rows)
        part = batch.slice(start, end - start)
        yield part, part.column(at).to_pylist()
        start = end
