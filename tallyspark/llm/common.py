"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, StructField, StructType

from ..functions.held import held as cut
from ..functions.held import scratch, shared_folder  # noqa: F401

#: ASCII white space that separates words: \x20 and \x09 to \x0D.
ASCII_WS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once into a table in the shared folder, so that each reader reads its columns only."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_columns(named: dict[str, DataType], rest: str) -> StructType:
    """A schema of columns of any name and type, followed by those of a DDL string."""
    return StructType([StructField(n, t) for n, t in named.items()] + (StructType.fromDDL(rest).fields if rest else []))


#: Most bytes of an Arrow batch on its way to Python: texts may be long.
BATCH_BYTES = 4 << 20


#: What a Python worker keeps between tasks, by the operator that uses it: how to let go of what is soon made again, or (True) of all.
KEPT: dict[str, Callable[[bool], object]] = {}


def lean(run: Callable, uses: str = "") -> Callable:
    """run for mapInArrow, with small batches coming in and its memory given back to the system at the end.

    Python workers serve one task after another, each with what the last one left:
    a task first lets go of what other operators keep. The batch limit of the
    session is only ever lowered.
    """
    spark, key = SparkSession.getActiveSession(), "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark and spark.conf.get(key, None)
    if now and (not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BATCH_BYTES):
        spark.conf.set(key, f"{BATCH_BYTES}b")

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others = [forget for name, forget in KEPT.items() if name != uses]
        for forget in others:
            forget(True)
        if others:
            release()
        try:
            yield from run(batches)
        finally:
            if uses:
                KEPT[uses](False)
            release()

    return freed


def release() -> None:
    """Free memory of this process goes back to the system."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def let_go(spark: SparkSession) -> None:
    """Shuffle files and checkpoints that nothing refers to any more leave the disk now, not when the driver happens to collect its garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Each batch, cut into runs of rows whose `text` has about `limit` bytes (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = [x or 0 for x in pa.compute.binary_length(batch.column(text)).to_pylist()]
        start = held = 0
        for i, x in enumerate(sizes):
            if i > start and held + x > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += x
        yield batch.slice(start, n - start)


class HashTable:
    """An open-addressing hash table from whole numbers of 0 and up; lookups take whole arrays. Other keys give `missing`."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.mask, self.shift, self.missing = (1 << bits) - 1, np.uint64(64 - bits), values.dtype.type(missing)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, missing, values.dtype)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[free]]  # of several keys for a slot, one stays
            won = self.keys[at] == keys[left]
            self.values[at[won]] = values[left[won]]
            left, at = left[~won], (at[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        got, out = self.keys[at], self.values[at]
        other = np.flatnonzero(got != keys)
        out[other] = self.missing
        left = other[got[other] != -1]
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            got, wanted = self.keys[at], keys[left]
            out[left] = np.where(got == wanted, self.values[at], self.missing)
            on = (got != wanted) & (got != -1)
            left, at = left[on], at[on]
        return out


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over a uint64 array: a bijection that scatters small integers."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
