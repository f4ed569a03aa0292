"""What the operators share: reading tables, text buffers, shared checkpoints."""
from __future__ import annotations

import ctypes
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.sources.hadoop import shared_folder

BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table in as many partitions as there are cores, at least. Only files too few for the cores are dealt out anew; a large table stays as it is read."""
    df, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; make one of our own only where none is named and everything runs on this machine."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, across tasks."""
    return sys.modules.setdefault("_noteloom_worker_cache", types.ModuleType("_noteloom_worker_cache")).__dict__


def release() -> None:
    """Give freed memory back to the system; a worker that serves many tasks would keep it. Does nothing where the C library has no such call."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def strings(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; null reads as empty."""
    return [x or "" for x in column.to_pylist()]


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in a row, and the offsets at which its texts start and end; null reads as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: int, most: int) -> list[pa.RecordBatch]:
    """Slices of a batch of about ``most`` text bytes each (one row at least), so that memory follows neither batch size nor row width."""
    ends = np.cumsum(np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), np.int64)) if batch.num_rows else np.zeros(0, np.int64)
    out, at = [], 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        out.append(batch.slice(at, to - at))
        at = to
    return out


def bucket_of(doc_id) -> Column:
    """crc32 of the id as text, modulo 5: the fold of a document. A null id has fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)), F.lit(0))
