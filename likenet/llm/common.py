"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import discard, materialize, shared_dir

__all__ = ["bodies", "discard", "held_out_column", "hot_rows", "join_told", "materialize", "mix64", "read_documents", "shared_dir", "small_batches", "text_frame", "trimmed"]


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, once per application: their Python needn't have it on its path."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[2]
    if sc.applicationId in _SHIPPED or not (root / "likenet").is_dir():
        return
    folder = tempfile.mkdtemp(prefix="likenet-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # the driver serves the file until it ends
    with zipfile.ZipFile(f"{folder}/likenet_code.zip", "w") as z:
        for path in sorted((root / "likenet").rglob("*.py")):
            z.write(path, path.relative_to(root))
    sc.addPyFile(f"{folder}/likenet_code.zip")
    _SHIPPED.add(sc.applicationId)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows and bytes of the session's Arrow batches, so that a batch of long texts stays small; make sure that executors have the code.

    The settings are read when a plan runs, so they stay. They are only ever lowered: results don't depend on them.
    """
    ship_code(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        now = spark.conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


#: A worker with less than this gives nothing back: that isn't worth the time.
_SMALL_WORKER = 120 << 20


def give_back(least: int = _SMALL_WORKER) -> None:
    """Return what this process has freed to the system, where it holds over ``least`` bytes."""
    pages = Path("/proc/self/statm")
    if pages.exists() and int(pages.read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE") < least:
        return
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


#: What operators remember in a worker, by operator.
MEMORIES: dict[str, dict] = {}


def drop_memories(keep: str) -> None:
    """Forget what operators other than ``keep`` remember in this process."""
    for operator, memory in MEMORIES.items():
        if operator != keep:
            memory.clear()


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], operator: str = ""):
    """A function for mapInArrow whose worker gives freed memory back when it is done with a partition.

    Workers are kept for the next stages, and while they wait, or do something small, they would keep what their largest partition took, beside the JVM.
    What another operator remembers goes before it begins.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_memories(operator)
        yield from run(batches)
        give_back()

    return wrapped


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_frame(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, body): the text as UTF-8 bytes, null as empty."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("body"),
    )


def bodies(batch: pa.RecordBatch, name: str = "body") -> list[bytes]:
    """The values of a binary column as Python bytes."""
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def held_out_column(id_col: str = "doc_id"):
    """Rows kept from training: CRC32 of the id's decimal text leaves 1 modulo 3."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, on arrays of unsigned integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def hot_rows(n_rows: int) -> int:
    """A key with more rows than this is hot: over a thousandth of the rows, or over 100,000. There are at most ``max(1000, n_rows / 100,000)`` such keys."""
    return min(100_000, max(1000, n_rows // 1000))


def join_told(rows: DataFrame, told: DataFrame, key: str, size: str, n_rows: int) -> DataFrame:
    """``rows`` joined with ``told``, which has one row for each key and says in ``size`` how many rows that key has.

    Rows of hot keys stay where they are: what is told about those keys is broadcast.
    """
    is_hot = F.col(size) > hot_rows(n_rows)
    hot = F.broadcast(told.where(is_hot))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(told.where(~is_hot), key))
