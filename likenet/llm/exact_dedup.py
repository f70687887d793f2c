"""Exact deduplication by a tree merge of sorted digest runs.

Every partition turns its documents into a sorted run of (digest, identifier to keep, copies).
Runs then meet in binomial rounds: in each round ``fan_in`` neighbouring runs of one digest range come to
one task, which merges them; equal digests collapse into one entry, and the entry retains the best identifier seen. Runs that
arrive are put in one order by Spark's sort, which takes presorted stretches as they are and spills; what follows is one pass over it.
After ``log(runs) / log(fan_in)`` rounds one run is left for every digest range, so the root of the tree
is spread over as many tasks as there are ranges and no task holds more than its range.

An entry is verified at each level: two texts count as equal when SHA-256 and byte length both agree; a
digest met with two lengths raises an error instead of merging different texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bodies, join_told, materialize, small_batches, text_frame, trimmed

RUN_SCHEMA = "digest binary, n_bytes long, best long, copies long, slot int, run int"
_NO_ID = np.iinfo(np.int64).min


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, n_bytes): SHA-256 of the text after lower-casing A-Z only."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = bodies(batch)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([hashlib.sha256(t.lower()).digest() for t in texts], pa.binary()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                ["doc_id", "digest", "n_bytes"],
            )

    return text_frame(docs, id_col, text_col).mapInArrow(trimmed(digests), "doc_id long, digest binary, n_bytes long")


def _merge(keep: str):
    """A pass over rows sorted by (slot, run, digest) that merges neighbours of equal digest."""
    best = np.maximum if keep == "max" else np.minimum
    absent = _NO_ID if keep == "max" else np.iinfo(np.int64).max

    def collapse(key, n_bytes, ids, copies):
        """key: (n, 5) words of slot, run and digest."""
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
        low, high = np.minimum.reduceat(n_bytes, first), np.maximum.reduceat(n_bytes, first)
        if (low != high).any():
            raise ValueError("one digest was met with two text lengths")
        return key[first], low, best.reduceat(ids, first), np.add.reduceat(copies, first)

    def emit(key, n_bytes, ids, copies):
        blob = np.ascontiguousarray(key[:, 1:]).tobytes()
        return pa.RecordBatch.from_arrays(
            [
                pa.array([blob[i : i + 32] for i in range(0, len(blob), 32)], pa.binary()),
                pa.array(n_bytes, pa.int64()),
                pa.array(ids, pa.int64(), mask=ids == absent),
                pa.array(copies, pa.int64()),
                pa.array((key[:, 0] >> np.uint64(32)).astype(np.int32)),
                pa.array((key[:, 0] & np.uint64(0xFFFFFFFF)).astype(np.int32)),
            ],
            ["digest", "n_bytes", "best", "copies", "slot", "run"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            words = np.frombuffer(b"".join(col["digest"].to_pylist()), np.uint64).reshape(-1, 4)
            lead = (col["slot"].to_numpy().astype(np.uint64) << np.uint64(32)) | col["run"].to_numpy().astype(np.uint64)
            now = (
                np.column_stack([lead, words]),
                col["n_bytes"].to_numpy(),
                col["best"].fill_null(absent).to_numpy(),
                col["copies"].to_numpy(),
            )
            if held:
                now = tuple(np.concatenate(x) for x in zip(held, now, strict=True))
            now = collapse(*now)
            held = tuple(x[-1:] for x in now)
            if len(now[0]) > 1:
                yield emit(*(x[:-1] for x in now))
        if held:
            yield emit(*held)

    return run


def tree_merge(prints: DataFrame, n_rows: int, keep: str = "max", fan_in: int = 16, range_rows: int = 250_000) -> DataFrame:
    """(digest, n_bytes, best, copies): one row for each digest of ``prints`` (doc_id, digest, n_bytes, run)."""
    spark = prints.sparkSession
    n_runs = (prints.agg(F.max("run")).first()[0] or 0) + 1
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // range_rows))
    merge, order = _merge(keep), ("slot", "run", "digest")
    head = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    runs = prints.select(
        "digest",
        "n_bytes",
        F.col("doc_id").alias("best"),
        F.lit(1).cast("long").alias("copies"),
        F.floor(head * width / F.lit(1 << 32)).cast("int").alias("slot"),
        "run",
    )
    runs = runs.sortWithinPartitions(*order).mapInArrow(trimmed(merge), RUN_SCHEMA)
    while n_runs > 1:
        runs = runs.withColumn("run", (F.col("run") / fan_in).cast("int"))
        runs = runs.repartition(width, "slot", "run").sortWithinPartitions(*order).mapInArrow(trimmed(merge), RUN_SCHEMA)
        n_runs = -(-n_runs // fan_in)
    return runs.select("digest", "n_bytes", "best", "copies")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", fan_in: int = 16) -> DataFrame:
    """One row per document, dropped ones too: doc_id, digest, n_bytes, keep_id, group_size, kept.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the row with the largest
    (``keep="max"``) or smallest (``keep="min"``) identifier stays. Null text counts as empty, and empty texts
    equal each other. Rows that repeat one identifier with one text are the same document: both say kept.
    A null identifier never stays while another row of its group has one; a group of null identifiers only
    has a null keep_id, and its rows say kept. An empty table gives an empty result. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    prints = materialize(fingerprint(docs, id_col, text_col).withColumn("run", F.spark_partition_id()), "prints")
    n_rows = prints.count()
    merged = materialize(tree_merge(prints, n_rows, keep, fan_in), "runs")
    told = merged.select("digest", F.col("best").alias("keep_id"), F.col("copies").alias("group_size"))
    joined = join_told(prints.drop("run"), told, "digest", "group_size", n_rows)
    return joined.select("doc_id", "digest", "n_bytes", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))
