"""Tables written to the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where the setting is absent in local mode (tests) a temporary folder of this process is used; on a cluster that is an error, for
    executors couldn't see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="likenet-")
        atexit.register(shutil.rmtree, _LOCAL_DIRS[app], ignore_errors=True)
    return _LOCAL_DIRS[app]


def _on_cluster(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def shared_path(spark: SparkSession, label: str) -> str:
    """A path that isn't taken, in a new folder inside the shared one; the folder goes when the session ends."""
    folder = f"{shared_dir(spark)}/likenet-{label}-{uuid.uuid4().hex}"
    files, at = _on_cluster(spark, folder)
    files.mkdirs(at)
    files.deleteOnExit(at)
    return f"{folder}/rows"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    The files go when the session ends, or by ``discard``. They are compressed with zstd, whose buffers lie on the heap: those
    of the default codec lie outside it and stay until a collection that many small files never cause.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/likenet-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    files, at = _on_cluster(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._likenet_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a frame that ``materialize`` returned and nobody will read again."""
    path = getattr(df, "_likenet_path", None)
    if path:
        files, at = _on_cluster(df.sparkSession, path)
        files.delete(at, True)
