"""Cutting lineage so that a lost executor costs one stage, not the whole loop.

A cut is a Parquet table in the folder that the cluster names in
``spark.checkpoint.dir``, which all executors share. It is compressed, has
statistics for the next join's planning, and outlives every executor.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only where none is set.

    The temporary folder is for tests and single machines. On a master other
    than ``local[...]`` an unset ``spark.checkpoint.dir`` is an error, as a
    folder of one machine can't be read by the others.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        context = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = context.get().rsplit("/", 1)[0] if context.isDefined() else None
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is unset; name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="edgeloom-")
    spark.conf.set("spark.checkpoint.dir", own)
    _OWN.setdefault("made", []).append(own)
    return own


def _files(spark: SparkSession, path: str) -> tuple:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def materialise(df: DataFrame, label: str = "cut", by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written.

    With ``by``, a column of few values, a filter on it reads only its files.
    The table is deleted when the driver ends, or by ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/edgeloom-{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    files, target = _files(spark, path)
    files.deleteOnExit(target)
    cut = spark.read.schema(df.schema).parquet(path)
    cut._edgeloom_path = path
    return cut


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/edgeloom-{name}"
    files, target = _files(spark, path)
    files.deleteOnExit(target)
    return path


def discard(cut: DataFrame) -> None:
    """Delete a table of ``materialise`` that no later plan reads."""
    path = getattr(cut, "_edgeloom_path", None)
    if path:
        files, target = _files(cut.sparkSession, path)
        files.delete(target, True)


def release(spark: SparkSession) -> None:
    """Let the shuffle files of jobs that no plan holds any more be deleted, which Spark does when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@atexit.register
def _clean() -> None:
    import shutil

    for path in _OWN.get("made", []):
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
