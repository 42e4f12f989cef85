"""Intermediate tables in the folder that the driver and all executors share, where lineage ends."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where it is unset, a folder set before by the session's setCheckpointDir, or on a local master a temporary one set here;
    on a cluster that raises, as a folder of one machine would lose what the others write.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="fieldbiome-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; removed when the driver ends."""
    if not _written:
        atexit.register(_remove_written)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def _file(spark: SparkSession, path: str) -> tuple[object, object]:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    files, where = _file(spark, path)
    files.delete(where, True)


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """Writes a small file from the driver through Spark's file systems."""
    files, where = _file(spark, path)
    out = files.create(where, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders right under a path; none if it isn't there."""
    files, where = _file(spark, path)
    return [s.getPath().getName() for s in files.listStatus(where) if s.isDirectory()] if files.exists(where) else []


def _remove_written() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            return


def cut(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder as Parquet and read again: lineage ends here and a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Removes the files of frames that cut() returned, once all that reads them has been written."""
    for df in frames:
        remove(df.sparkSession, df._cut_path)
