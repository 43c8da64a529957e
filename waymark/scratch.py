"""Tables at which a plan is cut: written to the folder that the cluster shares, and read back.

This evaluates a plan once, keeps its lineage short and survives the loss of
any executor.  Every application has a folder of its own, which goes when its
driver ends; ``release`` removes single tables earlier.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch, at most, on the way to Python while a table is made.  A task has some copies of a batch in native memory, in the JVM and in Python.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_OWN: dict[str, str] = {}
_RUNS: set[str] = set()
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where that is unset, a temporary folder does in local mode only; on a
    cluster every executor would write to a disk of its own, so it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "dir" not in _OWN:
            _OWN["dir"] = tempfile.mkdtemp(prefix="waymark-")
            atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
        path = _OWN["dir"]
    return path.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def run_dir(spark: SparkSession) -> str:
    """This application's own folder; removed when the driver ends."""
    path = f"{shared_dir(spark)}/waymark-{spark.sparkContext.applicationId}"
    if path not in _RUNS:
        fs, at = _file_system(spark, path)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _RUNS.add(path)
    return path


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Inside, Arrow batches hold ``BATCH_BYTES`` at most, or one row; a lower limit of the session's own stays."""
    before, explicit = spark.conf.get(_BATCH), _BATCH in spark.conf.getAll
    if 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before) <= BATCH_BYTES:
        yield
        return
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        if explicit:
            spark.conf.set(_BATCH, before)
        else:
            spark.conf.unset(_BATCH)


def stored(df: DataFrame, label: str) -> DataFrame:
    spark: SparkSession = df.sparkSession
    path = f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes tables that ``stored`` gave and that no result reads any more."""
    for df in tables:
        path = _PATHS.pop(df, None)
        if path:
            fs, at = _file_system(df.sparkSession, path)
            fs.delete(at, True)
