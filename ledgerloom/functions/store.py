"""Tables written between the steps of an operator, in the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; only in local mode a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{os.path.join(tempfile.gettempdir(), 'ledgerloom-shared')}"
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended before the interpreter; the folder is then left to its owner
        return


#: Folders written within each open ``passing`` block.
_OPEN: list[list[str]] = []


def stored(df: DataFrame, outlives: bool = False, little: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: lineage ends there and lost executors
    cost nothing that was written. Then the driver's garbage is collected, unless the table and what is behind it are
    ``little``. The files go at the end of the ``passing`` block around the call (``outlives``: of the block around that one),
    or else when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not little:
        spark.sparkContext._jvm.System.gc()  # so that Spark's cleaner drops the shuffle files of what is written now
    atexit.register(_remove, spark, path)
    around = _OPEN[: len(_OPEN) - outlives]
    if around:
        around[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are removed at the end; what is still wanted then has to be ``stored`` with ``outlives``."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            _remove(spark, path)
