"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from . import worker

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a temporary folder where it is unset (tests in local mode)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _local:
        _local["dir"] = tempfile.mkdtemp(prefix="lodestrata-")
        atexit.register(shutil.rmtree, _local["dir"], True)
    return "file://" + _local["dir"]


def _delete(context, *paths: str) -> None:
    conf = context._jsc.hadoopConfiguration()
    for path in paths:
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def _delete_at_exit(context, path: str) -> None:
    with contextlib.suppress(Exception):  # the gateway may be gone
        _delete(context, path)


class Scratch:
    """Named Parquet tables of one operator run.

    Writing a table cuts lineage: lost executors make Spark recompute from the
    written files, not from the beginning. After a write the shuffle files
    behind it are garbage, so the driver is asked to collect at once. What a result
    still reads is deleted when the application ends; after a failed write all goes.
    """

    def __init__(self, spark: SparkSession, name: str):
        worker.small_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(_delete_at_exit, spark.sparkContext, self.root)

    def save(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        schema = df.schema
        try:
            df.write.parquet(path)
        except BaseException:
            _delete_at_exit(self.spark.sparkContext, self.root)
            raise
        del df
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later step reads."""
        _delete(self.spark.sparkContext, *[t._scratch_path for t in tables])
