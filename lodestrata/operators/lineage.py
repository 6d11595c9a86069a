"""Cutting the lineage of tables that a loop makes again and again."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame

SETTING = "spark.checkpoint.dir"
_local: dict[str, str] = {}


def cut(df: DataFrame) -> DataFrame:
    """``df``, written to the folder named by spark.checkpoint.dir; in local mode without the setting, to a temporary folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    named = spark.conf.get(SETTING, None)
    if context.getCheckpointDir() is None:
        if named is None and not context.master.startswith("local["):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        if named is None and "dir" not in _local:
            _local["dir"] = tempfile.mkdtemp(prefix="lodestrata-")
            atexit.register(shutil.rmtree, _local["dir"], True)
        context.setCheckpointDir(named or _local["dir"])
    return df.checkpoint()
