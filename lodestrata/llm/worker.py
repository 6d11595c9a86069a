"""What a Python worker keeps from task to task: one object, that of the last operator that kept one.

Workers are used again by later stages and queries, so each operator gives back
what an earlier one left before it begins.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20

_kept: dict[str, Any] = {}


def keep(name: str, make: Callable[[], Any]) -> Any:
    """This worker's object of that name; made if another one or none is kept."""
    if name not in _kept:
        free()
        _kept[name] = make()
    pa.default_memory_pool().release_unused()
    return _kept[name]


def free() -> None:
    """Gives the memory of what is kept, and what Arrow holds in reserve, back to the system."""
    pa.default_memory_pool().release_unused()
    if not _kept:
        return
    _kept.clear()
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library; it gives memory back in its own way
        pass


def small_batches(spark: SparkSession) -> None:
    """Has the session hand whole texts over in batches of BATCH_BYTES, if it is set to larger ones; a longer text is a batch by itself."""
    now = spark.conf.get(BATCH, "64m").lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30}.get(now[-1:], 0)
    if not 0 < int(now.rstrip("kmg")) << unit <= BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))
