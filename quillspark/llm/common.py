"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import threading
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.shared import materialise, scratch_path

__all__ = ["LOWER", "UPPER", "bounded_batches", "drop_rows", "materialise", "release", "resident", "scratch_path", "shuffle_partitions", "slices", "table", "text_or_empty", "trim"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Bytes of an Arrow batch between Spark and a Python worker, unless the session sets its own bound.
BATCH_BYTES = 4 * 1024 * 1024
_BATCH_SETTING, _SPARK_S_OWN = "spark.sql.execution.arrow.maxBytesPerBatch", 64 * 1024 * 1024


def bounded_batches(df: DataFrame) -> DataFrame:
    """*df*, after bounding the session's Arrow batches by bytes, whatever the length of its texts.

    Spark reads the bound when the plan runs, so the setting stays in the session; one that is not Spark's default is kept.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_SETTING, None) in (None, str(_SPARK_S_OWN), f"{_SPARK_S_OWN}b", "64m", "64MB"):
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df


_resident: dict[Any, Any] = {}
_task: list[int] = []
_touched: list[float] = []
#: Seconds after which a worker without a task drops its model.
IDLE_SECONDS = 4.0


def resident(key: Any, build: Callable[[], Any]) -> Any:
    """The model that a Python worker holds: built once, and dropped when a task needs another one, or none.

    Workers outlive stages, so models of earlier stages would otherwise add up.  One that waits for work
    drops its model after a while.
    """
    held = _resident.get(key)
    if held is None:
        _resident.clear()
        held = build()
        _touch()  # a slow build must not look like idleness, and what is held here can't be dropped meanwhile
        _resident[key] = held
        gc.collect()
        trim()
    _touch()
    return held


def release() -> None:
    """Drop the worker's model and give freed memory back to the system, once in a task.

    Tasks without a model of their own call this when they begin.
    """
    context = TaskContext.get()
    now = context.taskAttemptId() if context else -1
    if _task == [now]:
        return
    _task[:] = [now]
    if _resident:
        _resident.clear()
        gc.collect()
    trim()
    _touch()


def _touch() -> None:
    """Note that the worker has work, and see to it that its memory is given back when it has none."""
    first = not _touched
    _touched[:] = [time.monotonic()]
    if first and TaskContext.get() is not None:
        threading.Thread(target=_tidy, daemon=True).start()


def _tidy() -> None:
    tidied = 0.0
    while True:
        time.sleep(IDLE_SECONDS / 2)
        last = _touched[0]
        if last > tidied and time.monotonic() - last > IDLE_SECONDS:
            tidied = last
            _resident.clear()  # a task that is still at it keeps its own reference
            gc.collect()
            trim()


def trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(sizes: Sequence[int], limit: int) -> Iterator[tuple[int, int]]:
    """Cut rows 0..n into consecutive runs whose sizes add up to about *limit*; a larger row stands alone."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def drop_rows(docs: DataFrame, doomed: DataFrame, digest) -> DataFrame:
    """Rows of *docs* without those listed in *doomed*, all columns kept.

    *doomed* has ``_id``, ``_digest`` and ``_repeat``: true where an identical row (same id, same
    digest) stays, so that one of the repeats is kept.  *digest* gives a row's digest from its text.
    The join is planned by Spark: broadcast under its size threshold, else a sort-merge join that
    adaptive execution splits where one id is hot.
    """
    tagged = docs.withColumn("_digest_of_row", digest)
    listed = doomed.select(F.col("_id").alias("_doomed_id"), F.col("_digest").alias("_doomed_digest"), "_repeat").distinct()
    same = tagged["doc_id"].eqNullSafe(listed["_doomed_id"]) & (tagged["_digest_of_row"] == listed["_doomed_digest"])
    kept = tagged.join(listed, same, "left_anti").select(*docs.columns)
    repeats = listed.filter("_repeat")
    if repeats.isEmpty():
        return kept
    again = tagged.join(repeats, same, "left_semi").dropDuplicates(["doc_id", "_digest_of_row"]).select(*docs.columns)
    return kept.unionByName(again)
