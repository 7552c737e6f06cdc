"""The folder that driver and executors share, and tables that cut lineage there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared ``spark.checkpoint.dir`` of the session.

    Where the setting is absent a local temporary folder takes its place if Spark runs in one process; on a
    cluster, whose executors wouldn't see that folder, it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-quill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write *df* to the shared folder and read it back: lineage is cut and a lost executor costs nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_for(rows: DataFrame, a_task: int) -> int:
    """How many tasks of about *a_task* rows each *rows* ask for."""
    return max(1, -(-rows.count() // a_task))


def spread(rows: DataFrame, a_task: int) -> DataFrame:
    """*rows* dealt evenly over tasks of about *a_task* rows each.

    Spark splits a table by the bytes of its files.  Where a row grows into a file or a tree of values, a small
    table would come as one task, whose time and memory grow with the table; the number of tasks does here.
    """
    return rows.repartition(tasks_for(rows, a_task))
