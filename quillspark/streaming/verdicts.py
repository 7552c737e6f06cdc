"""Verdicts of documents that arrive in a folder, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators.rules import Rule, apply_rules


def arriving(spark: SparkSession, folder: str, schema, files_per_batch: int = 100) -> DataFrame:
    """Object rows of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def streamed_outcomes(objects: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rules are column expressions, so the batch operator serves a stream without change."""
    return apply_rules(objects, rules)


def outcome_counts(outcomes: DataFrame, time: str | None = None, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Running counts by rule and outcome, or by event-time window with late rows up to the watermark."""
    if time is None:
        return outcomes.groupBy("rule_id", "outcome").agg(F.count("*").alias("n"))
    return outcomes.withWatermark(time, late).groupBy(F.window(time, window), "rule_id", "outcome").agg(F.count("*").alias("n"))


def write_counts(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch's changed counts as a Parquet folder of its own; a repeated batch overwrites itself."""

    def save(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start()
