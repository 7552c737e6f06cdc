"""Exact dedup by content sort (DataFrame functions only).

The normalised bytes are put in order by an external, sampled range sort: Spark draws splitters from the
keys and deals the rows by range, so that equal texts come into one range and lie next to each other.
A key is the head of the normalised text with a hash behind it, which orders what shares an opening.
Each row is compared in full with the row before it; a run of equal texts has one number and yields its
largest id and its size.  Nothing is decided by a hash: texts whose keys collide are told apart there.

A key that holds more than a partition's share of the rows or bytes (fewer keys than partitions can) is
hot.  Only its rows get a salt in the key, so that they fill many ranges; each of these is reduced to the
representatives of its runs, which are then sorted and compared in full across the ranges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import LOWER, UPPER, materialise, shuffle_partitions, table, text_or_empty

HEAD_CHARS = 64


def normalised(column):
    """Lower-case A-Z only; every other character stays."""
    return F.translate(column, UPPER, LOWER)


def content_key(norm):
    """What orders texts with the same head; it need not tell them apart."""
    return F.xxhash64(norm)


def _hot_keys(rows: DataFrame, partitions: int) -> DataFrame:
    """``key``, ``hot`` of the keys that hold more than a partition's share of the rows or bytes: fewer than twice the partitions.

    Counts are pre-aggregated where the texts are.
    """
    size = F.octet_length("norm") + 32
    counts = materialise(rows.groupBy("key").agg(F.count("*").alias("n"), F.sum(size).alias("bytes")), "exact-dedup-keys")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    large = (F.col("n") * partitions > total["n"]) | (F.col("bytes") * partitions > total["bytes"])
    return counts.filter(large & (F.col("n") > 1)).select("key", F.lit(True).alias("hot"))


def exact_dedup(docs: DataFrame, head_chars: int = HEAD_CHARS, key: Callable[[Column], Column] = content_key) -> DataFrame:
    """One row per row of *docs* (``doc_id``, ``text``): which row of its group of equal texts stays.

    Null text counts as empty, so null and empty texts form one group.  Very long texts are sorted and
    compared whole.  Of equal texts the row with the largest ``doc_id`` stays; a null id is smaller than any
    other.  Of repeated rows (same id and text) exactly one is ``kept``.  Other columns are ignored.  An
    empty table gives an empty result.
    """
    partitions = shuffle_partitions(docs.sparkSession)
    rows = docs.select("doc_id", normalised(text_or_empty()).alias("norm"))
    rows = rows.select("doc_id", "norm", F.substring("norm", 1, head_chars).alias("head"), key(F.col("norm")).alias("key"))
    dealt = rows.join(F.broadcast(_hot_keys(rows, partitions)), "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    dealt = dealt.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(partitions))).otherwise(F.lit(0)))
    place = ["head", "key", "salt"]
    ranged = dealt.repartitionByRange(*place)

    # neighbours in the order of the whole texts
    in_order = Window.partitionBy(*place).orderBy("norm", F.col("doc_id").desc())
    before = F.lag("norm").over(in_order)
    opens = before.isNull() | (before != F.col("norm"))
    compared = ranged.withColumn("opens", opens).withColumn("run", F.sum(F.col("opens").cast("long")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    light = compared.select("doc_id", *place, "hot", "opens", "run", F.sha2("norm", 256).alias("text_sha256"), F.when(F.col("hot") & F.col("opens"), F.col("norm")).alias("norm"))
    run = Window.partitionBy(*place, "run")
    runs = light.withColumn("keep_id", F.max("doc_id").over(run)).withColumn("group_size", F.count("*").over(run))
    runs = materialise(runs, "exact-dedup-runs")
    out = ["doc_id", "keep_id", "group_size", (F.col("opens") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256"]
    cold = runs.filter(~F.col("hot")).select(*out)

    # hot keys: the runs' representatives, a few for each salt, are compared with their neighbours in turn
    across = Window.partitionBy("head", "key").orderBy("norm")
    last = F.lag("norm").over(across)
    groups = (
        runs.filter("hot AND opens").select(*place, "run", "norm", "keep_id", "group_size")
        .withColumn("group", F.sum(F.when(last.isNull() | (last != F.col("norm")), 1).otherwise(0)).over(across.rowsBetween(Window.unboundedPreceding, 0)))
    )
    group = Window.partitionBy("head", "key", "group")
    groups = groups.select(*place, "run", F.max("keep_id").over(group).alias("keep_id"), F.sum("group_size").over(group).alias("group_size"))
    groups = materialise(groups, "exact-dedup-groups")
    merged = runs.filter("hot").drop("keep_id", "group_size", "norm").join(groups, [*place, "run"])
    return cold.unionByName(merged.select(*out))


def deduplicated(docs: DataFrame, head_chars: int = HEAD_CHARS, key: Callable[[Column], Column] = content_key) -> DataFrame:
    """The rows of *docs* that stay, with all their columns.

    Nulls, ties, repeats and empty tables are as in :func:`exact_dedup`, whose sort carries the whole rows
    here, so that nothing is joined back: each run of equal neighbours keeps its first row.  Rows of hot keys
    go by themselves, salted, and the rows that their runs keep are compared in turn.
    """
    partitions = shuffle_partitions(docs.sparkSession)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    norm = normalised(F.coalesce(F.col("row").getField("text"), F.lit("")))
    rows = docs.select(whole.alias("row"), F.col("doc_id").alias("id"), normalised(text_or_empty()).alias("norm"))
    rows = rows.withColumn("head", F.substring("norm", 1, head_chars)).withColumn("key", key(F.col("norm")))
    hot = _hot_keys(rows, partitions)
    light = rows.drop("norm")  # made again behind the exchange, so that a text travels once

    def firsts(dealt: DataFrame, *place: str) -> DataFrame:
        in_order = Window.partitionBy(*place).orderBy("norm", F.col("id").desc())
        before = F.lag("norm").over(in_order)
        return dealt.withColumn("norm", norm).withColumn("opens", before.isNull() | (before != F.col("norm"))).filter("opens")

    cold = light.join(F.broadcast(hot.select("key")), "key", "left_anti").repartitionByRange("head", "key")
    salted = light.join(F.broadcast(hot.select("key")), "key", "left_semi").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(partitions)))
    some = firsts(salted.repartitionByRange("key", "salt"), "head", "key", "salt").select("row", "id", "head", "key")
    some = materialise(some, "exact-dedup-hot")  # a row for each salt of a hot text
    both = firsts(cold, "head", "key").select("row").unionByName(firsts(some, "head", "key").select("row"))
    return both.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept,
       sha256(norm) AS text_sha256
FROM n WINDOW g AS (PARTITION BY norm)
"""
