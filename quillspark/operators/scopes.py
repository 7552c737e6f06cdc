"""Streams of operators: running sums, values carried forward, scopes and caps, in two phases.

One stream may hold a third of all rows, so nothing here is a window over a whole stream.  A stream is cut into
blocks of consecutive places; windows run inside a block, then over one row for each block, and what a block begins
with is joined back to its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.shared import materialise

BLOCK_ROWS = 100_000


def _blocked(rows: DataFrame, block_rows: int) -> DataFrame:
    return rows.withColumn("_block", F.floor(F.col("seq") / block_rows))


def _inside(*keys: str) -> Window:
    return Window.partitionBy(*keys, "_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)


def _before(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)


def _begin_with(rows: DataFrame, begins: DataFrame, keys: list[str]) -> DataFrame:
    """*rows* joined with what their block begins with; keys may be null."""
    theirs = begins.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_of"), *[c for c in begins.columns if c not in (*keys, "_block")])
    same = rows["_block"] == theirs["_of"]
    for k in keys:
        same = same & rows[k].eqNullSafe(theirs[f"_k_{k}"])
    return rows.join(theirs, same, "left").drop("_of", *[f"_k_{k}" for k in keys])


def running_sums(rows: DataFrame, sums: dict[str, Column], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """*rows* (``doc_id``, ``seq``) with the running sum, own row included, of each of *sums* in its stream."""
    inside = _blocked(rows, block_rows)
    for name, value in sums.items():
        inside = inside.withColumn(name, F.sum(value).over(_inside("doc_id")))
    inside = materialise(inside, "scopes-sums")
    # the last row's sums are its block's; a row for each block of a stream
    totals = inside.groupBy("doc_id", "_block").agg(*[F.max_by(n, "seq").alias(n) for n in sums])
    begins = totals.select("doc_id", "_block", *[F.coalesce(F.sum(n).over(_before("doc_id")), F.lit(0)).alias(f"_at_{n}") for n in sums])
    met = _begin_with(inside, begins, ["doc_id"])
    return met.withColumns({n: F.col(n) + F.coalesce(f"_at_{n}", F.lit(0)) for n in sums}).drop("_block", *[f"_at_{n}" for n in sums])


def carried(rows: DataFrame, keys: list[str], value: str, into: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The last *value* that isn't null among the rows with the same *keys* up to and including each row."""
    inside = _blocked(rows, block_rows).withColumn(into, F.last(value, ignorenulls=True).over(_inside(*keys)))
    inside = materialise(inside, "scopes-carried")
    lasts = inside.groupBy(*keys, "_block").agg(F.max_by(into, "seq").alias("_last"))
    begins = lasts.select(*keys, "_block", F.last("_last", ignorenulls=True).over(_before(*keys)).alias("_at"))
    return _begin_with(inside, begins, keys).withColumn(into, F.coalesce(into, "_at")).drop("_block", "_at")


def depths(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """*rows* (``doc_id``, ``seq``, ``kind``) with ``depth`` behind each: ``open`` adds a level, ``close`` ends one, never below zero.

    With the running sum S and its running minimum m the depth is S - min(0, m); both come in two phases.
    """
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0).cast("long")
    inside = _blocked(rows, block_rows).withColumn("_sum", F.sum(step).over(_inside("doc_id")))
    inside = materialise(inside.withColumn("_low", F.min("_sum").over(_inside("doc_id"))), "scopes-depths")
    blocks = inside.groupBy("doc_id", "_block").agg(F.max_by("_sum", "seq").alias("_total"), F.min("_low").alias("_least"))
    blocks = blocks.withColumn("_at", F.coalesce(F.sum("_total").over(_before("doc_id")), F.lit(0)))
    begins = blocks.select("doc_id", "_block", "_at", F.coalesce(F.min(F.col("_at") + F.col("_least")).over(_before("doc_id")), F.lit(0)).alias("_low_at"))
    met = _begin_with(inside, begins, ["doc_id"])
    at, low = F.coalesce("_at", F.lit(0)), F.coalesce("_low_at", F.lit(0))
    return met.withColumn("depth", at + F.col("_sum") - F.least(F.lit(0), low, at + F.col("_low"))).drop("_block", "_sum", "_low", "_at", "_low_at")


def in_force(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """*rows* (``doc_id``, ``seq``, ``kind``, ``value``) with ``depth``, ``scope`` and the ``value`` in force behind each.

    A row of kind ``set`` puts its value (null: none of its own) in force; ``open`` saves what is in force and ``close``
    restores it, so what a closed scope set is not seen after it; a ``close`` without an ``open`` does nothing.
    ``scope`` is the place of the ``open`` row that the row stands in, null outside all.  ``seq`` is unique in a
    stream.  Streams without any value give nulls; an empty table gives none.

    A row at depth d stands in the scope of the last ``open`` that led to depth d.  The last value set in the
    row's own scope holds, else the one in force where the scope was opened, which scopes find from their
    enclosing scopes by doubling: log2(depth) joins of one row a scope.
    """
    placed = depths(rows, block_rows).withColumn("_open", F.when(F.col("kind") == "open", F.col("seq"))).withColumn("_set", F.when(F.col("kind") == "set", F.col("value")))
    placed = placed.withColumn("_outer", F.lit(False))
    # an open row stands in its own scope; a copy of it, which opens nothing, stands in the enclosing one
    copies = placed.filter("_open IS NOT NULL").withColumns({"depth": F.col("depth") - 1, "_open": F.lit(None).cast("bigint"), "_outer": F.lit(True)})
    placed = carried(placed.unionByName(copies), ["doc_id", "depth"], "_open", "scope", block_rows)
    placed = placed.withColumn("scope", F.when(F.col("depth") > 0, F.col("scope")))
    placed = materialise(carried(placed, ["doc_id", "scope"], "_set", "_own", block_rows), "scopes-placed")
    scopes = placed.filter("_outer").select("doc_id", F.col("seq").alias("scope"), F.col("scope").alias("outer"), F.col("_own").alias("entry"))
    scopes = materialise(scopes, "scopes-entries")
    while not scopes.filter("entry IS NULL AND outer IS NOT NULL").isEmpty():
        above = scopes.select("doc_id", F.col("scope").alias("outer"), F.col("outer").alias("_further"), F.col("entry").alias("_entry"))
        met = scopes.join(above, ["doc_id", "outer"], "left")
        open_ = F.col("entry").isNull()
        scopes = materialise(met.select("doc_id", "scope", F.when(open_ & F.col("_entry").isNull(), F.col("_further")).alias("outer"), F.coalesce("entry", "_entry").alias("entry")), "scopes-entries")
    entries = scopes.select("doc_id", "scope", F.col("entry").alias("_entry"))
    found = placed.filter("NOT _outer").join(entries, ["doc_id", "scope"], "left")
    return found.select(*[c for c in rows.columns if c != "value"], "depth", "scope", F.coalesce("_own", "_entry").alias("value"))


def capped_segments(rows: DataFrame, most: int, most_bytes: int, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """The rows between the ``ends`` rows of a stream, cut where a segment exceeds its caps; and one warning a segment cut.

    *rows* has ``doc_id``, ``seq``, ``ends`` and ``bytes`` (null: 0).  ``segment`` counts the ends before a row, ``count`` and
    ``running_bytes`` the segment's rows and bytes up to it; the first row over *most* or *most_bytes* and
    those behind it in the segment go.  Warnings are ``doc_id``, ``segment``, ``seq`` of the first that goes.
    """
    plain = F.when(F.col("ends"), 0).otherwise(1).cast("long")
    size = F.when(F.col("ends"), 0).otherwise(F.coalesce("bytes", F.lit(0))).cast("long")
    summed = running_sums(rows, {"_ends": 1 - plain, "_n": plain, "_b": size}, block_rows)
    # what had run up to the last end is taken off
    based = carried(summed.withColumn("_base", F.when(F.col("ends"), F.struct("_n", "_b"))), ["doc_id"], "_base", "_from", block_rows)
    n, b = (F.col(f"_{x}") - F.coalesce(F.col(f"_from._{x}"), F.lit(0)) for x in "nb")
    met = based.filter(~F.col("ends")).withColumns({"segment": F.col("_ends"), "count": n, "running_bytes": b}).drop("_ends", "_n", "_b", "_base", "_from")
    over = (F.col("count") > most) | (F.col("running_bytes") > most_bytes)
    was_over = (F.col("count") - 1 > most) | (F.col("running_bytes") - F.coalesce("bytes", F.lit(0)) > most_bytes)
    return met.filter(~over), met.filter(over & ~was_over).select("doc_id", "segment", "seq")
