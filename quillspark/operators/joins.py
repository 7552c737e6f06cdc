"""Reference resolution and existence checks between tables of a document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve_references(rows: DataFrame, objects: DataFrame, keys: Sequence[str], value: str, into: str) -> DataFrame:
    """Left equi-join on an object key; a dangling reference gives null."""
    target = objects.select(*keys, F.col(value).alias(into))
    return rows.join(target, list(keys), "left")


def inline_or_reference(rows: DataFrame, objects: DataFrame, keys: Sequence[str], inline: str, value: str, into: str) -> DataFrame:
    """The inline value where there is one, else that of the object referred to."""
    found = resolve_references(rows, objects, keys, value, "_referred")
    return found.withColumn(into, F.coalesce(inline, "_referred")).drop("_referred")


def priority_join(rows: DataFrame, choices: Sequence[tuple[DataFrame, Sequence[str]]], value: str, into: str) -> DataFrame:
    """The value of the first table, in order, that has the row's key; each table is unique on its key."""
    names = []
    for i, (table, keys) in enumerate(choices):
        name = f"_choice_{i}"
        rows = rows.join(table.select(*keys, F.col(value).alias(name)), list(keys), "left")
        names.append(name)
    return rows.withColumn(into, F.coalesce(*names)).drop(*names)


def last_owner(owners: DataFrame, keys: Sequence[str], order: Sequence[str], owner: str) -> DataFrame:
    """Of several owners of a key the last in order; an aggregation, so it combines before the shuffle."""
    return owners.groupBy(*keys).agg(F.max_by(F.col(owner), F.struct(*order)).alias(owner))


def orphans(rows: DataFrame, others: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that nothing in *others* names (notes without a reference, references without a note)."""
    return rows.join(others.select(*keys), list(keys), "left_anti")


def with_match(rows: DataFrame, others: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that something in *others* names."""
    return rows.join(others.select(*keys), list(keys), "left_semi")


def repeated(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs more than once.

    Keys are counted with partial aggregation and joined back, so that a hot key isn't gathered in a
    window of one task.
    """
    many = rows.groupBy(*keys).count().filter("count > 1").select(*keys)
    return rows.join(many, list(keys), "left_semi")


def missing_names(used: DataFrame, known: DataFrame, keys: Sequence[str], name: str, separator: str = "&") -> DataFrame:
    """Per document the distinct used names that aren't known, sorted and joined."""
    lost = used.join(known.select(*keys, name), [*keys, name], "left_anti")
    return lost.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(name)), separator).alias("missing"))


def joined_names(rows: DataFrame, keys: Sequence[str], name: str, separator: str = "&") -> DataFrame:
    """Per document the distinct names, sorted and joined."""
    return rows.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(name)), separator).alias("names"))


def consistent(rows: DataFrame, keys: Sequence[str], signature: str) -> DataFrame:
    """Whether all rows of a key have one signature at most (nulls don't count)."""
    low, high = F.min(signature), F.max(signature)
    return rows.groupBy(*keys).agg(F.coalesce(low == high, F.lit(True)).alias("consistent"))


def baseline_delta(current: DataFrame, previous: DataFrame, keys: Sequence[str], count: str = "count") -> DataFrame:
    """Current counts with their change since *previous*; null where the key is new.  Keys match null-safely."""
    old = previous.select(*[F.col(k).alias(f"_old_{k}") for k in keys], F.col(count).alias("previous_count"))
    same: Column = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_old_{k}"))
    joined = current.join(old, same, "left").drop(*[f"_old_{k}" for k in keys])
    return joined.withColumn("delta", F.col(count).cast("bigint") - F.col("previous_count").cast("bigint"))


def coverage_decreases(baseline: DataFrame, current: DataFrame, key: str, measures: Sequence[str]) -> DataFrame:
    """Baseline rows that are gone, or of which a measure is smaller now."""
    now = current.select(key, *[F.col(m).alias(f"now_{m}") for m in measures])
    joined = baseline.join(now, key, "left")
    less: Column = F.col(f"now_{measures[0]}").isNull()
    for m in measures:
        less = less | (F.col(f"now_{m}") < F.col(m))
    return joined.filter(less)


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence, values: Sequence[str]) -> DataFrame:
    """The first row of each key in order (the innermost scope wins), by aggregation."""
    first = F.min_by(F.struct(*values), F.struct(*order))
    return rows.groupBy(*keys).agg(first.alias("_first")).select(*keys, "_first.*")


def top_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence, most: int) -> DataFrame:
    """At most *most* rows of each key; Spark prunes each task to its own first rows before the shuffle."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("nth", nth).filter(F.col("nth") <= most)
