"""Nested values as VARIANT: own keys and inner ones apart at any depth, typed properties before generic ones.

A nested value is asked by path, so what stands inside another dictionary or inside a string is never taken
for the object's own.  Properties are pairs of value and error as in ``checked``: a name that is listed and
absent is null, a name that isn't listed is an error.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.checked import Checked
from quillspark.shared import materialise

MAX_LEVELS = 128
_SPARK_TYPE = {"number": "double", "string": "string", "bool": "boolean", "list": "array<string>"}


def path_to(*keys: str | int) -> str:
    """The path of nested keys (strings) and places in lists (numbers)."""
    return "$" + "".join(f"[{k}]" if isinstance(k, int) else "['" + k.replace("\\", "\\\\").replace("'", "\\'") + "']" for k in keys)


def at(value: Column, *keys: str | int, kind: str = "variant") -> Column:
    """What stands at nested *keys* as a Spark type; null where it is absent or of another type."""
    return F.try_variant_get(value, path_to(*keys), kind)


def whole_number(value: Column, *keys: str | int) -> Column:
    """The whole number at nested *keys*; null for any other value, a fraction or text among them."""
    found = at(value, *keys) if keys else value
    return F.when(F.schema_of_variant(found) == "BIGINT", F.try_variant_get(found, "$", "bigint"))


def entries_of(value: Column) -> Column:
    """A dictionary's own entries as a map of variants; null for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def own_keys(value: Column) -> Column:
    return F.map_keys(entries_of(value))


def members(value: Column) -> Column:
    """A dictionary's values or a list's elements; the value itself, where it is neither, alone."""
    return F.coalesce(F.map_values(entries_of(value)), F.try_variant_get(value, "$", "array<variant>"), F.when(value.isNotNull(), F.array(value)))


def unknown_property(name: str) -> Column:
    return F.lit(f"unknown property: {name}")


def dictionary_property(value: Column, name: str, kind: str, allowed: Sequence[str]) -> Checked:
    """An own entry by name: null where it is absent, an error where *allowed* doesn't list the name or the type is another."""
    if name not in allowed:
        return Checked(F.lit(None).cast(_SPARK_TYPE[kind]), kind, unknown_property(name), leaf=True)
    found, there = at(value, name, kind=_SPARK_TYPE[kind]), at(value, name)
    return Checked(found, kind, F.when(there.isNotNull() & ~F.is_variant_null(there) & found.isNull(), F.lit(f"wrong type: {name}")), leaf=True)


def property_of(name: str, kind: str, family: Column, typed: Mapping[str, Mapping[str, Checked]], generic: Mapping[str, Checked], is_object: Column) -> Checked:
    """A property by the row's family, else, where the row is an object, the generic one; else an error.

    A typed property that is known is final, whether its value is null or its evaluation an error.
    """
    none, unknown = F.lit(None).cast(_SPARK_TYPE[kind]), unknown_property(name)
    value = F.when(is_object, generic[name].value) if name in generic else none
    error = F.when(is_object, generic[name].err).otherwise(unknown) if name in generic else unknown
    for owner, properties in typed.items():
        if name in properties:
            value = F.when(family == owner, properties[name].value).otherwise(value)
            error = F.when(family == owner, properties[name].err).otherwise(error)
    return Checked(value.cast(_SPARK_TYPE[kind]), kind, error, leaf=True)


def all_entries(rows: DataFrame, value: str, max_levels: int = MAX_LEVELS) -> DataFrame:
    """Every entry at any depth of the variants in column *value*: the other columns, ``path``, ``order``, ``depth``, ``key``, ``container``, ``value``.

    One round opens all values of one level, so a level costs a pass over that level's values only; each
    round is a written table.  ``key`` is null for a list's elements, whose place stands in the path.  ``order`` is the
    path with places padded, so that entries sort by it as they stand.  Values
    below *max_levels* stay closed and are told by ``container``.  Null and plain values have no entries.
    """
    others = [c for c in rows.columns if c != value]
    empty = F.array().cast("array<string>")
    level, depth, found = rows.select(*others, empty.alias("path"), empty.alias("order"), F.col(value).alias("value")), 0, None
    while depth < max_levels:
        depth += 1
        of_map = F.transform(F.map_entries(entries_of(F.col("value"))), lambda e: F.struct(e["key"].alias("step"), e["key"].alias("place"), e["key"].alias("key"), e["value"].alias("value")))
        of_list = F.transform(F.try_variant_get("value", "$", "array<variant>"), lambda x, i: F.struct(i.cast("string").alias("step"), F.lpad(i.cast("string"), 10, "0").alias("place"), F.lit(None).cast("string").alias("key"), x.alias("value")))
        opened = level.select(*others, "path", "order", F.explode(F.coalesce(of_map, of_list)).alias("e"))
        inner = F.col("e.value")
        container = F.coalesce(entries_of(inner).isNotNull(), F.lit(False)) | F.coalesce(F.try_variant_get(inner, "$", "array<variant>").isNotNull(), F.lit(False))
        opened = materialise(opened.select(*others, F.array_append("path", F.col("e.step")).alias("path"), F.array_append("order", F.col("e.place")).alias("order"), F.lit(depth).alias("depth"), F.col("e.key").alias("key"), container.alias("container"), inner.alias("value")), "nested-level")
        found = opened if found is None else found.unionByName(opened)
        level = opened.filter("container").select(*others, "path", "order", "value")
        if level.isEmpty():
            break
    return found
