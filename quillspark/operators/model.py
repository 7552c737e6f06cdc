"""The object graph as tables: families, identity, links, name and number trees, page resources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.hierarchy import ancestor_paths
from quillspark.shared import tasks_for

#: Paths that one task opens into a row for each node on them.
PATHS_A_TASK = 20_000

# The family of a dictionary by its Subtype, else by its Type, else by the keys it has.
FAMILY_BY_SUBTYPE = {"Image": "image", "Form": "formXObject", "PS": "postScriptXObject", "Widget": "formField"}
FAMILY_BY_TYPE = {
    "Pages": "pageTree", "Action": "action", "StructTreeRoot": "structureTreeRoot", "StructElem": "structureElement", "Sig": "signature", "EmbeddedFile": "embeddedFontFile", "OCProperties": "optionalContentProperties", "XObject": "xObject",
    "Font": "font", "Annot": "annotation", "Metadata": "metadata", "OutputIntent": "outputIntent", "Filespec": "fileSpec",
}
FAMILY_BY_KEYS = (
    (("Fields",), "acroForm"), (("Filter", "V"), "security"), (("CMapName",), "cMap"), (("ShadingType",), "shading"), (("FunctionType",), "function"), (("PatternType",), "pattern"), (("N", "Alternate"), "iccProfile"), (("ByteRange",), "signature"),
)
FONT_KINDS = {"Type0": "type0", "Type1": "type1", "MMType1": "mmType1", "TrueType": "trueType", "Type3": "type3", "CIDFontType0": "cidFontType0", "CIDFontType2": "cidFontType2"}
XOBJECT_KINDS = {"Image": "image", "Form": "xObject", "PS": "postScriptXObject"}


def lookup(table: dict[str, str], name: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for item in table.items() for x in item]), name)


def family(type_: Column, subtype: Column, keys: Column) -> Column:
    """The family of a dictionary with these Type, Subtype and keys (an array); null where none fits."""
    by_keys = F.lit(None).cast("string")
    for names, found in reversed(FAMILY_BY_KEYS):
        has = F.lit(True)
        for name in names:
            has = has & F.array_contains(keys, name)
        by_keys = F.when(has, found).otherwise(by_keys)
    return F.coalesce(lookup(FAMILY_BY_SUBTYPE, subtype), lookup(FAMILY_BY_TYPE, type_), by_keys)


def xobject_kind(subtype: Column) -> Column:
    return lookup(XOBJECT_KINDS, subtype)


def font_kind(subtype: Column) -> Column:
    return lookup(FONT_KINDS, subtype)


def identity_key(family_: Column, *parts: Column) -> Column:
    return F.concat_ws(":", family_, *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])


def distinct_objects(objects: DataFrame) -> DataFrame:
    """One row per document and identity key, the first visited; ``visit_seq`` is numbered anew by nothing."""
    names = [n for n in objects.columns if n not in ("doc_id", "identity_key")]
    first = objects.groupBy("doc_id", "identity_key").agg(F.min_by(F.struct(*names), "visit_seq").alias("o"))
    return first.select("doc_id", "identity_key", "o.*")


def only_families(objects: DataFrame, families: Sequence[str]) -> DataFrame:
    """Rows that rules or policies name; the filter reaches the scan of a materialised table."""
    return objects.filter(F.col("family").isin(*families))


def over_budget(objects: DataFrame, most: int) -> DataFrame:
    """Documents with more objects than allowed."""
    return objects.groupBy("doc_id").agg(F.count("*").alias("objects")).filter(F.col("objects") > most)


def linked_values(links: DataFrame, objects: DataFrame, target_family: str, value: str) -> DataFrame:
    """Values of the objects of a family that a node links to, by family and not by the link's name.

    ``n`` is their number, ``scalar`` the value where there is exactly one and ``least`` the smallest, so
    a hub with very many links costs one row.
    """
    targets = objects.filter(F.col("family") == target_family).select("doc_id", F.col("identity_key").alias("dst"), F.col(value).alias("_value"))
    rows = links.join(targets, ["doc_id", "dst"]).groupBy("doc_id", "src").agg(F.count("*").alias("n"), F.min("_value").alias("least"))
    return rows.withColumn("scalar", F.when(F.col("n") == 1, F.col("least")))


def link_lists(links: DataFrame, objects: DataFrame, target_family: str, value: str, most: int) -> DataFrame:
    """The first *most* linked values of each node in link order, as a list."""
    from quillspark.operators.joins import top_per_key

    targets = objects.filter(F.col("family") == target_family).select("doc_id", F.col("identity_key").alias("dst"), F.col(value).alias("_value"))
    rows = top_per_key(links.join(targets, ["doc_id", "dst"]), ["doc_id", "src"], ["ord"], most)
    values = F.transform(F.array_sort(F.collect_list(F.struct("ord", "_value"))), lambda x: x["_value"])
    return rows.groupBy("doc_id", "src").agg(values.alias("values"))


def tree_entries(nodes: DataFrame, entries: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries of name and number trees by the tree's root.

    *nodes* has ``doc_id``, ``node``, ``parent``; *entries* ``doc_id``, ``node``, ``seq``, ``key``, ``value``;
    *roots* ``doc_id``, ``root``.  Of entries with one key the last stays.
    """
    paths = ancestor_paths(nodes)
    above = paths.select("doc_id", "node", F.explode(F.concat(F.array("node"), "path")).alias("root")).join(roots, ["doc_id", "root"])
    found = entries.join(above, ["doc_id", "node"])
    return found.groupBy("doc_id", "root", "key").agg(F.max_by("value", F.struct("node", "seq")).alias("value"))


def effective_resources(pages: DataFrame, resources: DataFrame) -> DataFrame:
    """Resources that a page sees: its own, else those of the nearest node of the page tree that has the name.

    *pages* has ``doc_id``, ``node``, ``parent``; *resources* ``doc_id``, ``node``, ``family``, ``name``, ``object``.
    """
    # paths pack well, so that the bytes of many are no reason for a task of its own
    paths = ancestor_paths(pages).repartition(tasks_for(pages, PATHS_A_TASK))
    scopes = paths.select("doc_id", "node", F.posexplode(F.concat(F.array("node"), "path")).alias("scope", "_at"))
    rows = scopes.join(resources.withColumnRenamed("node", "_at"), ["doc_id", "_at"])
    return rows.groupBy("doc_id", "node", "family", "name").agg(F.min_by("object", "scope").alias("object"), F.min("scope").alias("scope"))
