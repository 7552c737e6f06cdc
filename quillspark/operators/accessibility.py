"""Structure trees: marked content to nodes, owners, table headers, links, artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.hierarchy import ancestor_roles
from quillspark.operators.joins import last_owner, priority_join


def content_nodes(marked: DataFrame, explicit: DataFrame, by_page: DataFrame, by_key: DataFrame) -> DataFrame:
    """The structure node of each marked content: an explicit item, else the page's parent tree, else a key of its own.

    *marked* has ``doc_id``, ``page``, ``mcid``, ``struct_key``; each table gives ``node`` for its key.
    """
    return priority_join(marked, [(explicit, ["doc_id", "page", "mcid"]), (by_page, ["doc_id", "page", "mcid"]), (by_key, ["doc_id", "struct_key", "mcid"])], "node", "node")


def owned_objects(associations: DataFrame, owners: DataFrame) -> DataFrame:
    """Parent-tree values with the last owner of their number in page order."""
    best = last_owner(owners, ["doc_id", "struct_parent"], ["seq"], "owner")
    return associations.join(best, ["doc_id", "struct_parent"], "left")


def header_cells(cells: DataFrame) -> DataFrame:
    """``connected`` and ``unknown_headers`` of each cell.

    *cells* has ``doc_id``, ``table_id``, ``node``, ``role``, ``id``, ``scope`` and ``headers`` (array).  TH
    is connected; a TD by a header id that some TH has, or by a TH with a scope in its table.  Unknown are
    the ids of a TD that no TH has, sorted and joined; ``missing`` where it has neither ids nor a scoped TH.
    """
    heads = cells.filter(F.col("role").isin("TH", "THead"))
    ids = heads.filter(F.col("id").isNotNull()).select("doc_id", F.col("id").alias("_header"), F.lit(True).alias("_known")).distinct()
    wanted = cells.filter("role = 'TD'").select("doc_id", "node", F.explode("headers").alias("_header")).join(ids, ["doc_id", "_header"], "left")
    named = wanted.groupBy("doc_id", "node").agg(
        F.count_if(F.col("_known")).alias("_hits"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("_known").isNull(), F.col("_header")))), ",").alias("_lost")
    )
    scoped = heads.filter(F.col("scope").isNotNull()).select("doc_id", "table_id", F.lit(True).alias("_scoped")).distinct()
    rows = cells.join(named, ["doc_id", "node"], "left").join(scoped, ["doc_id", "table_id"], "left")
    cell, has_scope = F.col("role") == "TD", F.coalesce("_scoped", F.lit(False))
    connected = F.when(F.col("role").isin("TH", "THead"), True).when(cell, (F.coalesce("_hits", F.lit(0)) > 0) | has_scope).otherwise(False)
    unknown = F.when(~cell, "").when(F.coalesce("_lost", F.lit("")) != "", F.col("_lost")).when(F.col("_hits").isNull() & ~has_scope, "missing").otherwise("")
    return rows.select("doc_id", "table_id", "node", connected.alias("connected"), unknown.alias("unknown_headers"))


def misplaced_links(annotations: DataFrame, nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Link annotations with a structure node that neither is a Link element nor stands under one."""
    roles = ancestor_roles(nodes, paths).join(nodes.select("doc_id", "node", "role"), ["doc_id", "node"])
    inside = roles.filter((F.col("role") == "Link") | F.array_contains("roles", "Link")).select("doc_id", "node")
    return annotations.filter("subtype = 'Link' AND node IS NOT NULL").join(inside, ["doc_id", "node"], "left_anti")


def distinct_artifacts(from_nodes: DataFrame, from_content: DataFrame) -> DataFrame:
    """Artifacts by node, page and tag; those of nodes come before those of marked content."""
    both = from_nodes.withColumn("_source", F.lit(0)).unionByName(from_content.withColumn("_source", F.lit(1)))
    return both.groupBy("doc_id", "node", "page", "tag").agg(F.min("_source").alias("source"))


def widget_counts(references: DataFrame, annotations: DataFrame) -> DataFrame:
    """Widgets among the objects that each node refers to."""
    kinds = annotations.select("doc_id", F.col("object").alias("target"), "subtype")
    return references.join(kinds, ["doc_id", "target"], "left").groupBy("doc_id", "node").agg(F.count_if(F.col("subtype") == "Widget").alias("widgets"))
