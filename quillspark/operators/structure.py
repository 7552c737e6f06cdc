"""Structure trees from one pass: nodes, children, marked content, references, artifacts and warnings; attributes by layers.

Structure elements are rows with a nested value (VARIANT, see ``sources.documents``).  One pass over them writes
tagged rows, a folder for each tag, and every table is a read of its own folder: five tables and their
warnings cost one scan of the elements.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quillspark.functions import nested
from quillspark.operators.hierarchy import inherited
from quillspark.shared import scratch_path

MAX_KIDS = 65_536
_ROW = "struct<tag:string,ord:int,parent:bigint,role:string,page:bigint,target:bigint,mcid:bigint,message:string>"


@dataclass(frozen=True)
class StructureTables:
    """``doc_id``, ``node`` and of *nodes* ``parent``, ``role``, ``page``; of the others what their names say, with ``ord`` among the kids."""

    nodes: DataFrame
    children: DataFrame
    content: DataFrame
    references: DataFrame
    artifacts: DataFrame
    warnings: DataFrame
    #: Rows by tag, counted while they were written.
    metrics: dict[str, int]


def _target(value: Column) -> Column:
    return F.regexp_extract(F.try_variant_get(value, "$", "string"), r"^(\d+) \d+ R$", 1).try_cast("bigint")


def _row(tag: str, ord_: Column | None = None, **fields: Column) -> Column:
    given = {"tag": F.lit(tag), "ord": ord_, **fields}
    types = [f.split(":") for f in _ROW[len("struct<") : -1].split(",")]
    return F.struct(*[(F.lit(None) if given.get(name) is None else given[name]).cast(kind).alias(name) for name, kind in types])


def tagged_rows(elements: DataFrame, most_kids: int = MAX_KIDS) -> DataFrame:
    """``doc_id``, ``node`` and the tagged rows of each of *elements* (``doc_id``, ``node``, ``value``).

    A kid is a number (marked content on the element's page), a reference (a child), a dictionary of type MCR
    (marked content, on its own page if it names one) or OBJR (a reference to an object).  Anything else, a
    content number that is negative or absent and an OBJR without an object are warned of and leave no row; so are
    elements without a role, and kids beyond *most_kids*, which go.  A value that is no dictionary is a warning alone.
    """
    value = F.col("value")
    at = lambda *keys, kind="variant": nested.at(value, *keys, kind=kind)
    role, page = F.regexp_extract(at("S", kind="string"), "^/(.+)$", 1), _target(at("Pg"))
    kids = F.coalesce(nested.at(value, "K", kind="array<variant>"), F.when(at("K").isNotNull(), F.array(at("K"))), F.array().cast("array<variant>"))

    def kid(k: Column, i: Column) -> Column:
        inner = lambda key, kind: nested.at(k, key, kind=kind)
        kind = inner("Type", "string")
        plain = nested.whole_number(k)
        mcid = F.when(kind == "/MCR", nested.whole_number(k, "MCID")).otherwise(plain)
        content_page = F.coalesce(_target(nested.at(k, "Pg")), page)
        object_ = _target(nested.at(k, "Obj"))
        return (
            F.when(mcid >= 0, _row("content", i, mcid=mcid, page=content_page))
            .when((kind == "/OBJR") & object_.isNotNull(), _row("reference", i, target=object_, page=content_page))
            .when(kind.isNull() & _target(k).isNotNull(), _row("child", i, target=_target(k)))
            .otherwise(_row("warning", i, message=F.when((kind == "/MCR") | plain.isNotNull(), "bad content number").when(kind == "/OBJR", "reference without an object").otherwise("unknown kid")))
        )

    own = F.array(
        _row("node", parent=_target(at("P")), role=F.nullif(role, F.lit("")), page=page),
        F.when(role == "Artifact", _row("artifact", role=role, page=page)),
        F.when(F.coalesce(role, F.lit("")) == "", _row("warning", message=F.lit("missing role"))),
        F.when(F.size(kids) > most_kids, _row("warning", message=F.lit("kid cap reached"))),
    )
    rows = F.when(nested.entries_of(value).isNotNull(), F.concat(F.filter(own, lambda r: r.isNotNull()), F.transform(F.slice(kids, 1, most_kids), kid))).otherwise(F.array(_row("warning", message=F.lit("not a dictionary"))))
    return elements.select("doc_id", "node", F.explode(rows).alias("r")).select("doc_id", "node", "r.*")


def structure_tables(elements: DataFrame, most_kids: int = MAX_KIDS) -> StructureTables:
    """The tables of :func:`tagged_rows`, from one job that scans *elements* once."""
    spark, tags = elements.sparkSession, ("node", "child", "content", "reference", "artifact", "warning")
    counts = Observation()
    rows = tagged_rows(elements, most_kids)
    observed = rows.observe(counts, *[F.count_if(F.col("tag") == t).alias(t) for t in tags])
    path = scratch_path(spark, "structure")
    observed.write.partitionBy("tag").parquet(path)
    made = spark.read.schema(rows.schema).parquet(path)
    of = lambda tag, *columns: made.filter(F.col("tag") == tag).select("doc_id", "node", *columns)
    return StructureTables(of("node", "parent", "role", "page"), of("child", "ord", "target"), of("content", "ord", "page", "mcid"), of("reference", "ord", "page", "target"), of("artifact", "page", "role"), of("warning", "ord", "message"), dict(counts.get))


def paged_content(tables: StructureTables) -> DataFrame:
    """Marked content with its page: its own, its element's, or that of the nearest element above that has one."""
    pages = inherited(tables.nodes, "page", "_page").select("doc_id", "node", "_page")
    return tables.content.join(pages, ["doc_id", "node"], "left").select("doc_id", "node", "ord", F.coalesce("page", "_page").alias("page"), "mcid")


def layered_attributes(elements: DataFrame, class_map: DataFrame) -> DataFrame:
    """``doc_id``, ``node``, ``name``, ``value``, ``layer``: attributes of elements, their own before those of their classes.

    *elements* has ``doc_id``, ``node``, ``attributes`` (a map) and ``classes`` (names in order); *class_map* ``doc_id``, ``class``,
    ``attributes``.  Of the classes a later one overrides an earlier one; ``layer`` is the class's place from 0, or
    the number of classes for an own attribute.  A class that is named twice counts at its last place; of
    several definitions of a class, or rows of an element, the larger value stands.  Null maps, lists and values are
    nothing.  Layers are merged by a partial aggregation, so a class that a third of all elements
    name is sent to none of them twice.
    """
    own = elements.select("doc_id", "node", F.size(F.coalesce("classes", F.array().cast("array<string>"))).alias("layer"), F.explode("attributes").alias("name", "value"))
    named = elements.select("doc_id", "node", F.posexplode("classes").alias("layer", "class"))
    defined = class_map.select("doc_id", "class", F.explode("attributes").alias("name", "value"))
    of_classes = named.join(defined, ["doc_id", "class"]).select("doc_id", "node", "layer", "name", "value")
    best = own.unionByName(of_classes).filter("value IS NOT NULL").groupBy("doc_id", "node", "name").agg(F.max(F.struct("layer", "value")).alias("b"))
    return best.select("doc_id", "node", "name", "b.value", "b.layer")


def unresolved_classes(elements: DataFrame, class_map: DataFrame) -> DataFrame:
    """``doc_id``, ``node``, ``class``: names that no class of the document has."""
    named = elements.select("doc_id", "node", F.explode("classes").alias("class")).filter("class IS NOT NULL").distinct()
    return named.join(class_map.select("doc_id", "class"), ["doc_id", "class"], "left_anti").select("doc_id", "node", "class")


def signature_nodes(tables: StructureTables, objects: DataFrame) -> DataFrame:
    """``doc_id``, ``node``: Form elements that refer to a signature field, an object whose own FT is Sig."""
    fields = objects.filter(nested.at(F.col("value"), "FT", kind="string") == "/Sig").select("doc_id", F.col("number").alias("target"))
    named = tables.references.join(fields, ["doc_id", "target"], "left_semi").select("doc_id", "node").distinct()
    return tables.nodes.filter("role = 'Form'").join(named, ["doc_id", "node"], "left_semi").select("doc_id", "node")
