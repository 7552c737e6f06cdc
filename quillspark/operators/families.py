"""Typed model objects and their links from object rows (see ``sources.documents``).

Every family comes from one pass over the objects: the family, keys and links of a dictionary are
expressions over its nested value, so a filter on families prunes what isn't asked for.  Links are rows
``doc_id``, ``src``, ``src_family``, ``link``, ``ord``, ``dst``; a target is looked up by an equi-join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import nested
from quillspark.operators import model
from quillspark.operators.model import lookup
from quillspark.sources.documents import decoded_stream

# Families by Type and Subtype beyond those of ``model``, and the links of each family by key.
MORE_TYPES = {"Catalog": "catalog", "Page": "page", "Outlines": "outline", "FontDescriptor": "fontDescriptor", "ExtGState": "extGState", "Encoding": "encoding", "XRef": "xrefStream", "ObjStm": "objectStream"}
ANNOTATION_SUBTYPES = ("Text", "Link", "FreeText", "Line", "Square", "Circle", "Polygon", "PolyLine", "Highlight", "Underline", "Squiggly", "StrikeOut", "Stamp", "Caret", "Ink", "Popup", "FileAttachment", "Sound", "Movie", "Screen", "PrinterMark", "TrapNet", "Watermark", "3D", "Redact")
ACTION_KEYS = ("A", "AA", "OpenAction")
LINKS: dict[str, tuple[tuple[str, str], ...]] = {
    "catalog": (("Metadata", "metadata"), ("OutputIntents", "outputIntent"), ("Pages", "pageTree"), ("Outlines", "outline"), ("AcroForm", "acroForm"), ("StructTreeRoot", "structureTreeRoot"), ("OpenAction", "action"), ("AA", "action"), ("Names", "names")),
    "pageTree": (("Kids", "page"),),
    "page": (("Contents", "contentStream"), ("Annots", "annotation"), ("AA", "action"), ("Metadata", "metadata")),
    "annotation": (("A", "action"), ("AA", "action"), ("FS", "fileSpec"), ("Popup", "annotation")),
    "formField": (("Kids", "formField"), ("Parent", "formField"), ("A", "action"), ("AA", "action"), ("F", "fileSpec")),
    "acroForm": (("Fields", "formField"),),
    "outline": (("First", "outline"), ("Last", "outline"), ("Next", "outline"), ("Prev", "outline"), ("A", "action"), ("Dest", "destination")),
    "action": (("Next", "action"), ("F", "fileSpec"), ("FS", "fileSpec"), ("D", "destination")),
    "font": (("DescendantFonts", "font"), ("FontDescriptor", "fontDescriptor"), ("ToUnicode", "cMap"), ("Encoding", "encoding")),
    "fontDescriptor": (("FontFile", "fontProgram"), ("FontFile2", "fontProgram"), ("FontFile3", "fontProgram"), ("CIDSet", "cidSet")),
    "outputIntent": (("DestOutputProfile", "iccProfile"),),
    "structureTreeRoot": (("K", "structureElement"), ("ParentTree", "numberTree"), ("IDTree", "nameTree"), ("RoleMap", "roleMap"), ("ClassMap", "classMap")),
    "structureElement": (("K", "structureElement"), ("P", "structureElement"), ("A", "attributes"), ("C", "classes")),
    "formXObject": (("Metadata", "metadata"), ("OPI", "opi")),
    "image": (("SMask", "image"), ("Mask", "image"), ("Metadata", "metadata")),
}

ACTIONS = ("GoTo", "GoToR", "GoToE", "URI", "Launch", "Named", "JavaScript", "SubmitForm", "ResetForm", "ImportData", "Thread", "Sound", "Movie", "Hide", "SetOCGState", "Rendition", "Trans", "GoTo3DView")


def text_at(*keys: str | int) -> Column:
    """The value at nested keys of a row as text (``/Name``, ``7 0 R``, ``(text)``, ``42``); null where it is absent."""
    return nested.at(F.col("value"), *keys, kind="string")


def _target(text: Column) -> Column:
    return F.regexp_extract(text, r"^(\d+) \d+ R$", 1).try_cast("bigint")


def typed(objects: DataFrame) -> DataFrame:
    """Object rows with ``keys`` and ``family``; the family is null where none fits."""
    named = F.coalesce(lookup(MORE_TYPES, F.col("type")), lookup(model.FAMILY_BY_SUBTYPE, F.col("subtype")), lookup(model.FAMILY_BY_TYPE, F.col("type")))
    is_open = F.col("kind").isin("dictionary", "stream")

    def unnamed(keys: Column, action: Column) -> Column:
        has = lambda *names: F.arrays_overlap(keys, F.array(*map(F.lit, names)))
        by_keys = model.family(F.lit(None).cast("string"), F.lit(None).cast("string"), F.coalesce(keys, F.array().cast("array<string>")))
        by_shape = (
            F.when(F.col("subtype").isin(*ANNOTATION_SUBTYPES) & has("Rect"), "annotation")
            .when(has("Title") & has("Parent") & has("First", "Next", "Prev", "Dest", "A"), "outline")
            .when(action.isin(*[f"/{a}" for a in ACTIONS]), "action")
        )
        return F.coalesce(by_keys, by_shape)

    # only what no name decides is opened, once; its value is read where it is asked, so that no other row's is
    value = F.try_parse_json("json") if "json" in objects.columns else F.col("value")
    opened = F.transform(F.array(value), lambda v: F.struct(F.when(is_open, nested.own_keys(v)).alias("keys"), nested.at(v, "S", kind="string").alias("action")))
    rows = objects.withColumn("keys", F.when(is_open, nested.own_keys(F.col("value"))))
    return rows.withColumn("family", F.coalesce(named, F.get(F.transform(opened, lambda o: unnamed(o["keys"], o["action"])), F.lit(0))))


def _under(key: Column, value: Column) -> Column:
    """The references in a *value* that stands at *key*, as structs (link, dst): the value itself, or an array's or dictionary's own members."""
    found = F.transform(nested.members(value), lambda v: _target(F.try_variant_get(v, "$", "string")))
    return F.transform(F.filter(found, lambda x: x.isNotNull()), lambda x: F.struct(key.alias("link"), x.alias("dst")))


def typed_links(objects: DataFrame, families: Sequence[str] | None = None) -> DataFrame:
    """``doc_id``, ``src``, ``src_family``, ``link``, ``ord``, ``dst``: references of typed rows under the keys of their family.

    A key's value may be a reference, an array of them or a dictionary whose entries hold them (additional
    actions); ``ord`` counts through a row's links in order of the family's keys.  Only *families* are looked
    at, all by default.
    """
    asked = {name: own for name, own in LINKS.items() if families is None or name in families}
    keys = F.lit(None).cast("array<string>")
    for name, own in asked.items():
        keys = F.when(F.col("family") == name, F.array(*[F.lit(key) for key, _ in own])).otherwise(keys)
    # a dictionary is opened once, and only keys that it has are looked into
    rows = objects.filter(F.col("family").isin(*asked)).select("doc_id", F.col("number").alias("src"), F.col("family").alias("src_family"), keys.alias("_keys"), nested.entries_of(F.col("value")).alias("_own"))
    made = F.transform(F.filter("_keys", lambda key: F.map_contains_key("_own", key)), lambda key: _under(key, F.element_at("_own", key)))
    rows = rows.select("doc_id", "src", "src_family", F.posexplode(F.flatten(F.filter(made, lambda x: x.isNotNull()))).alias("ord", "l"))
    return rows.select("doc_id", "src", "src_family", "l.link", "ord", "l.dst")


def link_schema(spark) -> DataFrame:
    """``family``, ``link``, ``target``: which family a link leads to."""
    return spark.createDataFrame([(f, k, t) for f, own in LINKS.items() for k, t in own], "family string, link string, target string")


def linked_objects(objects: DataFrame, links: DataFrame) -> DataFrame:
    """Links with the target's own family (null for a reference to nothing) and the one the schema expects."""
    schema = F.create_map(*[F.lit(x) for f, own in LINKS.items() for k, t in own for x in (f"{f}.{k}", t)])
    targets = objects.select("doc_id", F.col("number").alias("dst"), F.col("family").alias("dst_family"), F.lit(True).alias("found"))
    rows = links.join(targets, ["doc_id", "dst"], "left")
    return rows.withColumn("target", F.element_at(schema, F.concat_ws(".", "src_family", "link"))).withColumn("found", F.coalesce("found", F.lit(False)))


def _led_to(objects: DataFrame, rows: DataFrame, number: str, how: str = "inner") -> DataFrame:
    """*rows* with ``_led``, the value of the object of their document that *number* names; values are read from their JSON behind the join, for those alone."""
    source = "json" if "json" in objects.columns else "value"
    there = objects.select("doc_id", F.col("number").alias(number), F.col(source).alias("_source"))
    # objects pack well: by the bytes of their table Spark would send every task millions of them
    found = rows.join(there.hint("merge") if how == "left" else there, ["doc_id", number], how)
    return found.withColumn("_led", F.try_parse_json("_source") if source == "json" else F.col("_source")).drop("_source")


def pages(objects: DataFrame) -> DataFrame:
    """``doc_id``, ``node``, ``parent`` of the page tree's nodes (``leaf`` for a page), for the operators on hierarchies."""
    return objects.filter(F.col("family").isin("page", "pageTree")).select("doc_id", F.col("number").alias("node"), _target(text_at("Parent")).alias("parent"), (F.col("family") == "page").alias("leaf"))


def inherited_values(objects: DataFrame, key: str) -> DataFrame:
    """``doc_id``, ``node``, ``value``: of each page the text at *key*, else the nearest one up its parents."""
    own = objects.filter(F.col("family").isin("page", "pageTree")).select("doc_id", F.col("number").alias("node"), F.lit("v").alias("family"), F.lit(key).alias("name"), text_at(key).alias("object")).filter("object IS NOT NULL")
    tree = pages(objects)
    found = model.effective_resources(tree.drop("leaf"), own)
    return found.join(tree.filter("leaf").select("doc_id", "node"), ["doc_id", "node"], "left_semi").select("doc_id", "node", F.col("object").alias("value"))


def page_fonts(objects: DataFrame) -> DataFrame:
    """``doc_id``, ``node``, ``name``, ``object``: fonts that a page sees by name, its own before those of its parents.

    Resources stand in the page (or page tree) itself or in a dictionary of their own that it refers to.
    """
    nodes = objects.filter(F.col("family").isin("page", "pageTree"))
    inline = nodes.select("doc_id", F.col("number").alias("node"), F.explode(nested.at(F.col("value"), "Resources", "Font", kind="map<string,string>")).alias("name", "f"))
    refers = nodes.select("doc_id", F.col("number").alias("node"), _target(text_at("Resources")).alias("number")).filter("number IS NOT NULL")
    apart = _led_to(objects, refers, "number").select("doc_id", "node", F.explode(nested.at(F.col("_led"), "Font", kind="map<string,string>")).alias("name", "f"))
    found = inline.unionByName(apart).select("doc_id", "node", F.lit("font").alias("family"), "name", _target(F.col("f")).alias("object")).filter("object IS NOT NULL")
    tree = pages(objects)
    seen = model.effective_resources(tree.drop("leaf"), found)
    return seen.join(tree.filter("leaf").select("doc_id", "node"), ["doc_id", "node"], "left_semi").select("doc_id", "node", "name", "object")


def structure_destinations(objects: DataFrame) -> DataFrame:
    """Actions and outline items whose destination's first element is a structure element: ``doc_id``, ``number``."""
    first = lambda key: F.coalesce(nested.at(F.col("value"), key, 0, kind="string"), text_at(key))
    target = _target(F.coalesce(first("SD"), first("D"), first("Dest")))
    named = objects.filter(F.col("family").isin("action", "outline")).select("doc_id", "number", target.alias("target"))
    elements = objects.filter("family = 'structureElement'").select("doc_id", F.col("number").alias("target"))
    return named.join(elements, ["doc_id", "target"], "left_semi").select("doc_id", "number")


def appearance_types(objects: DataFrame) -> DataFrame:
    """``doc_id``, ``number``, ``appearance`` of annotations: Stream, Dictionary, Missing, Other, or null without a normal appearance."""
    is_dictionary = nested.at(F.col("value"), "AP", "N", kind="map<string,variant>").isNotNull()
    notes = objects.filter(F.col("family").isin("annotation", "formField")).select("doc_id", "number", F.when(is_dictionary, "<<").otherwise(text_at("AP", "N")).alias("n"))
    notes = notes.withColumn("target", _target(F.col("n")))
    targets = objects.select("doc_id", F.col("number").alias("target"), F.col("kind").alias("target_kind"))
    rows = notes.join(targets, ["doc_id", "target"], "left")
    by_target = F.when(F.col("target_kind").isNull(), "Missing").when(F.col("target_kind") == "stream", "Stream").when(F.col("target_kind") == "dictionary", "Dictionary").otherwise("Other")
    kind = F.when(F.col("n").isNull(), F.lit(None)).when(F.col("target").isNotNull(), by_target).when(F.col("n") == "<<", "Dictionary").otherwise("Other")
    return rows.select("doc_id", "number", kind.alias("appearance"))


def embedded_members(entries: DataFrame, files: DataFrame) -> DataFrame:
    """File specifications that the embedded-files tree names: *files* (``doc_id``, ``number``) found among *entries* (``doc_id``, ``value``)."""
    named = entries.select("doc_id", F.regexp_extract("value", r"(\d+)\s+\d+\s+R", 1).try_cast("bigint").alias("number"))
    return files.join(named, ["doc_id", "number"], "left_semi")


def info_values(trailers: DataFrame, objects: DataFrame, key: str) -> DataFrame:
    """``doc_id``, ``value``: the text at *key* in the information dictionary that the last trailer names (``pos``, ``info``)."""
    last = trailers.filter("info IS NOT NULL").groupBy("doc_id").agg(F.max_by("info", "pos").alias("number"))
    return _led_to(objects, last, "number").select("doc_id", nested.at(F.col("_led"), key, kind="string").alias("value"))


def schema_counts(properties: DataFrame, links: DataFrame) -> DataFrame:
    """Per family the number of properties and links, and of properties by kind of evidence (``family``, ``evidence``)."""
    by_evidence = properties.groupBy("family", "evidence").agg(F.count("*").alias("n"))
    counted = by_evidence.groupBy("family").agg(F.sum("n").alias("properties"), F.array_sort(F.collect_list(F.struct("evidence", "n"))).alias("evidence"))
    return counted.join(links.groupBy("family").agg(F.count("*").alias("links")), "family", "full").select("family", F.coalesce("properties", F.lit(0)).alias("properties"), F.coalesce("links", F.lit(0)).alias("links"), "evidence")


def first_visits(links: DataFrame) -> DataFrame:
    """Of links to one target from one source the first in order."""
    nth = F.row_number().over(Window.partitionBy("doc_id", "src", "dst").orderBy("ord"))
    return links.withColumn("_n", nth).filter("_n = 1").drop("_n")


# The categories of resources, and the family that an entry of each leads to.
RESOURCES = {"Font": "font", "XObject": "xObject", "ColorSpace": "colorSpace", "ExtGState": "extGState", "Pattern": "pattern", "Shading": "shading", "Properties": "properties"}


def resource_entries(objects: DataFrame, families: Sequence[str] = ("page", "pageTree", "formXObject", "pattern")) -> DataFrame:
    """``doc_id``, ``src``, ``src_family``, ``category``, ``name``, ``dst``: the resources that objects name themselves.

    Resources, and each category of them, stand in the object or in a dictionary that it refers to; ``dst`` is
    null for an entry that is written out in place.  All categories come from one pass over the owners.
    """
    owners = objects.filter(F.col("family").isin(*families))
    # one row with the value at hand, made once: a filter on it would read the value once more
    own = owners.select("doc_id", F.col("number").alias("src"), F.col("family").alias("src_family"), F.explode(F.filter(F.array(nested.at(F.col("value"), "Resources")), lambda r: r.isNotNull())).alias("r"))

    def opened(rows: DataFrame, column: str, place: Column) -> DataFrame:
        """*rows* whose reference in *column* is replaced by the dictionary that it leads to (null for one to nothing), in one join.

        Rows without a reference look for their *place*, which names no object, so that they don't gather at a null.
        """
        to = _target(F.try_variant_get(column, "$", "string"))
        found = _led_to(objects, rows.withColumn("_to", F.coalesce(to, place)), "_to", "left")
        return found.withColumn(column, F.when(F.col("_to") < 0, F.col(column)).otherwise(F.col("_led"))).drop("_to", "_led")

    place = -1 - F.abs("src")
    each = opened(own, "r", place).select("doc_id", "src", "src_family", F.explode(nested.entries_of(F.col("r"))).alias("category", "c")).filter(F.col("category").isin(*RESOURCES))
    named = opened(each, "c", place).select("doc_id", "src", "src_family", "category", F.explode(nested.entries_of(F.col("c"))).alias("name", "e"))
    return named.select("doc_id", "src", "src_family", "category", "name", _target(F.try_variant_get("e", "$", "string")).alias("dst"))


def page_resources(objects: DataFrame) -> DataFrame:
    """``doc_id``, ``node``, ``category``, ``name``, ``object``: what each page sees, its own before those of its parents in the page tree."""
    found = resource_entries(objects, ("page", "pageTree")).select("doc_id", F.col("src").alias("node"), F.col("category").alias("family"), "name", F.col("dst").alias("object"))
    tree = pages(objects)
    seen = model.effective_resources(tree.drop("leaf"), found.filter("object IS NOT NULL"))
    return seen.join(tree.filter("leaf").select("doc_id", "node"), ["doc_id", "node"], "left_semi").select("doc_id", "node", F.col("family").alias("category"), "name", "object")


def content_streams(objects: DataFrame) -> DataFrame:
    """``doc_id``, ``src``, ``src_family``, ``stream``: pages with each of their content streams, and form XObjects with themselves.

    A form's content sees its own resources only (:func:`resource_entries`), a page's those of the page (:func:`page_resources`).
    """
    streams = objects.filter("kind = 'stream'").select("doc_id", F.col("number").alias("stream"))
    of_pages = typed_links(objects, ["page"]).filter("link = 'Contents'").select("doc_id", "src", "src_family", F.col("dst").alias("stream")).join(streams, ["doc_id", "stream"], "left_semi")
    forms = objects.filter("family = 'formXObject' AND kind = 'stream'").select("doc_id", F.col("number").alias("src"), F.col("family").alias("src_family"), F.col("number").alias("stream"))
    return of_pages.select("doc_id", "src", "src_family", "stream").unionByName(forms)


def font_values(objects: DataFrame, most_bytes: int = 1 << 20) -> DataFrame:
    """``doc_id``, ``number``, ``name``, ``width``, ``to_unicode`` of fonts.

    The name is BaseFont, else the descriptor's FontName, else the first descendant's BaseFont.  The width is DW, else
    the first of Widths, where that is a whole number.  ToUnicode is a string, or the decoded text of the
    stream that it refers to; null where it is absent, can't be decoded or is larger than *most_bytes*.
    """
    plain = lambda text: F.when(text.startswith("/"), F.substring(text, 2, 1000))
    fonts = objects.filter("family = 'font'").select(
        "doc_id", "number", plain(text_at("BaseFont")).alias("own"), _target(text_at("FontDescriptor")).alias("descriptor"), _target(text_at("DescendantFonts", 0)).alias("descendant"), F.coalesce(nested.whole_number(F.col("value"), "DW"), nested.whole_number(F.col("value"), "Widths", 0)).alias("width"), text_at("ToUnicode").alias("u")
    ).withColumn("map", _target(F.col("u")))
    descriptors = objects.filter("family = 'fontDescriptor'").select("doc_id", F.col("number").alias("descriptor"), plain(text_at("FontName")).alias("described"))
    below = objects.filter("family = 'font'").select("doc_id", F.col("number").alias("descendant"), plain(text_at("BaseFont")).alias("inner"))
    maps = objects.filter("kind = 'stream'").join(fonts.select("doc_id", F.col("map").alias("number")).distinct(), ["doc_id", "number"], "left_semi")
    maps = maps.select("doc_id", F.col("number").alias("map"), decoded_stream().getField("bytes").alias("bytes"))
    rows = fonts.join(descriptors, ["doc_id", "descriptor"], "left").join(below, ["doc_id", "descendant"], "left").join(maps, ["doc_id", "map"], "left")
    text = F.when(F.col("map").isNotNull(), F.when(F.octet_length("bytes") <= most_bytes, F.decode("bytes", "ISO-8859-1"))).when(F.col("u").startswith("(") & (F.octet_length("u") - 2 <= most_bytes), F.substring("u", 2, F.length("u") - 2))
    return rows.select("doc_id", "number", F.coalesce("own", "described", "inner").alias("name"), "width", text.alias("to_unicode"))


def tint_signatures(objects: DataFrame) -> DataFrame:
    """``doc_id``, ``number``, ``alternate``, ``tint``: stable texts of the Alternate and TintTransform of colour spaces, for ``joins.tint_consistency``."""
    stable = lambda key: F.to_json(nested.at(F.col("value"), key))
    return objects.filter(nested.at(F.col("value"), "TintTransform").isNotNull()).select("doc_id", "number", stable("Alternate").alias("alternate"), stable("TintTransform").alias("tint"))


def same_output_profile(objects: DataFrame) -> DataFrame:
    """``doc_id``, ``same``: whether the output intents of a document that name a profile all refer to one; null where one isn't a reference to a stream."""
    intents = objects.filter("family = 'outputIntent'").select("doc_id", text_at("DestOutputProfile").alias("p")).filter("p IS NOT NULL").withColumn("dst", _target(F.col("p")))
    streams = objects.filter("kind = 'stream'").select("doc_id", F.col("number").alias("dst"), F.lit(True).alias("found"))
    judged = intents.join(streams, ["doc_id", "dst"], "left").groupBy("doc_id").agg((F.min("dst") == F.max("dst")).alias("one"), F.bool_and(F.coalesce("found", F.lit(False))).alias("all"))
    return objects.select("doc_id").distinct().join(judged, "doc_id", "left").select("doc_id", F.when(F.col("one").isNull() & F.col("all").isNull(), True).when(F.col("all"), F.col("one")).alias("same"))


def indirect_models(objects: DataFrame, handled: Sequence[str] = ("catalog", "page", "metadata", "annotation", "outputIntent", "font")) -> DataFrame:
    """``doc_id``, ``number``, ``family``: classified dictionaries that no traversal of their own handles."""
    return objects.filter(F.col("family").isNotNull() & ~F.col("family").isin(*handled)).select("doc_id", "number", "family")


# Keys of the catalog that lead to models without links of their own.
CATALOG_MODELS = ("AcroForm", "StructTreeRoot", "OCProperties", "Names", "Outlines", "Perms", "Dests")


def catalog_models(objects: DataFrame) -> DataFrame:
    """``doc_id``, ``src``, ``key``, ``dst``: the catalog's dictionaries of its own, in place (null ``dst``) or by reference."""
    found = F.array(*[F.struct(F.lit(key).alias("key"), nested.at(F.col("value"), key).alias("v")) for key in CATALOG_MODELS])
    rows = objects.filter("family = 'catalog'").select("doc_id", F.col("number").alias("src"), F.explode(found).alias("e")).select("doc_id", "src", "e.key", _target(F.try_variant_get("e.v", "$", "string")).alias("dst"), nested.entries_of(F.col("e.v")).isNotNull().alias("here"))
    return rows.filter(F.coalesce("here", F.lit(False)) | F.col("dst").isNotNull()).select("doc_id", "src", "key", "dst")
