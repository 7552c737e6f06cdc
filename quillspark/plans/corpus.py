"""Queries over documents that Spark writes from the driver's tables, and over claims, clusters and repairs of those tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import checked, derived
from quillspark.operators import accessibility, families, metadata, model, profiles, reports, rules
from quillspark.plans.registry import query, table
from quillspark.shared import materialise, spread
from quillspark.sources import documents

#: Rows of a table that one task makes files of.
FILES_A_TASK = 2000

# Documents: one file for each row of ``part``, made of its columns.

#: Objects that every file has; the catalog and the tree node hold inner keys and strings that must not count as their own.
_FIXED = {
    1: "<< /Inner << /Type /Page /Pages 99 0 R >> /Type /Catalog /Pages 2 0 R /Outlines 22 0 R /AcroForm 24 0 R /OpenAction 27 0 R >>",
    7: "<< /Type /Annot /Subtype /Link /Rect [0 0 1 1] /A 27 0 R /AP << /N 5 0 R >> >>",
    8: "<< /Type /Annot /Subtype /Widget /Rect [0 0 1 1] /Parent 25 0 R /AP << /N << /On 5 0 R >> >> >>",
    9: "<< /XObject << /Font 7 0 R >> /Font << /F1 12 0 R >> >>",
    10: "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
    12: "<< /Type /Font /Subtype /TrueType /FontDescriptor 14 0 R >>",
    14: "<< /Type /FontDescriptor /FontFile2 5 0 R >>",
    22: "<< /Type /Outlines /First 23 0 R /Last 23 0 R >>",
    23: "<< /Title (a /Parent 9 0 R \\) b) /Parent 22 0 R /Dest [30 0 R /Fit] /A 28 0 R >>",
    24: "<< /Fields [25 0 R] >>",
    25: "<< /Type /Annot /Subtype /Widget /Kids [8 0 R] /T (f) >>",
    27: "<< /S /GoTo /D [100 0 R /Fit] /Next 28 0 R >>",
    28: "<< /S /URI /URI (http://a) >>",
    30: "<< /Type /StructElem /S /P /P 31 0 R >>",
    31: "<< /Type /StructTreeRoot /K [30 0 R] >>",
}


def _hex(text: Column) -> Column:
    """ASCIIHex data of a text."""
    return F.concat(F.hex(F.encode(text, "ISO-8859-1")), F.lit(">"))


def _stream(entries: str, data: Column, length: Column | None = None) -> Column:
    return F.concat(F.lit(f"<< {entries} /Length "), (F.length(data) if length is None else length).cast("string"), F.lit(" >>\nstream\n"), data, F.lit("\nendstream"))


def _files(spark, sf_dir: str) -> DataFrame:
    """A file for each part: pages by size, titles by name, and by its key files that are broken, encrypted, packed or nested too deeply."""
    k = F.col("p_partkey")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    every = lambda n, some: F.when(k % n == 0, some).otherwise(F.lit(""))
    whole = lambda number, body: text(f"{number} 0 obj\n" if isinstance(number, int) else text(number, " 0 obj\n"), body, "\nendobj\n")
    pages = F.sequence(F.lit(0).cast("bigint"), F.col("p_size").cast("bigint") % 3)
    kids = F.array_join(F.transform(pages, lambda i: text(i + 100, " 0 R")), " ")
    tree = text("<< /Note (<< /Rotate 7 >>) /Type /Pages /Kids [", kids, "] /Rotate ", F.col("p_size"), " /Resources << /Font << /F1 10 0 R /F2 12 0 R >> >> >>")
    page = lambda i: whole(i + 100, text("<< /Group << /Type /Group >> /Type /Page /Parent 2 0 R /Contents [5 0 R 6 0 R] /Annots [7 0 R 8 0 R 99 0 R] ", F.when(i % 2 == 1, text("/Rotate ", i * 90, " /Resources 9 0 R")).otherwise(F.lit("/AA << /O 27 0 R /C << /D 28 0 R >> >>")), " >>"))
    packed = text("50 0 51 ", F.length(text("<< /Type /Part /Size ", F.col("p_size"), " >> ")))
    first = text(packed, " " * 12)
    content = text(first, "<< /Type /Part /Size ", F.col("p_size"), " >> ", "[", k, "]")
    object_stream = text("<< /Type /ObjStm /N 2 /First ", F.length(first), " /Filter /AHx /Length ", F.length(_hex(content)), " >>\nstream\n", _hex(content), "\nendstream")
    cross = F.concat(F.repeat(F.lit("01000900"), F.col("p_size").cast("int")), F.lit("02000201>"))
    cross_stream = text("<< /Type /XRef /W [1 2 1] /Root 1 0 R /Inner << /Size 99999 >> /Size ", F.col("p_size") + 1, " /Filter /ASCIIHexDecode /Length ", F.length(cross), " >>\nstream\n", cross, "\nendstream")
    table_ = F.when(k % 3 == 0, text("xref\n0 1\n0000000000 65535 f \ntrailer\n<< /X << /Root 9 0 R >> /Prev ", k, " /Root 1 0 R >>\n")).when(k % 3 == 1, text("xref\n0 1\n0 f\ntrailer\n<< /XRefStm ", k, " /Root 1 0 R >>\n")).otherwise(F.lit(""))
    root = F.when(k % 19 == 0, "77").otherwise("1")
    made = text(
        every(11, F.lit("junk\n")), F.when(k % 13 == 0, "no header\n").otherwise(text("%PDF-1.", k % 8, "\n")),
        *[whole(n, F.lit(body)) for n, body in _FIXED.items()], whole(2, tree), F.array_join(F.transform(pages, page), ""),
        whole(5, _stream("/A (endobj \\) (stream) x)", F.col("p_type"), F.when(k % 5 == 0, 1).otherwise(F.length("p_type")))), whole(6, _stream("/Filter [/AHx]", _hex(F.col("p_name")))), whole(16, _stream("/Filter /DCTDecode", F.lit("jpeg"))), whole(17, _stream("/Filter /Unknown", F.lit("x"))),
        whole(40, text("<< /Producer << /Title (inner) >> /Title (", F.col("p_name"), ") >>")), every(2, whole(60, object_stream)), every(4, whole(61, cross_stream)), every(17, whole(70, F.repeat(F.lit("["), documents.MAX_LEVELS + 1))),
        table_, "trailer\n<< /Old << /Root 3 0 R >> /Info 40 0 R ", every(7, F.lit("/Encrypt 3 0 R ")), "/Root ", root, " 0 R >>\nstartxref\n0\n%%EOF\n", F.repeat(F.lit("z"), (k % 6).cast("int")),
    )
    content_ = F.encode(made, "ISO-8859-1")
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size"), FILES_A_TASK)
    return part.select(k.cast("string").alias("doc_id"), F.octet_length(content_).cast("bigint").alias("bytes"), content_.alias("content"), F.lit(False).alias("too_large"))


def _model(spark, sf_dir: str) -> DataFrame:
    return _written(_files(spark, sf_dir))


#: What the operators on typed objects ask of them, beside a stream's own bytes.
_ASKED = ["doc_id", "number", "kind", "json", "family"]


def _written(files: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """The typed objects of *files*, written once: links, trees and targets would each scan the files again.

    Values are written as JSON and read from it for the rows that a query asks of; a filter on families reaches the
    table's scan.  The table has the columns that operators ask, and *more*.
    """
    rows = families.typed(documents.objects(files)).select(*_ASKED, *more)
    return materialise(rows, "files-objects").withColumn("value", F.try_parse_json("json"))


#: The parts whose files can be read, their pages, and rows that each of them has.
_READ = "r AS (SELECT *, CAST(p_partkey AS VARCHAR) AS doc_id FROM part WHERE p_partkey % 17 <> 0), pages AS (SELECT r.*, i FROM r, range(0, 3) t(i) WHERE i <= p_size % 3)"


@query("SELECT CAST(p_partkey AS VARCHAR) AS doc_id, CASE WHEN p_partkey % 17 = 0 THEN 'internal' WHEN p_partkey % 13 = 0 THEN 'parseFailed' WHEN p_partkey % 7 = 0 THEN 'encrypted' WHEN p_partkey % 19 = 0 THEN 'parseFailed' ELSE 'success' END AS status FROM part")
def file_status(spark, sf_dir):
    return documents.parse_status(_files(spark, sf_dir))


@query(
    f"""WITH {_READ} SELECT doc_id, number, kind, type FROM r, (VALUES (1, 'dictionary', 'Catalog'), (2, 'dictionary', 'Pages'), (5, 'stream', NULL), (6, 'stream', NULL), (16, 'stream', NULL), (17, 'stream', NULL), (7, 'dictionary', 'Annot'), (8, 'dictionary', 'Annot'), (9, 'dictionary', NULL), (10, 'dictionary', 'Font'), (12, 'dictionary', 'Font'),
(14, 'dictionary', 'FontDescriptor'), (22, 'dictionary', 'Outlines'), (23, 'dictionary', NULL), (24, 'dictionary', NULL), (25, 'dictionary', 'Annot'), (27, 'dictionary', NULL), (28, 'dictionary', NULL), (30, 'dictionary', 'StructElem'), (31, 'dictionary', 'StructTreeRoot'), (40, 'dictionary', NULL)) v(number, kind, type)
UNION ALL SELECT doc_id, CAST(100 + i AS INTEGER), 'dictionary', 'Page' FROM pages UNION ALL SELECT doc_id, 60, 'stream', 'ObjStm' FROM r WHERE p_partkey % 2 = 0 UNION ALL SELECT doc_id, 61, 'stream', 'XRef' FROM r WHERE p_partkey % 4 = 0"""
)
def file_objects(spark, sf_dir):
    return documents.objects(_files(spark, sf_dir)).select("doc_id", F.col("number").cast("int").alias("number"), "kind", "type")


@query(f"WITH {_READ} SELECT doc_id, number, declared_length, discovered_length FROM (SELECT doc_id, 5 AS number, CAST(CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE length(p_type) END AS INTEGER) AS declared_length, CAST(length(p_type) AS INTEGER) AS discovered_length FROM r UNION ALL SELECT doc_id, 6, CAST(2 * length(p_name) + 1 AS INTEGER), CAST(2 * length(p_name) + 1 AS INTEGER) FROM r)")
def file_streams(spark, sf_dir):
    rows = documents.streams(documents.objects(_files(spark, sf_dir))).filter("number IN (5, 6)")
    return rows.select("doc_id", *[F.col(c).cast("int").alias(c) for c in ("number", "declared_length", "discovered_length")])


@query("SELECT CAST(p_partkey AS VARCHAR) AS doc_id, 'EolMarkersComply' AS kind, NULL::BIGINT AS value FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'PrevOffset', p_partkey FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'MalformedClassic', NULL FROM part WHERE p_partkey % 3 = 1 UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'HybridOffset', p_partkey FROM part WHERE p_partkey % 3 = 1")
def file_xref_facts(spark, sf_dir):
    return documents.xref_facts(_files(spark, sf_dir)).select("doc_id", "kind", "value")


@query(f"WITH {_READ} SELECT doc_id, 60 AS container, 50 AS number, 'dictionary' AS kind, 'Part' AS type, p_size::BIGINT AS size FROM r WHERE p_partkey % 2 = 0 UNION ALL SELECT doc_id, 60, 51, 'array', NULL, NULL FROM r WHERE p_partkey % 2 = 0")
def file_object_streams(spark, sf_dir):
    rows = documents.expanded_objects(documents.objects(_files(spark, sf_dir)))
    return rows.select("doc_id", F.col("container").cast("int").alias("container"), F.col("number").cast("int").alias("number"), "kind", "type", documents.nested.at(F.col("value"), "Size", kind="bigint").alias("size"))


@query(f"WITH {_READ} SELECT doc_id, 61 AS number, 4 * (p_size + 1) AS decoded_bytes, p_size + 1 AS entries, 1 AS compressed_entries, 1 AS root, false AS malformed FROM r WHERE p_partkey % 4 = 0")
def file_xref_streams(spark, sf_dir):
    rows = documents.xref_streams(documents.objects(_files(spark, sf_dir)))
    return rows.select("doc_id", *[F.col(c).cast("int").alias(c) for c in ("number", "decoded_bytes", "entries", "compressed_entries", "root")], "malformed")


@query(f"WITH {_READ} SELECT doc_id, number, decoded, filters, passed_on FROM (SELECT doc_id, 6 AS number, hex(encode(p_name)) AS decoded, 'AHx' AS filters, false AS passed_on FROM r UNION ALL SELECT doc_id, 16, hex(encode('jpeg')), 'DCTDecode', true FROM r UNION ALL SELECT doc_id, 17, NULL, '', NULL FROM r)")
def file_filter_chains(spark, sf_dir):
    rows = documents.objects(_files(spark, sf_dir)).filter("kind = 'stream' AND number IN (6, 16, 17)").select("doc_id", "number", documents.decoded_stream().alias("d"))
    return rows.select("doc_id", F.col("number").cast("int").alias("number"), F.hex("d.bytes").alias("decoded"), F.array_join(F.transform("d.facts", lambda f: f["filter"]), ",").alias("filters"), F.get("d.facts", F.lit(0))["passed_on"].alias("passed_on"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS doc_id, concat_ws(',', CASE WHEN p_partkey % 7 = 0 THEN 'encrypted' END, CASE WHEN p_partkey % 13 <> 0 THEN 'header' END, CASE WHEN p_partkey % 17 <> 0 AND p_partkey % 5 = 0 AND length(p_type) <> 1 THEN 'streamLength' END) AS facts FROM part")
def file_parse_facts(spark, sf_dir):
    rows = documents.parse_facts(_files(spark, sf_dir))
    return rows.select("doc_id", F.array_join(F.transform("facts", lambda f: f["kind"]), ",").alias("facts"))


@query(
    f"""WITH {_READ} SELECT doc_id, v.* FROM r, (VALUES (1, 'catalog', 'Pages', 2, 'pageTree', true), (1, 'catalog', 'Outlines', 22, 'outline', true), (1, 'catalog', 'AcroForm', 24, 'acroForm', true), (1, 'catalog', 'OpenAction', 27, 'action', true), (7, 'annotation', 'A', 27, 'action', true), (8, 'formField', 'Parent', 25, 'formField', true),
(12, 'font', 'FontDescriptor', 14, 'fontDescriptor', true), (14, 'fontDescriptor', 'FontFile2', 5, NULL, true), (22, 'outline', 'First', 23, 'outline', true), (22, 'outline', 'Last', 23, 'outline', true), (23, 'outline', 'A', 28, 'action', true), (23, 'outline', 'Dest', 30, 'structureElement', true), (24, 'acroForm', 'Fields', 25, 'formField', true),
(25, 'formField', 'Kids', 8, 'formField', true), (27, 'action', 'Next', 28, 'action', true), (27, 'action', 'D', 100, 'page', true), (30, 'structureElement', 'P', 31, 'structureTreeRoot', true), (31, 'structureTreeRoot', 'K', 30, 'structureElement', true)) v(src, src_family, link, dst, dst_family, found)
UNION ALL SELECT doc_id, 2, 'pageTree', 'Kids', CAST(100 + i AS INTEGER), 'page', true FROM pages
UNION ALL SELECT doc_id, CAST(100 + i AS INTEGER), 'page', v.* FROM pages, (VALUES ('Contents', 5, NULL, true), ('Contents', 6, NULL, true), ('Annots', 7, 'annotation', true), ('Annots', 8, 'formField', true), ('Annots', 99, NULL, false)) v(link, dst, dst_family, found)
UNION ALL SELECT doc_id, CAST(100 + i AS INTEGER), 'page', 'AA', 27, 'action', true FROM pages WHERE i % 2 = 0"""
)
def model_links(spark, sf_dir):
    rows = _model(spark, sf_dir)
    found = families.linked_objects(rows, families.typed_links(rows))
    return found.select("doc_id", F.col("src").cast("int").alias("src"), "src_family", "link", F.col("dst").cast("int").alias("dst"), "dst_family", "found")


@query(f"WITH {_READ} SELECT doc_id, CAST(100 + i AS INTEGER) AS node, 'F1' AS name, CASE WHEN i % 2 = 1 THEN 12 ELSE 10 END AS object FROM pages UNION ALL SELECT doc_id, CAST(100 + i AS INTEGER), 'F2', 12 FROM pages")
def model_page_fonts(spark, sf_dir):
    return families.page_fonts(_model(spark, sf_dir)).select("doc_id", F.col("node").cast("int").alias("node"), "name", F.col("object").cast("int").alias("object"))


@query(f"WITH {_READ} SELECT doc_id, CAST(100 + i AS INTEGER) AS node, CAST(CASE WHEN i % 2 = 1 THEN 90 * i ELSE p_size END AS VARCHAR) AS value FROM pages")
def model_inherited_values(spark, sf_dir):
    return families.inherited_values(_model(spark, sf_dir), "Rotate").select("doc_id", F.col("node").cast("int").alias("node"), "value")


@query(f"WITH {_READ} SELECT doc_id, v.* FROM r, (VALUES (7, 'Stream'), (8, 'Dictionary'), (25, NULL)) v(number, appearance)")
def model_appearances(spark, sf_dir):
    return families.appearance_types(_model(spark, sf_dir)).select("doc_id", F.col("number").cast("int").alias("number"), "appearance")


@query(f"WITH {_READ} SELECT doc_id, 23 AS number FROM r")
def model_structure_destinations(spark, sf_dir):
    return families.structure_destinations(_model(spark, sf_dir)).select("doc_id", F.col("number").cast("int").alias("number"))


@query(
    "SELECT CAST(p_partkey AS VARCHAR) AS doc_id, CASE WHEN p_partkey % 13 <> 0 THEN CASE WHEN p_partkey % 11 = 0 THEN 5 ELSE 0 END END AS header_offset, 1 AS version_major, CAST(CASE WHEN p_partkey % 13 = 0 THEN 4 ELSE p_partkey % 8 END AS INTEGER) AS version_minor, p_partkey % 7 = 0 AS encrypted, p_partkey % 4 = 0 AS contains_xref_stream, CAST(CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE p_partkey % 6 + 1 END AS INTEGER) AS post_eof_bytes FROM part"
)
def file_headers(spark, sf_dir):
    rows = documents.headers(_files(spark, sf_dir))
    return rows.select("doc_id", F.col("header_offset").cast("int").alias("header_offset"), "version_major", "version_minor", "encrypted", "contains_xref_stream", F.col("post_eof_bytes").cast("int").alias("post_eof_bytes"))


@query("WITH t AS (SELECT CAST(p_partkey AS VARCHAR) AS doc_id, p_partkey % 3 < 2 AS two, CASE WHEN p_partkey % 19 = 0 THEN 77 ELSE 1 END AS root FROM part) SELECT doc_id, CASE WHEN two THEN 1 ELSE 0 END AS pos, root, 40 AS info FROM t UNION ALL SELECT doc_id, 0, 1, NULL FROM t WHERE two")
def file_trailers(spark, sf_dir):
    return documents.trailers(_files(spark, sf_dir)).select("doc_id", "pos", F.col("root").cast("int").alias("root"), F.col("info").cast("int").alias("info"))


@query(f"WITH {_READ} SELECT doc_id, v.* FROM r, (VALUES (7, 'A', 27), (8, 'Parent', 25), (27, 'Next', 28), (1, 'Pages', 2), (1, 'Outlines', 22), (1, 'AcroForm', 24), (1, 'OpenAction', 27)) v(number, key, target)")
def file_references(spark, sf_dir):
    rows = documents.references(documents.objects(_files(spark, sf_dir)).filter("number IN (1, 7, 8, 24, 27)"))
    return rows.select("doc_id", F.col("number").cast("int").alias("number"), "key", F.col("target").cast("int").alias("target"))


@query(f"WITH {_READ} SELECT doc_id, '(' || p_name || ')' AS value FROM r")
def model_info_value(spark, sf_dir):
    return families.info_values(documents.trailers(_files(spark, sf_dir)), _model(spark, sf_dir), "Title")


@query(f"WITH {_READ} SELECT family, count(*) AS n FROM (SELECT 'page' AS family FROM pages UNION ALL SELECT unnest(['font', 'font']) FROM r) GROUP BY 1")
def family_pruning(spark, sf_dir):
    return model.only_families(_model(spark, sf_dir), ["page", "font"]).groupBy("family").agg(F.count("*").alias("n"))


# Resources: one file for each customer.


def _resource_files(spark, sf_dir: str) -> DataFrame:
    """A file for each customer: resources in place, by reference and inherited, fonts of three shapes, two output intents."""
    k = F.col("c_custkey")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    whole = lambda number, *body: text(f"{number} 0 obj\n", *body, "\nendobj\n")
    made = text(
        "%PDF-1.7\n", whole(1, "<< /Type /Catalog /Pages 2 0 R /OCProperties 40 0 R /Perms << /DocMDP 41 0 R >> >>"), whole(40, "<< /Type /OCProperties >>"), whole(41, "<< /Type /Sig >>"),
        whole(2, "<< /Type /Pages /Kids [3 0 R 4 0 R] /Resources << /XObject << /X0 10 0 R >> /ColorSpace << /C0 20 0 R >> /Unknown << /Z 10 0 R >> >> >>"),
        whole(3, "<< /Type /Page /Parent 2 0 R /Contents [5 0 R 99 0 R] /Resources << /XObject << /X0 11 0 R /X1 10 0 R >> /ExtGState << /G 30 0 R /Own << /CA 1 >> >> >> >>"), whole(4, "<< /Type /Page /Parent 2 0 R /Contents 5 0 R /Resources 9 0 R >>"), whole(5, _stream("", F.lit("q Q"))),
        whole(9, "<< /Pattern << /P", k, " 31 0 R >> /Font 8 0 R >>"), whole(8, "<< /F0 15 0 R /F1 18 0 R >>"), whole(10, _stream("/Type /XObject /Subtype /Form /Resources << /Font << /F 15 0 R >> >>", F.lit("BT ET"))), whole(11, _stream("/Subtype /Image", F.lit("x"))),
        whole(15, "<< /Type /Font /Subtype /Type0 /DescendantFonts [16 0 R] /ToUnicode 17 0 R >>"), whole(16, "<< /Type /Font /Subtype /CIDFontType2 /BaseFont /", F.col("c_mktsegment"), " /DW ", k, " >>"), whole(17, _stream("/Filter /AHx", _hex(F.col("c_name")))),
        whole(18, "<< /Type /Font /Subtype /TrueType /FontDescriptor 19 0 R /Widths [", k + 1, " 600] /ToUnicode (", F.col("c_name"), ") >>"), whole(19, "<< /Type /FontDescriptor /FontName /N", F.col("c_nationkey"), " >>"),
        whole(20, "<< /Family /Separation /Alternate /DeviceCMYK /TintTransform << /FunctionType 2 /N ", F.col("c_nationkey"), " >> >>"), whole(30, "<< /Type /ExtGState >>"), whole(31, "<< /PatternType 1 /Resources << /Font << /F 18 0 R >> >> >>"),
        whole(50, "<< /Type /OutputIntent /DestOutputProfile 17 0 R >>"), whole(51, "<< /Type /OutputIntent /DestOutputProfile ", F.when(k % 3 == 0, 5).when(k % 3 == 1, 17).otherwise(16), " 0 R >>"), "trailer\n<< /Root 1 0 R >>\n%%EOF\n",
    )
    content = F.encode(made, "ISO-8859-1")
    customer = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), FILES_A_TASK)
    return customer.select(k.cast("string").alias("doc_id"), F.octet_length(content).cast("bigint").alias("bytes"), content.alias("content"), F.lit(False).alias("too_large"))


def _resource_model(spark, sf_dir: str, *more: str) -> DataFrame:
    return _written(_resource_files(spark, sf_dir), more)


_CUSTOMER = "WITH r AS (SELECT *, CAST(c_custkey AS VARCHAR) AS doc_id FROM customer)"


@query(
    _CUSTOMER
    + """SELECT doc_id, v.* FROM r, (VALUES (2, 'XObject', 'X0', 10), (2, 'ColorSpace', 'C0', 20), (3, 'XObject', 'X0', 11), (3, 'XObject', 'X1', 10), (3, 'ExtGState', 'G', 30), (3, 'ExtGState', 'Own', NULL), (4, 'Font', 'F0', 15), (4, 'Font', 'F1', 18), (10, 'Font', 'F', 15), (31, 'Font', 'F', 18)) v(src, category, name, dst) UNION ALL SELECT doc_id, 4, 'Pattern', 'P' || c_custkey, 31 FROM r"""
)
def resource_entries(spark, sf_dir):
    rows = families.resource_entries(_resource_model(spark, sf_dir))
    return rows.select("doc_id", F.col("src").cast("int").alias("src"), "category", "name", F.col("dst").cast("int").alias("dst"))


@query(
    _CUSTOMER
    + """SELECT doc_id, v.* FROM r, (VALUES (3, 'XObject', 'X0', 11), (3, 'XObject', 'X1', 10), (3, 'ExtGState', 'G', 30), (3, 'ColorSpace', 'C0', 20), (4, 'XObject', 'X0', 10), (4, 'ColorSpace', 'C0', 20), (4, 'Font', 'F0', 15), (4, 'Font', 'F1', 18)) v(node, category, name, object) UNION ALL SELECT doc_id, 4, 'Pattern', 'P' || c_custkey, 31 FROM r"""
)
def page_resources(spark, sf_dir):
    rows = families.page_resources(_resource_model(spark, sf_dir))
    return rows.select("doc_id", F.col("node").cast("int").alias("node"), "category", "name", F.col("object").cast("int").alias("object"))


@query(_CUSTOMER + "SELECT doc_id, v.* FROM r, (VALUES (3, 'page', 5), (4, 'page', 5), (10, 'formXObject', 10)) v(src, src_family, stream)")
def content_streams(spark, sf_dir):
    rows = families.content_streams(_resource_model(spark, sf_dir))
    return rows.select("doc_id", F.col("src").cast("int").alias("src"), "src_family", F.col("stream").cast("int").alias("stream"))


@query(_CUSTOMER + "SELECT doc_id, 15 AS number, c_mktsegment AS name, NULL AS width, c_name AS to_unicode FROM r UNION ALL SELECT doc_id, 16, c_mktsegment, c_custkey, NULL FROM r UNION ALL SELECT doc_id, 18, 'N' || c_nationkey, c_custkey + 1, c_name FROM r")
def font_values(spark, sf_dir):
    return families.font_values(_resource_model(spark, sf_dir, "body", "data")).select("doc_id", F.col("number").cast("int").alias("number"), "name", "width", "to_unicode")


@query(_CUSTOMER + """SELECT doc_id, 20 AS number, '"/DeviceCMYK"' AS alternate, '{"FunctionType":2,"N":' || c_nationkey || '}' AS tint FROM r""")
def tint_signatures(spark, sf_dir):
    return families.tint_signatures(_resource_model(spark, sf_dir)).select("doc_id", F.col("number").cast("int").alias("number"), "alternate", "tint")


@query(_CUSTOMER + "SELECT doc_id, CASE c_custkey % 3 WHEN 0 THEN false WHEN 1 THEN true END AS same FROM r")
def same_output_profile(spark, sf_dir):
    return families.same_output_profile(_resource_model(spark, sf_dir))


@query(_CUSTOMER + "SELECT doc_id, v.* FROM r, (VALUES (1, 'OCProperties', 40), (1, 'Perms', NULL)) v(src, key, dst)")
def catalog_models(spark, sf_dir):
    rows = families.catalog_models(_resource_model(spark, sf_dir))
    return rows.select("doc_id", F.col("src").cast("int").alias("src"), "key", F.col("dst").cast("int").alias("dst"))


@query(_CUSTOMER + "SELECT doc_id, v.* FROM r, (VALUES (2, 'pageTree'), (10, 'formXObject'), (11, 'image'), (19, 'fontDescriptor'), (30, 'extGState'), (31, 'pattern'), (40, 'optionalContentProperties'), (41, 'signature')) v(number, family) ")
def indirect_models(spark, sf_dir):
    return families.indirect_models(_resource_model(spark, sf_dir)).select("doc_id", F.col("number").cast("int").alias("number"), "family")


# Packets, texts and scalar facts of the tables' rows.


@query("SELECT p_partkey AS doc_id, 'pdfa' AS family, p_size AS part, CASE WHEN p_partkey % 3 = 0 THEN lower(substr(p_type, 1, 1)) END AS conformance FROM part WHERE p_partkey % 4 <> 0 UNION ALL SELECT p_partkey, 'pdfua', CAST(p_partkey % 9 AS INTEGER), NULL FROM part WHERE p_partkey % 2 = 0")
def packet_claims(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    as_element = F.concat(F.lit("<pdfaid:part>"), size, F.lit("</pdfaid:part>"), F.when(k % 3 == 0, F.concat(F.lit("<pdfaid:conformance>"), F.substring("p_type", 1, 1), F.lit("</pdfaid:conformance>"))).otherwise(""))
    as_attribute = F.concat(F.lit('<rdf:Description pdfaid:part="'), size, F.lit('"'), F.when(k % 3 == 0, F.concat(F.lit(' pdfaid:conformance="'), F.substring("p_type", 1, 1), F.lit('"'))).otherwise(""), F.lit("/>"))
    packet = F.concat(F.when(k % 4 == 0, "<x/>").when(k % 4 == 1, as_attribute).otherwise(as_element), F.when(k % 2 == 0, F.concat(F.lit("<pdfuaid:part>"), (k % 9).cast("string"), F.lit("</pdfuaid:part>"))).otherwise(""))
    return documents.flavour_claims(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), packet.alias("packet")))


@query(
    """WITH f AS (SELECT o_custkey AS doc_id, bool_or(o_orderstatus = 'F') AND NOT bool_or(o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%') AS serialization_valid, NOT bool_or(o_orderkey % 5 = 0) AS spacing_complies FROM orders GROUP BY 1),
t AS (SELECT conv_id AS doc_id, count(*) FILTER (trim(text) <> '') = 1 AND count(*) FILTER (trim(text) <> '' AND turn = 0) = 1 AS title_ok FROM conversations GROUP BY 1)
SELECT doc_id, serialization_valid, spacing_complies, title_ok FROM f FULL JOIN t USING (doc_id)"""
)
def packet_checks(spark, sf_dir):
    kind = F.when(F.col("o_orderpriority").startswith("1"), "Malformed").when(F.col("o_orderpriority").startswith("2"), "Hostile").when(F.col("o_orderstatus") == "F", "PacketParsed")
    facts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.explode(F.array(kind, F.when(F.col("o_orderstatus") == "F", "PacketParsed").otherwise("Other"))).alias("kind"), F.when(F.col("o_orderkey") % 5 == 0, True).alias("bad_spacing"))
    titles = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.when(F.col("turn") == 0, "x-default").otherwise("en").alias("lang"), F.col("text").alias("value"))
    rows = metadata.packet_valid(facts).join(metadata.spacing_complies(facts), "doc_id", "full")
    return rows.join(metadata.one_default_title(titles), "doc_id", "full")


@query(
    """SELECT p_partkey, p_size % 2 = 0 AS private_use, lower(p_brand[1:2]) || 'x' AS family, p_size AS part, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'b' END AS conformance, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS token,
CASE p_partkey % 3 WHEN 0 THEN 'missingProperty' WHEN 1 THEN 'missingLink' ELSE 'unsupportedExpression' END AS category, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN 'object ' || p_size || ' 0' ELSE 'offset ' || p_partkey END AS location, p_size <= 30 AS dates FROM part"""
)
def text_functions(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    case = lambda *x: F.when(k % 3 == 0, x[0]).when(k % 3 == 1, x[1]).otherwise(x[2])
    none = F.lit(None).cast("string")
    name = F.concat(F.lower(F.substring("p_brand", 1, 2)), F.lit("x-"), size, F.when(F.col("p_size") % 3 == 0, "").otherwise("b"))
    parts, reason = derived.display_name_parts(name), case(F.concat(F.lit("unknown property '"), F.col("p_type"), F.lit("' here")), F.concat(F.lit("unknown validation model link "), F.col("p_name")), F.col("p_brand"))
    private = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit("\ue000"))).otherwise(F.col("p_name"))
    stamp = F.concat(F.lit("D:202001"), F.lpad(size, 2, "0"), F.lit("030405Z"))
    other = F.concat(F.lit("2020-01-"), F.lpad(F.least("p_size", F.lit(30)).cast("string"), 2, "0"), F.lit("T03:04:05Z"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", derived.has_private_use(private).alias("private_use"), parts["family"].alias("family"), parts["part"].alias("part"), parts["conformance"].alias("conformance"), derived.reason_token(reason, "'", "' here").alias("token"), derived.reason_category(reason).alias("category"),
        derived.location_text(case(F.col("p_name"), none, none), case(F.lit(None), F.col("p_size"), F.lit(None)).cast("int"), case(F.lit(None), F.lit(0), F.lit(None)).cast("int"), k).alias("location"), derived.dates_match(stamp, other).alias("dates"),
    )


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN (p_size % 5) || '.' || (p_size % 16) END AS version, CASE WHEN p_partkey % 5 <> 0 THEN 'prtr' END AS device_class, CASE WHEN p_partkey % 5 <> 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'RGB' ELSE 'CMYK' END END AS color_space, CASE WHEN p_partkey % 5 <> 0 THEN 'Lab' END AS pcs, CASE WHEN p_partkey % 5 <> 0 THEN p_size::BIGINT END AS rendering_intent, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey END AS tag_count FROM part")
def icc_headers(spark, sf_dir):
    number = lambda x, digits: F.lpad(F.hex(x.cast("bigint")), digits, "0")
    letters = lambda x: F.hex(x)
    k, size = F.col("p_partkey"), F.col("p_size")
    digits = F.concat(F.repeat(F.lit("00"), 8), number(size % 5, 2), number(size % 16 * 16, 2), F.repeat(F.lit("00"), 2), letters(F.lit("prtr")), letters(F.when(k % 2 == 0, "RGB ").otherwise("CMYK")), letters(F.lit("Lab ")), F.repeat(F.lit("00"), 40), number(size, 8), F.repeat(F.lit("00"), 60), F.when(k % 5 != 0, number(k, 8)).otherwise(""))
    rows = table(spark, sf_dir, "part").select("p_partkey", derived.icc_header(F.unhex(digits)).alias("h"))
    return rows.select("p_partkey", "h.version", "h.device_class", "h.color_space", "h.pcs", "h.rendering_intent", "h.tag_count")


@query("SELECT doc_id, node, page, tag, min(source) AS source FROM (SELECT l_orderkey AS doc_id, l_partkey AS node, l_linenumber AS page, l_returnflag AS tag, CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS source FROM lineitem UNION ALL SELECT l_orderkey, l_partkey, l_linenumber, l_returnflag, 1 FROM lineitem WHERE l_quantity < 10) GROUP BY ALL")
def artifacts(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    own = [F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("node"), F.col("l_linenumber").alias("page"), F.col("l_returnflag").alias("tag")]
    content = line.filter("l_linestatus <> 'O'").unionByName(line.filter("l_quantity < 10"))
    return accessibility.distinct_artifacts(line.filter("l_linestatus = 'O'").select(*own), content.select(*own))


@query("SELECT l_orderkey AS doc_id, l_suppkey AS node, count(*) FILTER (o_orderstatus = 'F') AS widgets FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND l_linenumber > 2 GROUP BY 1, 2")
def widgets(spark, sf_dir):
    # lines up to the second refer to nothing
    target = F.when(F.col("l_linenumber") > 2, F.col("l_orderkey")).otherwise(-F.col("l_orderkey") - 1)
    references = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").alias("node"), target.alias("target"))
    annotations = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderkey").alias("object"), F.when(F.col("o_orderstatus") == "F", "Widget").otherwise("Link").alias("subtype"))
    return accessibility.widget_counts(references, annotations)


@query("SELECT conv_id, turn, CASE WHEN turn % 3 < 2 THEN text END AS text, text IS NULL AS utf8 FROM conversations")
def text_decoding(spark, sf_dir):
    """Texts with either mark; every third with a lone surrogate behind it."""
    big = F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE"))
    little = F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))
    raw = F.when(F.col("turn") % 3 == 0, big).when(F.col("turn") % 3 == 1, little).otherwise(F.concat(big, F.unhex(F.lit("D800"))))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", derived.utf16_text(raw).alias("text"), derived.utf8_valid(raw).alias("utf8"))


@query(
    """SELECT p_partkey, p_partkey % 3 = 1 AS alt, p_size % 4 = 0 OR p_size > 25 AS glyphs, CASE p_partkey % 4 WHEN 0 THEN 'ICCBased' WHEN 1 THEN 'DeviceRGB' WHEN 2 THEN 'Indexed' END AS family, CASE WHEN p_partkey % 4 = 1 THEN 3 END AS n, CASE WHEN p_partkey % 4 = 0 THEN p_size::BIGINT END AS target FROM part"""
)
def scalar_checks(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    alt = F.when(k % 3 == 0, F.array("p_name")).when(k % 3 == 1, F.array(F.lit("en"), F.col("p_name"))).otherwise(F.array(F.col("p_name"), F.lit("")))
    value = F.when(k % 4 == 0, F.concat(F.lit("[/ICCBased "), size.cast("string"), F.lit(" 0 R]"))).when(k % 4 == 1, "/DeviceRGB").when(k % 4 == 2, "[ /Indexed /DeviceRGB 1 <00> ]").otherwise(size.cast("string"))
    space = derived.normalized_color_space(value, F.array().cast("array<string>"))
    return table(spark, sf_dir, "part").select("p_partkey", derived.media_alt_valid(alt).alias("alt"), derived.glyph_evidence(F.when(size % 4 == 0, True), F.lit(None).cast("boolean"), size - 25, F.lit(None).cast("boolean")).alias("glyphs"), space["family"].alias("family"), space["n"].alias("n"), space["target"].alias("target"))


@query("SELECT page_id, CASE WHEN page_id % 3 <> 2 THEN CAST(page_id AS VARCHAR) END AS id, CASE WHEN url NOT LIKE '%/' AND octet_length(encode('fixed-' || regexp_extract(url, '[^/]*$'))) <= 255 THEN 'fixed-' || regexp_extract(url, '[^/]*$') END AS output FROM pages")
def packet_and_output(spark, sf_dir):
    k = F.col("page_id")
    packet = F.when(k % 3 == 0, F.concat(F.lit("<?xpacket begin='' id='"), k.cast("string"), F.lit("'?>"))).when(k % 3 == 1, F.concat(F.lit('<?xpacket begin="" id="'), k.cast("string"), F.lit('"?>'))).otherwise("<x/>")
    return table(spark, sf_dir, "pages").select("page_id", derived.packet_attribute(packet, "id").alias("id"), derived.repair_output_name(F.col("url"), F.lit("fixed-")).alias("output"))


@query("SELECT l_orderkey AS doc_id, count(*) AS objects FROM lineitem GROUP BY 1 HAVING count(*) > 5")
def object_budget(spark, sf_dir):
    return model.over_budget(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id")), 5)


@query("SELECT l_suppkey AS doc_id, count(*) AS failures, CAST(max(n) AS INTEGER) AS last FROM (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) AS n FROM lineitem WHERE NOT l_quantity < 30) GROUP BY 1")
def failures_without_cap(spark, sf_dir):
    objects = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.lit("item").alias("family"), F.array().cast("array<string>").alias("supertypes"), F.lit(None).cast("string").alias("identity_key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("visit_seq"), "l_quantity")
    rule = rules.Rule("p", "quantity-small", "item", checked.all_(checked.lt(checked.prop("l_quantity", "number"), checked.lit(30))))
    return rules.retained_failures(rules.apply_rules(objects, [rule]), None).groupBy("doc_id").agg(F.count("*").alias("failures"), F.max("ordinal").alias("last"))


@query(
    """WITH p AS (SELECT p_type AS family, CASE WHEN p_size % 2 = 0 THEN 'stored' ELSE 'derived' END AS evidence FROM part), l AS (SELECT p_type AS family FROM part WHERE p_size < 10 UNION ALL SELECT 'links only'),
c AS (SELECT family, count(*) AS properties FROM p GROUP BY 1), e AS (SELECT family, string_agg(evidence || '=' || n, ',' ORDER BY evidence) AS evidence FROM (SELECT family, evidence, count(*) AS n FROM p GROUP BY 1, 2) GROUP BY 1)
SELECT family, coalesce(properties, 0) AS properties, coalesce(links, 0) AS links, evidence FROM c FULL JOIN (SELECT family, count(*) AS links FROM l GROUP BY 1) USING (family) LEFT JOIN e USING (family)"""
)
def schema_counts(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    properties = part.select(F.col("p_type").alias("family"), F.when(F.col("p_size") % 2 == 0, "stored").otherwise("derived").alias("evidence"))
    links = part.filter("p_size < 10").select(F.col("p_type").alias("family")).unionByName(spark.createDataFrame([("links only",)], "family string"))
    rows = families.schema_counts(properties, links)
    return rows.withColumn("evidence", F.array_join(F.transform("evidence", lambda e: F.concat(e["evidence"], F.lit("="), e["n"].cast("string"))), ","))


# Claims and profiles.

_PROFILES = [("pdfa", 1, "b", "pdfa-1b"), ("pdfa", 2, "b", "pdfa-2b"), ("pdfa", 4, "", "pdfa-4"), ("pdfua", 1, "", "pdfua-1"), ("pdfua", 2, "", "pdfua-2"), ("wtpdf", 1, "reuse", "wtpdf-1-0-reuse")]
_CLAIMS = f"""WITH cat AS (SELECT * FROM (VALUES {", ".join(f"('{f}', {p}, '{k}', '{i}')" for f, p, k, i in _PROFILES)}) t(family, part, conformance, profile_id)),
c AS (SELECT doc_id, 0 AS ordinal, 'pdfa' AS family, CAST(doc_id % 5 AS INTEGER) AS part, CASE WHEN doc_id % 5 < 4 THEN 'b' END AS conformance FROM documents WHERE doc_id % 3 = 0 UNION ALL
 SELECT doc_id, 1, 'pdfua', CAST(doc_id % 2 AS INTEGER) + 1, NULL FROM documents WHERE doc_id % 4 = 0)"""


def _claims(spark, sf_dir) -> DataFrame:
    ids = table(spark, sf_dir, "documents").select("doc_id")
    n = lambda k: (F.col("doc_id") % k).cast("int")
    first = ids.filter("doc_id % 3 = 0").select("doc_id", F.lit(0).alias("ordinal"), F.lit("pdfa").alias("family"), n(5).alias("part"), F.when(n(5) < 4, "b").alias("conformance"))
    return first.unionByName(ids.filter("doc_id % 4 = 0").select("doc_id", F.lit(1).alias("ordinal"), F.lit("pdfua").alias("family"), (n(2) + 1).alias("part"), F.lit(None).cast("string").alias("conformance")))


def _catalogue(spark) -> DataFrame:
    return spark.createDataFrame(_PROFILES, "family string, part int, conformance string, profile_id string")


@query(
    _CLAIMS
    + """, r AS (SELECT c.*, profile_id, CASE WHEN profile_id IS NULL THEN NULL WHEN c.family = 'pdfa' AND c.part BETWEEN 1 AND 3 OR c.family = 'pdfua' AND c.part = 1 THEN 'pdf-1' ELSE 'pdf-2' END AS g FROM c LEFT JOIN cat ON cat.family = c.family AND cat.part = c.part AND cat.conformance = coalesce(c.conformance, '')),
f AS (SELECT doc_id, arg_min(g, ordinal) FILTER (g IS NOT NULL) AS first FROM r GROUP BY 1)
SELECT doc_id, ordinal, CASE WHEN g = first THEN profile_id END AS profile_id, CASE WHEN g = first THEN 'selected' WHEN g IS NOT NULL THEN 'incompatible' ELSE 'unsupported' END AS outcome FROM r JOIN f USING (doc_id)
UNION ALL SELECT doc_id, NULL, 'pdfa-1b', 'fallback' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM f WHERE first IS NOT NULL)"""
)
def flavour_detect(spark, sf_dir):
    return profiles.detect_profiles(table(spark, sf_dir, "documents"), _claims(spark, sf_dir), _catalogue(spark), "pdfa-1b")


@query(_CLAIMS + " SELECT d.doc_id, cat.profile_id FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id AND c.ordinal = 0 LEFT JOIN cat ON cat.family = c.family AND cat.part = c.part AND cat.conformance = coalesce(c.conformance, '')")
def profile_select(spark, sf_dir):
    return profiles.select_profiles(table(spark, sf_dir, "documents"), _claims(spark, sf_dir).filter("ordinal = 0"), _catalogue(spark))


@query("WITH u AS (SELECT doc_id, CAST(doc_id % 4 AS INTEGER) AS ordinal FROM documents) SELECT doc_id, list_value('http://pdfa.org/declarations/wtpdf#' || CASE ordinal WHEN 1 THEN 'accessibility1.0' ELSE 'reuse1.0' END) AS declarations FROM u WHERE ordinal IN (1, 2)")
def declarations(spark, sf_dir):
    known = list(profiles.DECLARATIONS)
    n = (F.col("doc_id") % 4).cast("int")
    uris = table(spark, sf_dir, "documents").select("doc_id", n.alias("ordinal"), F.when(n == 1, known[0]).when(n == 2, known[1]).otherwise("urn:other").alias("uri"))
    return profiles.claimed_declarations(profiles.declaration_claims(uris))


# Clusters, repairs, metadata.


@query(
    """WITH k AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'unsupportedExpression' WHEN 1 THEN 'missingSemanticFamily' WHEN 2 THEN 'missingProperty' ELSE 'unknownLink' END AS reason, CASE p_partkey % 6 WHEN 0 THEN 'document' WHEN 1 THEN 'font' WHEN 2 THEN 'image' WHEN 3 THEN 'metadata' WHEN 4 THEN 'table' ELSE 'page' END AS type,
 CASE WHEN p_partkey % 5 = 0 THEN 'XMPTitle' END AS property, CASE WHEN p_partkey % 7 = 0 THEN 'contentStream' WHEN p_partkey % 7 = 1 THEN 'accessibility' END AS family FROM part),
p AS (SELECT *, CASE WHEN reason = 'unsupportedExpression' THEN 'G1' WHEN reason = 'missingSemanticFamily' AND family = 'contentStream' THEN 'G4' WHEN reason = 'missingSemanticFamily' AND family = 'accessibility' THEN 'G6' WHEN reason = 'missingProperty' AND type = 'document' AND property = 'XMPTitle' THEN 'G5'
 WHEN type = 'font' THEN 'G3' WHEN type = 'image' THEN 'G4' WHEN type = 'metadata' THEN 'G5' WHEN type = 'table' THEN 'G6' ELSE 'G2' END AS phase FROM k)
SELECT p_partkey, phase, CASE WHEN reason = 'unsupportedExpression' THEN 'Expression parity' WHEN phase IN ('G3', 'G4') THEN 'Resource semantics' WHEN phase = 'G5' THEN 'XMP RDF metadata' WHEN phase = 'G6' THEN 'Accessibility semantics' ELSE 'Derived model properties' END AS section FROM p"""
)
def cluster_phases(spark, sf_dir):
    size, key = F.col("p_size") % 4, F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(size == 0, "unsupportedExpression").when(size == 1, "missingSemanticFamily").when(size == 2, "missingProperty").otherwise("unknownLink").alias("reason"),
        F.element_at(F.array(*map(F.lit, ("document", "font", "image", "metadata", "table", "page"))), (key % 6 + 1).cast("int")).alias("type"), F.when(key % 5 == 0, "XMPTitle").alias("property"), F.when(key % 7 == 0, "contentStream").when(key % 7 == 1, "accessibility").alias("family"),
    )
    phase = derived.cluster_phase(F.col("reason"), F.col("type"), F.col("property"), F.col("family"))
    return rows.withColumn("phase", phase).select("p_partkey", "phase", derived.cluster_section(F.col("reason"), F.col("phase")).alias("section"))


_REPAIRED = "WITH r AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'succeeded' WHEN o_orderkey % 50 = 0 THEN 'refused' WHEN o_orderstatus = 'O' THEN 'noAction' ELSE 'other' END AS status FROM orders)"


@query(_REPAIRED + " SELECT count(*) AS total_files, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'noAction') AS no_action, count(*) FILTER (status = 'refused') AS refused, count(*) FILTER (status = 'failed') AS failed, CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 'internalError' WHEN count(*) FILTER (status = 'refused') > 0 THEN 'processingFailed' ELSE 'success' END AS category FROM r")
def repair_summary(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderkey") % 50 == 0, "refused").when(F.col("o_orderstatus") == "O", "noAction").otherwise("other")
    return reports.repair_summary(table(spark, sf_dir, "orders").select(status.alias("status")))


_ROLES = "CASE o_orderkey % 6 WHEN 0 THEN 'text' WHEN 1 THEN 'sequence' WHEN 2 THEN 'bag' WHEN 3 THEN 'valueType' WHEN 4 THEN 'type' ELSE 'other' END"


@query(
    f"""WITH p AS (SELECT o_custkey AS doc_id, {_ROLES} AS role, CASE WHEN o_orderpriority LIKE '1%' THEN ' ' WHEN o_orderpriority LIKE '2%' THEN 'Text' WHEN o_orderpriority LIKE '5%' THEN NULL ELSE 'own' END AS value, CASE o_orderstatus WHEN 'F' THEN 'Seq' WHEN 'O' THEN 'Bag' END AS kind FROM orders)
SELECT d.doc_id, coalesce(bool_and(coalesce(trim(value) <> '', false)) FILTER (role = 'text'), true) AS text_valid, coalesce(bool_or(kind IS NOT DISTINCT FROM 'Seq') FILTER (role = 'sequence'), true) AS seq_valid, coalesce(bool_or(kind IS NOT DISTINCT FROM 'Bag') FILTER (role = 'bag'), true) AS bag_valid,
NOT EXISTS (SELECT 1 FROM p v WHERE v.doc_id = d.doc_id AND v.role = 'valueType' AND v.value IS NOT NULL AND v.value <> 'Text' AND NOT EXISTS (SELECT 1 FROM p t WHERE t.doc_id = d.doc_id AND t.role = 'type' AND t.value = v.value)) AS types_defined
FROM (SELECT c_custkey AS doc_id FROM customer) d LEFT JOIN p ON p.doc_id = d.doc_id GROUP BY d.doc_id"""
)
def extension_checks(spark, sf_dir):
    priority = lambda k: F.col("o_orderpriority").like(f"{k}%")
    roles = F.element_at(F.array(*map(F.lit, ("text", "sequence", "bag", "valueType", "type", "other"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    value = F.when(priority(1), " ").when(priority(2), "Text").when(~priority(5), "own")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), roles.alias("role"), value.alias("value"), F.when(F.col("o_orderstatus") == "F", "Seq").when(F.col("o_orderstatus") == "O", "Bag").alias("array_kind"))
    return metadata.extension_checks(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id")), rows)


@query("WITH n AS (SELECT user_id AS doc_id, event_id AS seq, event_type AS kind, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) SELECT doc_id, seq, kind FROM n WHERE k <= 5 UNION ALL SELECT doc_id, NULL, 'factCapReached' FROM n WHERE k = 6")
def fact_cap(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"))
    return metadata.capped_facts(rows, 5)


@query("WITH e AS (SELECT c_custkey AS doc_id, c_nationkey > 3 AS w, c_nationkey = 7 AS m, c_nationkey = 8 AS h FROM customer) SELECT doc_id, 'missingWrapper' AS warning FROM e WHERE NOT w UNION ALL SELECT doc_id, 'malformed' FROM e WHERE m UNION ALL SELECT doc_id, 'hostile' FROM e WHERE h UNION ALL SELECT DISTINCT o_custkey, 'duplicate claim ' || o_orderpriority FROM (SELECT o_custkey, o_orderstatus, o_orderpriority FROM orders GROUP BY ALL HAVING count(*) > 1)")
def packet_warnings(spark, sf_dir):
    n = F.col("c_nationkey")
    packets = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), (n > 3).alias("has_wrapper"), (n == 7).alias("malformed"), (n == 8).alias("hostile"))
    return metadata.packet_warnings(packets, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("namespace"), F.col("o_orderpriority").alias("name")))


