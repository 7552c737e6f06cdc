"""Small documents and rows made here, with the rows that they must give."""

import zlib

import duckdb
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import derived
from quillspark.operators import accessibility, families, metadata, model
from quillspark.sources import documents

CASES = {}


def query(sql):
    def add(f):
        CASES[f.__name__] = (f, sql)
        return f

    return add


# Documents.


def _stream(dictionary: bytes, data: bytes, length: int | None = None) -> bytes:
    return b"<< " + dictionary + b" /Length " + str(len(data) if length is None else length).encode() + b" >>\nstream\n" + data + b"\nendstream"


def _file(*objects: tuple[int, bytes], trailer: bytes = b"/Root 1 0 R", before: bytes = b"") -> bytes:
    body = b"".join(str(n).encode() + b" 0 obj\n" + x + b"\nendobj\n" for n, x in objects)
    end = b"trailer\n<< " + trailer + b" >>\n" if trailer else b""
    return before + b"%PDF-1.7\n" + body + end + b"startxref\n0\n%%EOF\n"


_CATALOG = (1, b"<< /Type /Catalog >>")
_INNER = b"1 0 7 23 << /Type /Catalog >> [1 2 3]"
_PACKED = zlib.compress(_INNER)
_ENTRIES = bytes([1, 0, 9, 0, 2, 0, 2, 1, 0, 0, 0, 0])
_MANY = 2000
_TABLE = b"xref\n0 %d\n" % _MANY + b"0000000000 00000 n \n" * _MANY + b"trailer\n<< /Root 1 0 R /Prev 77 >>\n"
FILES = {
    "minimal": _file(_CATALOG, (2, b"42")),
    "junk-before": _file(_CATALOG, before=b"junk\n"),
    "no-header": b"not a pdf\n",
    "no-catalog": _file((2, b"<< /Type /Page >>")),
    "encrypted": _file(_CATALOG, trailer=b"/Root 1 0 R /Encrypt 3 0 R"),
    "packed": _file((2, _stream(b"/Type /ObjStm /N 2 /First 9 /Filter /FlateDecode", zlib.compress(b"1 0 7 21 << /Type /Catalog >> [1 2 3]"))), (3, _stream(b"/Type /XRef /Size 3 /W [1 2 1] /Root 1 0 R", _ENTRIES)), trailer=b""),
    "keywords": _file(_CATALOG, (2, _stream(b"/A (endobj \\) (stream) x)", b"abc endobj\nendstream def")), (3, _stream(b"", b"abc", 20)), (4, b"(text with 9 0 obj and endobj) % endobj\n"), trailer=b"/Root 1 0 R"),
    "table": _file(_CATALOG, trailer=b"").replace(b"startxref", _TABLE + b"startxref"),
    "bad-table": _file(_CATALOG, trailer=b"").replace(b"startxref", b"xref\n0 1\n0000000000 65535 f\ntrailer\n<< /Root 1 0 R /XRefStm 5 >>\nstartxref"),
    "chain": _file(_CATALOG, (2, _stream(b"/Filter [/AHx /Fl]", zlib.compress(b"hello").hex().encode() + b">")), (3, _stream(b"/Filter [/DCTDecode]", b"\xff\xd8jpeg")), (4, _stream(b"/Filter /Unknown", b"x")), (5, _stream(b"/Filter /Fl /DecodeParms << /Predictor 12 /Columns 3 >>", zlib.compress(bytes([2, 1, 2, 3, 2, 1, 1, 1]))))),
    "model": _file(
        (1, b"<< /Type /Catalog /Pages 2 0 R /Metadata 20 0 R /OutputIntents [21 0 R] /Outlines 22 0 R /AcroForm 24 0 R /OpenAction 27 0 R >>"),
        (2, b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /Resources << /Font << /F1 10 0 R /F2 11 0 R >> >> /Rotate 90 >>"),
        (3, b"<< /Type /Page /Parent 2 0 R /Contents [5 0 R 6 0 R] /Annots [7 0 R 8 0 R 99 0 R] /Resources 9 0 R >>"),
        (4, b"<< /Type /Page /Parent 2 0 R /Rotate 0 /AA << /O 27 0 R /C 28 0 R >> >>"),
        (5, _stream(b"", b"q Q")), (6, _stream(b"", b"BT ET")),
        (7, b"<< /Type /Annot /Subtype /Link /Rect [0 0 1 1] /A 27 0 R /AP << /N 5 0 R >> >>"),
        (8, b"<< /Type /Annot /Subtype /Widget /Rect [0 0 1 1] /Parent 25 0 R /AP << /N << /On 5 0 R >> >> >>"),
        (9, b"<< /Font << /F1 12 0 R >> >>"),
        (10, b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"), (11, b"<< /Type /Font /Subtype /Type0 /DescendantFonts [13 0 R] /ToUnicode 5 0 R >>"), (12, b"<< /Type /Font /Subtype /TrueType /FontDescriptor 14 0 R >>"),
        (13, b"<< /Type /Font /Subtype /CIDFontType2 /FontDescriptor 14 0 R >>"), (14, b"<< /Type /FontDescriptor /FontFile2 5 0 R >>"),
        (20, _stream(b"/Type /Metadata", b"<x/>")), (21, b"<< /Type /OutputIntent /DestOutputProfile 5 0 R >>"), (22, b"<< /Type /Outlines /First 23 0 R /Last 23 0 R >>"), (23, b"<< /Title (a) /Parent 22 0 R /Dest [30 0 R /Fit] /A 28 0 R >>"),
        (24, b"<< /Fields [25 0 R] >>"), (25, b"<< /Type /Annot /Subtype /Widget /Kids [8 0 R] /T (f) >>"), (27, b"<< /S /GoTo /D [3 0 R /Fit] /Next 28 0 R >>"), (28, b"<< /S /URI /URI (http://a) >>"), (30, b"<< /Type /StructElem /S /P /P 31 0 R >>"), (31, b"<< /Type /StructTreeRoot /K [30 0 R] >>"),
        (40, b"<< /Producer (maker) /Title (a title) >>"), trailer=b"/Root 1 0 R /Info 40 0 R",
    ),
}


def _files(spark, *names: str) -> DataFrame:
    return documents.from_memory(spark, {k: FILES[k] for k in names or FILES})


def _model(spark) -> DataFrame:
    return families.typed(documents.objects(_files(spark, "model")))


@query("SELECT * FROM (VALUES ('minimal', 'success'), ('junk-before', 'success'), ('no-header', 'parseFailed'), ('no-catalog', 'parseFailed'), ('encrypted', 'encrypted'), ('packed', 'success'), ('keywords', 'success'), ('table', 'success'), ('bad-table', 'success'), ('chain', 'success'), ('model', 'success')) t(doc_id, status)")
def file_status(spark, sf_dir):
    return documents.parse_status(_files(spark))


@query("SELECT * FROM (VALUES (1, 'dictionary', 'Catalog', NULL, NULL), (2, 'stream', NULL, 24, 24), (3, 'stream', NULL, 20, 3), (4, 'string', NULL, NULL, NULL)) t(number, kind, type, declared_length, discovered_length)")
def file_objects(spark, sf_dir):
    rows = documents.objects(_files(spark, "keywords"))
    lengths = documents.streams(rows).select("number", "discovered_length")
    return rows.join(lengths, "number", "left").select(F.col("number").cast("int").alias("number"), "kind", "type", F.col("declared_length").cast("int").alias("declared_length"), F.col("discovered_length").cast("int").alias("discovered_length"))


@query("SELECT * FROM (VALUES ('table', 'EolMarkersComply', NULL), ('table', 'PrevOffset', 77), ('bad-table', 'MalformedClassic', NULL), ('bad-table', 'HybridOffset', 5)) t(doc_id, kind, value)")
def file_xref_facts(spark, sf_dir):
    return documents.xref_facts(_files(spark, "table", "bad-table")).select("doc_id", "kind", F.col("value").cast("int").alias("value"))


@query("SELECT * FROM (VALUES (2, 1, 'dictionary', 'Catalog'), (2, 7, 'array', NULL)) t(container, number, kind, type)")
def file_object_streams(spark, sf_dir):
    rows = documents.expanded_objects(documents.objects(_files(spark, "packed", "minimal")))
    return rows.select(F.col("container").cast("int").alias("container"), F.col("number").cast("int").alias("number"), "kind", "type")


@query("SELECT 3 AS number, 12 AS decoded_bytes, 3 AS entries, 1 AS compressed_entries, 1 AS root, false AS malformed")
def file_xref_streams(spark, sf_dir):
    rows = documents.xref_streams(documents.objects(_files(spark, "packed", "minimal")))
    return rows.select(*[F.col(c).cast("int").alias(c) for c in ("number", "decoded_bytes", "entries", "compressed_entries", "root")], "malformed")


@query("SELECT * FROM (VALUES (2, '68656C6C6F', 'AHx,Fl', false), (3, 'FFD86A706567', 'DCTDecode', true), (4, NULL, '', NULL), (5, '010203020304', 'Fl', false)) t(number, decoded, filters, passed_on)")
def file_filter_chains(spark, sf_dir):
    rows = documents.objects(_files(spark, "chain")).filter("kind = 'stream'").select("number", documents.decoded_stream().alias("d"))
    return rows.select(F.col("number").cast("int").alias("number"), F.hex("d.bytes").alias("decoded"), F.array_join(F.transform("d.facts", lambda f: f["filter"]), ",").alias("filters"), F.get("d.facts", F.lit(0))["passed_on"].alias("passed_on"))


@query("SELECT * FROM (VALUES ('minimal', 'header'), ('no-header', ''), ('encrypted', 'encrypted,header'), ('keywords', 'header,streamLength')) t(doc_id, facts)")
def file_parse_facts(spark, sf_dir):
    rows = documents.parse_facts(_files(spark, "minimal", "no-header", "encrypted", "keywords"))
    return rows.select("doc_id", F.array_join(F.transform("facts", lambda f: f["kind"]), ",").alias("facts"))


@query(
    """SELECT * FROM (VALUES (1, 'catalog', 'Metadata', 20, 'metadata', true), (1, 'catalog', 'OutputIntents', 21, 'outputIntent', true), (1, 'catalog', 'Pages', 2, 'pageTree', true), (1, 'catalog', 'Outlines', 22, 'outline', true), (1, 'catalog', 'AcroForm', 24, 'acroForm', true), (1, 'catalog', 'OpenAction', 27, 'action', true),
(2, 'pageTree', 'Kids', 3, 'page', true), (2, 'pageTree', 'Kids', 4, 'page', true), (3, 'page', 'Contents', 5, NULL, true), (3, 'page', 'Contents', 6, NULL, true), (3, 'page', 'Annots', 7, 'annotation', true), (3, 'page', 'Annots', 8, 'formField', true), (3, 'page', 'Annots', 99, NULL, false), (4, 'page', 'AA', 27, 'action', true), (4, 'page', 'AA', 28, 'action', true),
(7, 'annotation', 'A', 27, 'action', true), (8, 'formField', 'Parent', 25, 'formField', true), (11, 'font', 'DescendantFonts', 13, 'font', true), (11, 'font', 'ToUnicode', 5, NULL, true), (12, 'font', 'FontDescriptor', 14, 'fontDescriptor', true), (13, 'font', 'FontDescriptor', 14, 'fontDescriptor', true), (14, 'fontDescriptor', 'FontFile2', 5, NULL, true),
(21, 'outputIntent', 'DestOutputProfile', 5, NULL, true), (22, 'outline', 'First', 23, 'outline', true), (22, 'outline', 'Last', 23, 'outline', true), (23, 'outline', 'A', 28, 'action', true), (23, 'outline', 'Dest', 30, 'structureElement', true), (24, 'acroForm', 'Fields', 25, 'formField', true), (25, 'formField', 'Kids', 8, 'formField', true),
(27, 'action', 'Next', 28, 'action', true), (27, 'action', 'D', 3, 'page', true), (30, 'structureElement', 'P', 31, 'structureTreeRoot', true), (31, 'structureTreeRoot', 'K', 30, 'structureElement', true)) t(src, src_family, link, dst, dst_family, found)"""
)
def model_links(spark, sf_dir):
    rows = _model(spark)
    found = families.linked_objects(rows, families.typed_links(rows))
    return found.select(F.col("src").cast("int").alias("src"), "src_family", "link", F.col("dst").cast("int").alias("dst"), "dst_family", "found")


@query("SELECT * FROM (VALUES (3, 'F1', 12), (3, 'F2', 11), (4, 'F1', 10), (4, 'F2', 11)) t(node, name, object)")
def model_page_fonts(spark, sf_dir):
    return families.page_fonts(_model(spark)).select(F.col("node").cast("int").alias("node"), "name", F.col("object").cast("int").alias("object"))


@query("SELECT * FROM (VALUES (3, '90'), (4, '0')) t(node, value)")
def model_inherited_values(spark, sf_dir):
    return families.inherited_values(_model(spark), "Rotate").select(F.col("node").cast("int").alias("node"), "value")


@query("SELECT * FROM (VALUES (7, 'Stream'), (8, 'Dictionary'), (25, NULL)) t(number, appearance)")
def model_appearances(spark, sf_dir):
    return families.appearance_types(_model(spark)).select(F.col("number").cast("int").alias("number"), "appearance")


@query("SELECT 23 AS number")
def model_structure_destinations(spark, sf_dir):
    return families.structure_destinations(_model(spark)).select(F.col("number").cast("int").alias("number"))


@query("SELECT * FROM (VALUES ('minimal', 0, 1, 7, false, false, 2), ('junk-before', 5, 1, 7, false, false, 1), ('no-header', NULL, 1, 4, false, false, 0), ('encrypted', 0, 1, 7, true, false, 1), ('packed', 0, 1, 7, false, true, 2)) t(doc_id, header_offset, version_major, version_minor, encrypted, contains_xref_stream, object_count)")
def file_headers(spark, sf_dir):
    rows = documents.headers(_files(spark, "minimal", "junk-before", "no-header", "encrypted", "packed"))
    return rows.select("doc_id", F.col("header_offset").cast("int").alias("header_offset"), "version_major", "version_minor", "encrypted", "contains_xref_stream", F.col("object_count").cast("int").alias("object_count"))


@query("SELECT * FROM (VALUES ('minimal', 0, 1, NULL), ('model', 0, 1, 40), ('table', 0, 1, NULL)) t(doc_id, pos, root, info)")
def file_trailers(spark, sf_dir):
    return documents.trailers(_files(spark, "minimal", "model", "table")).select("doc_id", F.col("pos").cast("int").alias("pos"), F.col("root").cast("int").alias("root"), F.col("info").cast("int").alias("info"))


@query("SELECT * FROM (VALUES (7, 'A', 27), (8, 'Parent', 25), (24, 'Fields', 25), (27, 'Next', 28)) t(number, key, target)")
def file_references(spark, sf_dir):
    rows = documents.references(documents.objects(_files(spark, "model")).filter("number IN (7, 8, 24, 27)"))
    arrays = families.typed_links(_model(spark)).filter("src = 24").select(F.col("src").alias("number"), F.col("link").alias("key"), F.col("dst").alias("target"))
    found = rows.filter("key IN ('A', 'Parent', 'Next')").select("number", "key", "target").unionByName(arrays)
    return found.select(F.col("number").cast("int").alias("number"), "key", F.col("target").cast("int").alias("target"))


@query("SELECT * FROM (VALUES (1, 'pdfa', 2, 'b'), (1, 'pdfua', 1, NULL), (2, 'pdfa', 1, 'a')) t(doc_id, family, part, conformance)")
def packet_claims(spark, sf_dir):
    data = [(1, "<pdfaid:part>2</pdfaid:part><pdfaid:conformance>B</pdfaid:conformance><pdfuaid:part>1</pdfuaid:part>"), (2, '<rdf:Description pdfaid:part="1" pdfaid:conformance="A"/>'), (3, "<x/>")]
    return documents.flavour_claims(spark.createDataFrame(data, "doc_id int, packet string"))


@query("SELECT * FROM (VALUES (1, true, true, true), (2, false, true, false), (3, false, false, NULL), (4, NULL, NULL, false)) t(doc_id, serialization_valid, spacing_complies, title_ok)")
def packet_checks(spark, sf_dir):
    facts = spark.createDataFrame([(1, "PacketParsed", False), (2, "PacketParsed", None), (2, "Hostile", None), (3, "Malformed", True)], "doc_id int, kind string, bad_spacing boolean")
    titles = spark.createDataFrame([(1, "x-default", "a"), (1, "en", " "), (2, "x-default", "a"), (2, "en", "b"), (4, "en", "a")], "doc_id int, lang string, value string")
    rows = metadata.packet_valid(facts).join(metadata.spacing_complies(facts), "doc_id", "full")
    return rows.join(metadata.one_default_title(titles), "doc_id", "full")


@query(
    "SELECT * FROM (VALUES (1, true, 'pdfa', 2, 'b', 'x', 'missingProperty', 'p', true), (2, false, 'pdfua', 1, '', NULL, 'missingLink', 'object 3 1', false), (3, NULL, 'wtpdf', 1, '-0-reuse', NULL, 'unsupportedExpression', 'offset 9', NULL), (4, false, 'pdfa', NULL, '', NULL, 'missingObjectType', 'unknown', false)) t(i, private_use, family, part, conformance, token, category, location, dates)"
)
def text_functions(spark, sf_dir):
    schema = "i int, s string, name string, reason string, path string, number int, generation int, offset bigint, info string, xmp string"
    data = [
        (1, "a\ue000", "pdfa-2b", "unknown property 'x' here", "p", 1, 0, 5, "D:20200102030405Z", "2020-01-02T03:04:05Z"), (2, "a", "pdfua-1", "unknown link", None, 3, 1, 5, "D:20200102030405Z", None),
        (3, None, "wtpdf-1-0-reuse", "odd", None, None, None, 9, None, "2020"), (4, "é", "pdfa", "unknown validation model family", None, None, None, None, "D:2020", "2021"),
    ]
    rows = spark.createDataFrame(data, schema)
    parts = derived.display_name_parts(F.col("name"))
    return rows.select(
        "i", derived.has_private_use(F.col("s")).alias("private_use"), parts["family"].alias("family"), parts["part"].alias("part"), parts["conformance"].alias("conformance"), derived.reason_token(F.col("reason"), "'", "' here").alias("token"),
        derived.reason_category(F.col("reason")).alias("category"), derived.location_text(F.col("path"), F.col("number"), F.col("generation"), F.col("offset")).alias("location"), derived.dates_match(F.col("info"), F.col("xmp")).alias("dates"),
    )


@query("SELECT * FROM (VALUES (1, '4.2', 'prtr', 'RGB', 'Lab', 1, 3), (2, NULL, NULL, NULL, NULL, NULL, NULL)) t(i, version, device_class, color_space, pcs, rendering_intent, tag_count)")
def icc_headers(spark, sf_dir):
    head = bytearray(132)
    head[8:10], head[12:16], head[16:20], head[20:24], head[64:68], head[128:132] = b"\x04\x20", b"prtr", b"RGB ", b"Lab ", b"\0\0\0\1", b"\0\0\0\3"
    rows = spark.createDataFrame([(1, head), (2, head[:100])], "i int, profile binary").select("i", derived.icc_header(F.col("profile")).alias("h"))
    return rows.select("i", "h.version", "h.device_class", "h.color_space", "h.pcs", F.col("h.rendering_intent").cast("int").alias("rendering_intent"), F.col("h.tag_count").cast("int").alias("tag_count"))


@query("SELECT * FROM (VALUES (1, 10, 'P', 0), (1, 11, 'Q', 1), (1, 12, 'P', 1)) t(doc_id, node, tag, source)")
def artifacts(spark, sf_dir):
    schema = "doc_id int, node int, page int, tag string"
    found = accessibility.distinct_artifacts(spark.createDataFrame([(1, 10, 0, "P"), (1, 10, 0, "P")], schema), spark.createDataFrame([(1, 10, 0, "P"), (1, 11, 0, "Q"), (1, 12, 1, "P")], schema))
    return found.select("doc_id", "node", "tag", "source")


@query("SELECT * FROM (VALUES (1, 5, 2), (1, 6, 0)) t(doc_id, node, widgets)")
def widgets(spark, sf_dir):
    references = spark.createDataFrame([(1, 5, 50), (1, 5, 51), (1, 5, 52), (1, 6, 52), (1, 6, 99)], "doc_id int, node int, target int")
    annotations = spark.createDataFrame([(1, 50, "Widget"), (1, 51, "Widget"), (1, 52, "Link")], "doc_id int, object int, subtype string")
    return accessibility.widget_counts(references, annotations).select("doc_id", "node", F.col("widgets").cast("int").alias("widgets"))


@query("SELECT family, count(*) AS n FROM (VALUES ('page'), ('page'), ('font'), ('font'), ('font'), ('font')) t(family) GROUP BY 1")
def family_pruning(spark, sf_dir):
    return model.only_families(_model(spark), ["page", "font"]).groupBy("family").agg(F.count("*").alias("n"))


@query("SELECT 'model' AS doc_id, '(a title)' AS value")
def model_info_value(spark, sf_dir):
    return families.info_values(documents.trailers(_files(spark, "model")), _model(spark), "Title")


@query("SELECT * FROM (VALUES (1, 'ab', false), (2, 'é', false), (3, NULL, false), (4, '😀', false), (5, NULL, true), (6, NULL, true)) t(i, text, utf8)")
def text_decoding(spark, sf_dir):
    """UTF-16 with either mark, a lone surrogate (3), a pair (4), and no mark at all."""
    raw = [(1, b"\xfe\xff\x00a\x00b"), (2, b"\xff\xfe\xe9\x00"), (3, b"\xfe\xff\xd8\x00\x00a"), (4, b"\xfe\xff\xd8\x3d\xde\x00"), (5, b"plain"), (6, None)]
    rows = spark.createDataFrame([(i, None if x is None else bytearray(x)) for i, x in raw], "i int, b binary")
    return rows.select("i", derived.utf16_text(F.col("b")).alias("text"), derived.utf8_valid(F.col("b")).alias("utf8"))


@query(
    "SELECT * FROM (VALUES (1, true, true, 'ICCBased', NULL, 9), (2, false, false, 'DeviceRGB', 3, NULL), (3, false, true, 'Indexed', NULL, NULL), (4, true, false, NULL, NULL, NULL), (5, false, false, 'DeviceN', NULL, NULL)) t(i, alt, glyphs, family, n, target)"
)
def scalar_checks(spark, sf_dir):
    schema = "i int, alt array<string>, embedded boolean, widths int, value string, keys array<string>"
    data = [(1, ["en", "text"], True, None, "[/ICCBased 9 0 R]", None), (2, ["en"], None, 0, "/DeviceRGB", None), (3, ["en", ""], False, 4, "[ /Indexed /DeviceRGB 1 <00> ]", None), (4, [], None, None, "12", None), (5, None, None, None, "<< /TintTransform 1 0 R >>", ["TintTransform", "Colorants"])]
    rows = spark.createDataFrame(data, schema)
    space = derived.normalized_color_space(F.col("value"), F.col("keys"))
    none = F.lit(None).cast("boolean")
    return rows.select("i", derived.media_alt_valid(F.col("alt")).alias("alt"), derived.glyph_evidence(F.col("embedded"), none, F.col("widths"), none).alias("glyphs"), space["family"].alias("family"), space["n"].alias("n"), space["target"].cast("int").alias("target"))


@query("SELECT * FROM (VALUES (1, 'x', 'fixed-a.pdf'), (2, NULL, NULL), (3, 'W5M0', 'fixed-b.pdf')) t(i, id, output)")
def packet_and_output(spark, sf_dir):
    data = [(1, "<?xpacket begin='' id='x'?>", "/in/a.pdf"), (2, "<x/>", "/in/"), (3, '<?xpacket begin="" id="W5M0"?>', "b.pdf")]
    rows = spark.createDataFrame(data, "i int, packet string, path string")
    return rows.select("i", derived.packet_attribute(F.col("packet"), "id").alias("id"), derived.repair_output_name(F.col("path"), F.lit("fixed-")).alias("output"))


def plain(value):
    return repr(value)


@pytest.mark.parametrize("name", sorted(CASES))
def test_rows(spark, name):
    made, sql = CASES[name]
    frame, relation = made(spark, None), duckdb.sql(sql)
    columns = sorted(frame.columns)
    assert columns == sorted(relation.columns)
    place = [relation.columns.index(k) for k in columns]
    assert sorted(tuple(plain(r[k]) for k in columns) for r in frame.collect()) == sorted(tuple(plain(r[i]) for i in place) for r in relation.fetchall())
