import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions import filters
from quillspark.operators import accessibility, families, hierarchy, isolation, metadata, model, profiles, reports, rules, structure
from quillspark.sources import documents
from quillspark.sources import documents as d


def test_trees_of_names(spark):
    nodes = spark.createDataFrame([(1, 1, None), (1, 2, 1), (1, 9, None)], "doc_id int, node bigint, parent bigint")
    entries = spark.createDataFrame([(1, 2, 0, "a", "x"), (1, 2, 1, "a", "y"), (1, 9, 0, "a", "z"), (1, 7, 0, "b", "lost")], "doc_id int, node bigint, seq int, key string, value string")
    roots = spark.createDataFrame([(1, 1)], "doc_id int, root bigint")
    assert [tuple(r) for r in model.tree_entries(nodes, entries, roots).collect()] == [(1, 1, "a", "y")]


def test_links_and_budget(spark):
    links = spark.createDataFrame([(1, "a", "x", 2), (1, "a", "y", 1), (1, "b", "x", 0), (1, "b", "none", 0)], "doc_id int, src string, dst string, ord int")
    objects = spark.createDataFrame([(1, "x", "f", 5), (1, "y", "f", None), (1, "z", "g", 1)], "doc_id int, identity_key string, family string, v int")
    got = {r.src: (r.n, r.scalar) for r in model.linked_values(links, objects, "f", "v").collect()}
    assert got == {"a": (2, None), "b": (1, 5)}
    assert {r.src: r["values"] for r in model.link_lists(links, objects, "f", "v", 5).collect()} == {"a": [None, 5], "b": [5]}
    assert model.over_budget(objects, 2).first().objects == 3 and model.over_budget(objects, 3).isEmpty()
    assert model.only_families(objects, ["g"]).count() == 1


def test_accessibility(spark):
    marked = spark.createDataFrame([(1, 0, 1, 5), (1, 0, 2, 5), (1, 0, 3, 5), (1, 0, 4, None)], "doc_id int, page int, mcid int, struct_key int")
    key = "doc_id int, page int, mcid int, node int"
    got = accessibility.content_nodes(marked, spark.createDataFrame([(1, 0, 1, 10)], key), spark.createDataFrame([(1, 0, 1, 11), (1, 0, 2, 12)], key), spark.createDataFrame([(1, 5, 3, 13)], "doc_id int, struct_key int, mcid int, node int"))
    assert {r.mcid: r.node for r in got.collect()} == {1: 10, 2: 12, 3: 13, 4: None}
    owners = spark.createDataFrame([(1, 3, 0, "page"), (1, 3, 1, "annotation")], "doc_id int, struct_parent int, seq int, owner string")
    assert accessibility.owned_objects(spark.createDataFrame([(1, 3), (1, 4)], "doc_id int, struct_parent int"), owners).filter("struct_parent = 3").first().owner == "annotation"
    nodes = spark.createDataFrame([(1, 1, None, "Link"), (1, 2, 1, "Span"), (1, 3, None, "P")], "doc_id int, node bigint, parent bigint, role string")
    annotations = spark.createDataFrame([(1, 2, "Link", "o2"), (1, 3, "Link", "o3"), (1, None, "Link", "o4"), (1, 3, "Widget", "o5")], "doc_id int, node bigint, subtype string, object string")
    assert [r.object for r in accessibility.misplaced_links(annotations, nodes, hierarchy.ancestor_paths(nodes)).collect()] == ["o3"]
    references = spark.createDataFrame([(1, 3, "o5"), (1, 3, "o3"), (1, 1, None)], "doc_id int, node bigint, target string")
    assert {r.node: r.widgets for r in accessibility.widget_counts(references, annotations).collect()} == {3: 1, 1: 0}
    artifacts = spark.createDataFrame([(1, 1, 0, "Artifact")], "doc_id int, node int, page int, tag string")
    assert [r.source for r in accessibility.distinct_artifacts(artifacts, artifacts).collect()] == [0]


def test_metadata(spark):
    titles = spark.createDataFrame([(1, "x-default", "T"), (1, "de", " "), (2, "de", "T"), (3, "x-default", "a"), (3, "de", "b")], "doc_id int, lang string, value string")
    assert {r.doc_id: r.title_ok for r in metadata.one_default_title(titles).collect()} == {1: True, 2: False, 3: False}
    facts = spark.createDataFrame([(1, "PacketParsed"), (2, "PacketParsed"), (2, "Hostile"), (3, "Other")], "doc_id int, kind string")
    assert {r.doc_id: r.serialization_valid for r in metadata.packet_valid(facts).collect()} == {1: True, 2: False, 3: False}
    assert metadata.spacing_complies(spark.createDataFrame([(1, None)], "doc_id int, bad_spacing boolean")).first().spacing_complies
    used = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (1, "b")], "doc_id int, namespace string")
    lost = metadata.undefined_fields(used, spark.createDataFrame([("a",)], "namespace string"), spark.createDataFrame([(1, "c")], "doc_id int, namespace string"))
    assert lost.first().undefined == "b"
    names = spark.createDataFrame([("auto",), ("pdfa-2b",), ("pdfua-1",), ("wtpdf-1-0-reuse",), ("pdfa-9",)], "t string")
    assert [tuple(r.f)[:2] if r.f else None for r in names.select(metadata.flavour(F.col("t")).alias("f")).collect()] == [("auto", None), ("pdfa", 2), ("pdfua", 1), ("wtpdf", 1), None]


@pytest.mark.parametrize(("predictor", "raw", "want"), [(1, b"abc", b"abc"), (12, bytes([0, 1, 2, 2, 1, 1]), bytes([1, 2, 2, 3])), (11, bytes([1, 1, 1, 1, 1, 1]), bytes([1, 2, 1, 2])), (2, bytes([1, 1, 5, 1]), bytes([1, 2, 5, 6])), (15, bytes([3, 2, 2, 4, 1, 1]), bytes([2, 3, 3, 4])), (10, bytes([9, 0, 0]), None)])
def test_predictors(predictor, raw, want):
    assert filters.unpredicted(raw, predictor, 1, 8, 2 if predictor != 1 else 3) == want


def test_xref_facts(spark):
    good = b"xref\n0 1\n0000000000 65535 f \ntrailer << /Prev 12 >>"
    files = d.from_memory(spark, {"good": good, "bad": b"xref\n0 1\n0 f\ntrailer << /XRefStm 7 >>"})
    assert {(r.doc_id, r.kind, r.value) for r in d.xref_facts(files).collect()} == {("good", "EolMarkersComply", None), ("good", "PrevOffset", 12), ("bad", "MalformedClassic", None), ("bad", "HybridOffset", 7)}


def dictionary(spark, *texts):
    """The objects of one file for each text, the text being object 1's."""
    files = {str(i): b"%PDF-1.7\n1 0 obj\n" + t.encode("latin-1") + b"\nendobj\n" for i, t in enumerate(texts)}
    return documents.objects(documents.from_memory(spark, files))


def test_own_keys_are_not_those_of_inner_values_or_strings(spark):
    texts = [
        "<< /Inner << /Type /Page >> /Type /Catalog >>", "<< /T (a (b) /Pages 9 0 R) /Pages 2 0 R >>", "<< /D [[1 2] /X 7 0 R] /Type /Action >>", "<< /A << /B << /C << /D << /E 1 0 R >> >> >> >> /B 3 0 R >>", "<< /Ty#70e /Font /S (\\) /Type /Page) >>",
        "<< /Group << /Type /Group /S /Transparency >> /Type /Page /Rect [0 .5 -1. +2] >>", "<< /S (open", "<< /A 1 /A 2 /Odd >>", "<</Type/Catalog/U<</V/W>>/Z true/N null>>",
    ]
    rows = families.typed(dictionary(spark, *texts))
    got = {int(r.doc_id): r for r in rows.select("doc_id", "type", "family", "keys", "json").collect()}
    assert [got[i].type for i in (0, 2, 4, 5, 8)] == ["Catalog", "Action", "Font", "Page", "Catalog"] and got[0].family == "catalog" and got[5].family == "page"
    assert sorted(got[3].keys) == ["A", "B"] and sorted(got[2].keys) == ["D", "Type"] and sorted(got[8].keys) == ["N", "Type", "U", "Z"]
    assert json.loads(got[5].json)["Rect"] == [0, 0.5, -1.0, 2] and json.loads(got[6].json)["S"].startswith("(open") and json.loads(got[7].json) == {"A": 2}
    refs = {(r.doc_id, r.key, r.target) for r in documents.references(rows).collect()}
    assert refs == {("1", "Pages", 2), ("3", "B", 3)}


def test_deep_and_large_values(spark):
    deep = "<< /A " * 200 + "1" + " >>" * 200
    large = "<< " + " ".join(f"/K{i} ({i} \\) x) /R{i} {i} 0 R" for i in range(4000)) + " >>"
    rows = families.typed(dictionary(spark, deep, large)).select("doc_id", F.size("keys").alias("n"), "json").collect()
    assert {r.doc_id: r.n for r in rows} == {"0": 1, "1": 8000} and rows[0].json is not None


def test_an_odd_number_or_depth_fails_its_file_only(spark):
    good = b"%PDF-1.7\n1 0 obj\n<< /Type /Catalog >>\nendobj\ntrailer\n<< /X << /Y 1 >> /Root 1 0 R /Z 5 >>\n"
    deep = b"%PDF-1.7\n1 0 obj\n" + b"[" * 300 + b"\nendobj\ntrailer << /Root 1 0 R >>"
    length = good.replace(b"trailer", b"2 0 obj\n<< /Length 123456789012345678901234567890 >>\nstream\nabc\nendstream\nendobj\ntrailer")
    prev = good + b"xref\ntrailer << /Prev 1234567890123456789012345 /Root 1 0 R >>"
    index = good.replace(b"trailer", b"3 0 obj\n<< /Type /XRef /Size 99999999999999999999999 /W [1 2 1] /Index [0 99999999999999999999999] /Length 1 >>\nstream\nx\nendstream\nendobj\ntrailer")
    files = documents.from_memory(spark, {"good": good, "deep": deep, "length": length, "prev": prev, "index": index, "none": b""})
    got = {r.doc_id: r.status for r in documents.parse_status(files).collect()}
    assert got == {"good": "success", "deep": "internal", "length": "success", "prev": "success", "index": "success", "none": "parseFailed"}
    assert {(r.doc_id, r.value) for r in documents.xref_facts(files).filter("kind = 'PrevOffset'").collect()} == {("prev", None)}
    assert documents.xref_streams(documents.objects(files)).filter("doc_id = 'index' AND malformed").count() == 1
    assert [r.error for r in documents.failures(files).collect()] == ["ValueError: values nested too deeply"]
    assert documents.trailers(files).filter("doc_id = 'good'").first().root == 1


def test_failing_rows_are_rows(spark):
    def half(i, text):
        yield (i // 2, text)
        if i % 100 == 7:
            raise ValueError(f"row {i}")
        if i == 950:
            yield (2**63, "large")

    rows = spark.createDataFrame([(i, i, None if i % 3 else "x") for i in range(1000)], "id int, i int, text string")
    got = isolation.map_isolated(rows, "id", ["i", "text"], half, "half long, text string").cache()
    assert isolation.good_rows(got).count() == 989 and got.count() == 1000
    failed = isolation.failed_rows(got, "id")
    assert {(r.id, r.error, r.status) for r in failed.collect()} == {(i, f"ValueError: row {i}", "internal") for i in range(7, 1000, 100)} | {(950, "OverflowError: half is out of range", "internal")}
    statuses = isolation.good_rows(got).select("id", F.lit("valid").alias("status")).unionByName(failed.select("id", "status"))
    summary = rules.batch_summary(statuses).first()
    assert (summary.valid, summary.internal_errors, summary.exit_code, summary.category) == (989, 11, 70, "processingFailed")
    assert isolation.map_isolated(rows.limit(0), "id", ["i", "text"], half, "half long, text string").count() == 0


def test_families_and_links_of_nothing(spark):
    empty = documents.objects(documents.from_memory(spark, {"x": b""}))
    rows = families.typed(empty)
    assert rows.count() == 0 and families.typed_links(rows).count() == 0 and families.page_fonts(rows).count() == 0 and families.appearance_types(rows).count() == 0
    assert families.link_schema(spark).filter("family = 'catalog'").count() == 9


def numbered(spark, bodies):
    """The typed objects of one file with these bodies by number."""
    content = b"%PDF-1.7\n" + b"".join(f"{n} 0 obj\n{b}\nendobj\n".encode("latin-1") for n, b in bodies.items())
    return families.typed(documents.objects(documents.from_memory(spark, {"d": content}))).cache()


def test_resources_in_place_by_reference_and_inherited(spark):
    rows = numbered(spark, {
        1: "<< /Type /Pages /Kids [2 0 R 3 0 R 4 0 R] /Resources 9 0 R >>", 2: "<< /Type /Page /Parent 1 0 R /Resources << /Font << /A 20 0 R /B (x) /C null >> /XObject [5 0 R] /Junk << /Z 1 0 R >> >> >>",
        3: "<< /Type /Page /Parent 1 0 R /Resources 77 0 R >>", 4: "<< /Type /Page /Parent 1 0 R /Resources << /Font 10 0 R /Shading 78 0 R >> >>", 9: "<< /Font << /A 21 0 R /D 22 0 R >> /Properties << >> >>", 10: "<< /A 23 0 R >>",
    })
    own = {(r.src, r.category, r.name): r.dst for r in families.resource_entries(rows).collect()}
    assert own == {(2, "Font", "A"): 20, (2, "Font", "B"): None, (2, "Font", "C"): None, (1, "Font", "A"): 21, (1, "Font", "D"): 22, (4, "Font", "A"): 23}
    seen = {(r.node, r.name): r.object for r in families.page_resources(rows).collect()}
    assert seen == {(2, "A"): 20, (2, "D"): 22, (3, "A"): 21, (3, "D"): 22, (4, "A"): 23, (4, "D"): 22}


def test_fonts_profiles_and_content_of_odd_objects(spark):
    stream = "<< {} /Length 3 >>\nstream\nabc\nendstream"
    rows = numbered(spark, {
        1: "<< /Type /Font /BaseFont (text) /Widths [1.5 2] /ToUnicode /Identity-H >>", 2: "<< /Type /Font /FontDescriptor 99 0 R /DW 7 /Widths [5] /ToUnicode 5 0 R >>", 3: "<< /Type /Font /ToUnicode (abcd) >>", 4: "<< /Type /Font /ToUnicode 6 0 R >>",
        5: stream.format(""), 6: stream.format("/Filter /Unknown"), 7: "<< /Type /OutputIntent /DestOutputProfile 5 0 R >>", 8: "<< /Type /OutputIntent /DestOutputProfile 5 0 R >>", 10: "<< /Type /Page /Contents [5 0 R 1 0 R 98 0 R] >>", 11: stream.format("/Subtype /Form"), 12: "<< /Subtype /Form >>",
        13: "<< /Inner << /TintTransform 1 0 R >> >>", 14: "<< /TintTransform [1 0 R] >>",
    })
    got = {r.number: (r.name, r.width, r.to_unicode) for r in families.font_values(rows).collect()}
    assert got == {1: (None, None, None), 2: (None, 7, "abc"), 3: (None, None, "abcd"), 4: (None, None, None)}
    assert {r.number: r.to_unicode for r in families.font_values(rows, most_bytes=3).collect()} == {1: None, 2: "abc", 3: None, 4: None}
    assert families.same_output_profile(rows).first().same is True and families.same_output_profile(rows.filter("number = 5")).first().same is True
    assert {(r.src, r.stream) for r in families.content_streams(rows).collect()} == {(10, 5), (11, 11)}
    assert [(r.number, r.alternate, r.tint) for r in families.tint_signatures(rows).collect()] == [(14, None, '["1 0 R"]')]
    assert {r.number for r in families.indirect_models(rows).collect()} == {11, 12}
    catalog = numbered(spark, {1: "<< /Type /Catalog /Names << >> /Perms (x) /Dests 7 0 R /Inner << /Outlines 8 0 R >> /AcroForm null >>"})
    assert {(r.key, r.dst) for r in families.catalog_models(catalog).collect()} == {("Names", None), ("Dests", 7)}
    direct = numbered(spark, {1: "<< /Type /OutputIntent /DestOutputProfile (x) >>", 2: "<< /Type /OutputIntent >>"})
    assert families.same_output_profile(direct).first().same is None


def test_members_of_nested_tables_and_signature_nodes(spark):
    rows = [(1, 1, None, 0, "Table"), (1, 2, 1, 1, "TR"), (1, 3, 1, 0, "TR"), (1, 4, 2, 0, "TD"), (1, 5, 4, 0, "Table"), (1, 6, 5, 0, "TH"), (1, 7, 3, 0, "Div"), (1, 8, 7, 0, "TD"), (1, 9, None, 1, "TD"), (2, 1, None, 0, None)]
    nodes = spark.createDataFrame(rows, "doc_id int, node bigint, parent bigint, ord int, role string")
    assert {(r.table, r.node): r.place for r in hierarchy.table_members(nodes).collect()} == {(1, 3): 0, (1, 8): 1, (1, 2): 2, (1, 4): 3, (5, 6): 0}
    judged = nodes.select("role", hierarchy.is_standard_role(F.col("role")).alias("s"), hierarchy.is_grouping_role(F.col("role")).alias("g")).distinct().collect()
    assert {r.role: (r.s, r.g) for r in judged} == {"Table": (True, False), "TR": (True, False), "TD": (True, False), "TH": (True, False), "Div": (True, True), None: (False, False)} and len(hierarchy.STANDARD_ROLES) == 52
    elements = [(1, 1, '{"S":"/Form","K":{"Type":"/OBJR","Obj":"7 0 R"}}'), (1, 2, '{"S":"/Form","K":{"Type":"/OBJR","Obj":"8 0 R"}}'), (1, 3, '{"S":"/P","K":{"Type":"/OBJR","Obj":"7 0 R"}}')]
    tables = structure.structure_tables(spark.createDataFrame(elements, "doc_id int, node bigint, j string").select("doc_id", "node", F.try_parse_json("j").alias("value")))
    fields = spark.createDataFrame([(1, 7, '{"FT":"/Sig"}'), (1, 8, '{"V":{"FT":"/Sig"}}')], "doc_id int, number bigint, j string").select("doc_id", "number", F.try_parse_json("j").alias("value"))
    assert [r.node for r in structure.signature_nodes(tables, fields).collect()] == [1]


def slow_outcome(text, code):
    def find(value, key, test):
        inner = []
        if isinstance(value, dict):
            if key in value and test(value[key]):
                return [value[key]]
            inner = [value[k] for k in sorted(value)]
        elif isinstance(value, list):
            inner = value
        return next((x for x in (find(v, key, test) for v in inner) if x), [])

    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and v > 0
    try:
        value = json.loads(text)
    except (TypeError, ValueError):
        value = None
    if find(value, "failedToParse", number):
        return "parseFailed"
    if find(value, "encrypted", number):
        return "encrypted"
    compliant = find(value, "isCompliant", lambda v: isinstance(v, bool))
    return ("valid" if compliant[0] else "invalid") if compliant else {0: "valid", 1: "invalid", 7: "parseFailed"}.get(code)


def test_outcomes_of_reports(spark):
    t, f = '"isCompliant":true', '"isCompliant":false'
    texts = [
        None, "", "no", "3", "[]", "{}", f"{{{t}}}", f'{{"b":{{{t}}},"a":[{{"x":1}},{{"y":{{{f}}}}}]}}', f'{{"a":{{{f}}},{t}}}', f'{{"isCompliant":"yes","z":{{{f}}}}}', f'[{",".join(["{}"] * 11)},{{{f}}},{{{t}}}]', '{"a":{"encrypted":1.5},"failedToParse":0}', f'{{"x":[{{"failedToParse":2}}],"encrypted":1,{t}}}',
        f'{{"encrypted":true,"failedToParse":"5",{f}}}', f'{{"isCompliant":{{{t}}}}}', f'{{"isCompliant":{{"isCompliant":null}},"a":{{"b":{{{f}}}}},"b":{{{t}}}}}',
    ]
    rows = [(i * 10 + c, x, c) for i, x in enumerate(texts) for c in (0, 1, 5, 7)]
    got = {r.id: r.outcome for r in reports.report_outcomes(spark.createDataFrame(rows, "id int, json string, exit_code int")).collect()}
    assert got == {i: slow_outcome(x, c) for i, x, c in rows}
    assert reports.report_outcomes(spark.createDataFrame([], "id int, json string, exit_code int")).count() == 0


def test_detection_of_profiles(spark):
    docs = spark.createDataFrame([(i,) for i in range(5)], "doc_id int")
    claims = spark.createDataFrame([(0, 0, "pdfa", 2, "b"), (0, 1, "pdfua", 1, None), (1, 0, "pdfua", 2, None), (1, 1, "pdfa", 2, "b"), (2, 0, "pdfa", 9, "b"), (3, 0, "pdfa", 9, "b"), (3, 1, "pdfua", 1, "")], "doc_id int, ordinal int, family string, part int, conformance string")
    catalogue = spark.createDataFrame([("pdfa", 2, "b", "A2b"), ("pdfua", 1, "", "U1"), ("pdfua", 2, None, "U2")], "family string, part int, conformance string, profile_id string")
    got = {(r.doc_id, r.ordinal): (r.profile_id, r.outcome) for r in profiles.detect_profiles(docs, claims, catalogue).collect()}
    assert got == {
        (0, 0): ("A2b", "selected"), (0, 1): ("U1", "selected"), (1, 0): ("U2", "selected"), (1, 1): (None, "incompatible"), (2, 0): (None, "unsupported"), (2, None): (None, "none"),
        (3, 0): (None, "unsupported"), (3, 1): ("U1", "selected"), (4, None): (None, "none"),
    }
    assert profiles.detect_profiles(docs, claims.limit(0), catalogue, "A2b").filter("outcome = 'fallback' AND profile_id = 'A2b'").count() == 5
