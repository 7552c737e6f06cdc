"""Small tables whose rows grow: they are dealt over tasks, and what a task can tell is not shuffled."""

import duckdb
import pytest

from quillspark.operators import families, model
from quillspark.plans import corpus, graph
from quillspark.shared import spread, tasks_for
from quillspark.sources import documents


@pytest.fixture(scope="module")
def small_tables(tmp_path_factory):
    """A folder with 5,000 parts and customers in one file each."""
    path = tmp_path_factory.mktemp("spread")
    sizes = {"part": "SELECT range AS p_partkey, 'n' AS p_name, 't' AS p_type, (range % 50)::INT AS p_size", "customer": "SELECT range AS c_custkey, 'n' AS c_name, (range % 25)::INT AS c_nationkey, 's' AS c_mktsegment"}
    for name, columns in sizes.items():
        duckdb.connect().sql(f"COPY ({columns} FROM range(5000)) TO '{path}/{name}.parquet'")
    return str(path)


@pytest.mark.parametrize("made", [corpus._files, corpus._resource_files])
def test_files_are_made_in_several_tasks(spark, small_tables, made):
    files = made(spark, small_tables).select("doc_id")
    assert files.count() == 5000 and files.rdd.getNumPartitions() == 3


def test_spread(spark):
    rows = spark.range(100)
    assert [spread(rows.filter(f"id < {n}"), 10).rdd.getNumPartitions() for n in (0, 9, 21)] == [1, 1, 3]
    assert spread(rows, 7).distinct().count() == 100


def test_objects_are_not_shuffled(spark):
    body = b"".join(b"%d 0 obj\n(%d)\nendobj\n" % (n % 5 + 1, n) for n in range(50))
    rows = documents.objects(documents.from_memory(spark, {"x": body, "y": b"1 0 obj\n[1]\nendobj\n"}))
    assert sorted((r.doc_id, r.number, r.body.strip()) for r in rows.collect()) == [*(("x", n + 1, f"({45 + n})") for n in range(5)), ("y", 1, "[1]")]
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_remembered_bodies(spark):
    """Equal bodies are equal values, whether they are remembered or too long for that."""
    long = b"<< /Length 3 /T (" + b"x" * documents.REMEMBERED_BYTES + b") >>"
    body = b"".join(b"%d 0 obj\n%s\nstream\nabc\nendstream\nendobj\n" % (n, x) for n, x in enumerate([long, long, b"<< /Length 3 /N /A#42 >>", b"<< /Length 3 /N /A#42 >>"], 1))
    rows = documents.objects(documents.from_memory(spark, {"x": body})).collect()
    assert [(r.declared_length, bytes(r.data)) for r in rows] == [(3, b"abc")] * 4 and len({r.json for r in rows}) == 2 and any('"/AB"' in r.json for r in rows)


@pytest.mark.parametrize("asked", [documents.scanned, documents.trailers, documents.xref_facts])
def test_files_are_not_made_before_they_are_dealt(spark, small_tables, asked):
    """No filter on contents goes below the exchange, where one task reads the table; a file without contents has no rows all the same."""
    plan = asked(corpus._files(spark, small_tables))._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan and "Filter" not in plan[plan.index("Repartition") :]
    files = documents.from_memory(spark, {"x": b"1 0 obj 7 endobj xref\n0 1\n0 f\ntrailer << /Root 1 0 R >>", "y": b""}).selectExpr("doc_id", "bytes", "IF(doc_id = 'x', content, NULL) AS content", "doc_id = 'y' AS too_large")
    assert [r.doc_id for r in asked(files).collect()] == ["x"]


def test_remembered_objects_end_where_others_do(spark, monkeypatch):
    """A piece of a file tells its object only where no byte behind the piece could change it."""
    heads = [b"1 0 obj ", b"junk 1 0 obj\n<< /Length 3 >>\nstream\n", b"1 0 obj << /Length 900 >> stream\n", b"1 0 obj << /L 3 >> % >\n stream\n", b"% 1 0 obj\n"]
    bodies = [b"7 ", b"(a) ", b"(endobj ", b"( (a) ", b"% endobj\n", b"abc\nendstream ", b"xendobj ", b"streams ", b">> stream\r\n", b"\\) "]
    contents = [head + body + other + end + b"\n2 0 obj\n8) endobj\n" for head in heads for body in bodies for other in (b"", *bodies) for end in (b"endobj", b"endobjx", b"endstream\nendobj")]
    short = [documents._last_objects(c) for c in contents]
    assert documents._remembered_object(b"1 0 obj 7 endobj\n") and documents._remembered_object(b"1 0 obj (7 endobj\n") is None and documents._remembered_object(b" endobj\n") == ()
    monkeypatch.setattr(documents, "REMEMBERED_BYTES", -1)
    assert short == [documents._last_objects(c) for c in contents] and sum(map(len, short)) > len(contents)


def test_the_scan_tells_types(spark):
    """Names are told by the scan; numbers, escapes beyond printable letters and texts are left to the nested value, which is not read for the others."""
    bodies = ["<< /Type /Page /Subtype /Q#2fR >>", "<< /Type 1.50 /Subtype 5 >>", "<< /Type /A#20B >>", "<< /Type (a) /Subtype true >>", "<< >>", "true", "[ /Type ]", "12 ", "<< /Type null /Subtype /Link >>"]
    told = [documents._read_body(b.encode())[2:6] for b in bodies]
    assert told == [("dictionary", "Page", "Q/R", True), ("dictionary", None, None, False), ("dictionary", None, None, False), ("dictionary", None, None, False), ("dictionary", None, None, True), (None, None, None, True), ("array", None, None, True), (None, None, None, True), ("dictionary", None, "Link", True)]
    content = "".join(f"{n} 0 obj {b} endobj\n" for n, b in enumerate(bodies, 1)).encode()
    rows = documents.objects(documents.from_memory(spark, {"x": content})).orderBy("number").collect()
    assert [(r.kind, r.type, r.subtype) for r in rows] == [("dictionary", "Page", "Q/R"), ("dictionary", "1.5", "5"), ("dictionary", "A B", None), *[("dictionary", None, None)] * 2, ("boolean", None, None), ("array", None, None), ("integer", None, None), ("dictionary", None, "Link")]


def test_a_catalog_is_looked_up_without_distinct_keys(spark):
    plan = documents.parse_status(documents.from_memory(spark, {"x": b"%PDF-1.4 1 0 obj << /Type /Catalog >> endobj 1 0 obj << /Type /Catalog >> endobj trailer << /Root 1 0 R >>"}))
    assert [r.status for r in plan.collect()] == ["success"] and "LeftSemi" in plan._jdf.queryExecution().optimizedPlan().toString()


def test_trees_of_values_are_made_in_several_tasks(spark, small_tables, monkeypatch):
    monkeypatch.setattr(graph, "VALUES_A_TASK", 1000)
    elements = graph._elements(spark, small_tables).select("doc_id", "node")
    assert elements.count() == 4997 and elements.rdd.getNumPartitions() == 5


def test_paths_are_opened_in_several_tasks(spark, monkeypatch):
    """A chain of 99 nodes with a resource each: every task opens ten paths or so, and each name comes from its own node."""
    monkeypatch.setattr(model, "PATHS_A_TASK", 10)
    asked = []
    monkeypatch.setattr(model, "tasks_for", lambda rows, n: asked.append(tasks_for(rows, n)) or asked[-1])
    pages = spark.range(1, 100).selectExpr("0 AS doc_id", "id AS node", "nullif(id - 1, 0) AS parent")
    found = model.effective_resources(pages, pages.selectExpr("doc_id", "node", "'font' AS family", "'F' || node AS name", "node AS object"))
    assert asked == [10] and found.count() == 99 * 100 // 2
    assert {(r.name, r.object, r.scope) for r in found.filter("node = 99").collect()} == {(f"F{n}", n, 99 - n) for n in range(1, 100)}


def test_a_dictionary_is_opened_once_for_its_links(spark):
    """Links ask for the keys that a dictionary has, in place of a branch for each family and each of its keys."""
    rows = documents.objects(documents.from_memory(spark, {"x": b"1 0 obj\n<< /Type /Page /Annots [4 0 R 7 (5 0 R) 5 0 R] /Contents 3 0 R /AA << /O 6 0 R /C 8 >> /Parent 2 0 R >>\nendobj\n2 0 obj\n[1 0 R]\nendobj\n"}))
    links = families.typed_links(families.typed(rows))
    assert [(r.link, r.ord, r.dst) for r in links.orderBy("ord").collect()] == [("Contents", 0, 3), ("Annots", 1, 4), ("Annots", 2, 5), ("AA", 3, 6)]
    assert families.typed_links(families.typed(rows), ["font"]).count() == 0 and families.typed_links(families.typed(rows), []).count() == 0
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("variant_get") < 60


def test_plain_bodies_end_where_others_do(spark):
    """The short way over plain bodies gives what the whole scan gives, whatever stands around ``endobj``."""
    ends = [b"endobj\n", b"endobj%\n", b"endobjx endobj\n", b"(endobj) endobj\n", b"%endobj\nendobj\n", b"xendobj endobj\n", b"\0endobj\n", b">>\nstream\nendobj\nendstream\nendobj\n", b"<" + b"0" * documents.REMEMBERED_BYTES + b"> endobj\n"]
    found = [documents._last_objects(b"1 0 obj\n7 " + end + b"2 0 obj\n8 endobj\n")[0][3].strip() for end in ends]
    assert found == ["7", "7", "7 endobjx", "7 (endobj)", "7 %endobj", "7 xendobj", "7 \0", "7 >>", "7 <" + "0" * documents.REMEMBERED_BYTES + ">"]


def test_reports_are_opened_in_several_tasks(spark, tmp_path, monkeypatch):
    """Distinct orders come in as few tasks as their bytes ask for; their reports are dealt over tasks by number."""
    duckdb.connect().sql(f"COPY (SELECT range AS o_orderkey, 'O' AS o_orderstatus FROM range(5000) UNION ALL SELECT 1, 'O') TO '{tmp_path}/orders.parquet'")
    monkeypatch.setattr(graph, "VALUES_A_TASK", 1000)
    given = []
    monkeypatch.setattr(graph.reports, "report_outcomes", lambda rows: given.append(rows) or rows)
    graph.report_outcomes(spark, str(tmp_path))
    assert given[0].select("id").rdd.getNumPartitions() == 6 and given[0].select("id").distinct().count() == given[0].count() == 5000


def test_resources_are_opened_in_one_join_a_level(spark, small_tables):
    """Owners and dictionaries are read once, not once for those that refer and once for those that don't."""
    plan = families.resource_entries(corpus._resource_model(spark, small_tables))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and plan.count("Relation ") == 3 and "Union" not in plan
    body = b"1 0 obj << /Type /Page /Resources 5 0 R >> endobj 2 0 obj << /Type /Page /Resources 9 0 R >> endobj 3 0 obj << /Type /Page /Resources << /Font 9 0 R /XObject << /X 3 0 R /Y 1 >> /Pattern 5 >> >> endobj 4 0 obj << /Type /Page >> endobj 5 0 obj << /Font << /F 6 0 R >> /ColorSpace 7 0 R >> endobj 7 0 obj [ 1 ] endobj"
    rows = families.typed(documents.objects(documents.from_memory(spark, {"x": body, "y": body.replace(b"5 0 obj", b"8 0 obj")})))
    found = {(r.doc_id, r.src, r.category, r.name, r.dst) for r in families.resource_entries(rows).collect()}
    assert found == {("x", 1, "Font", "F", 6), *((doc, 3, "XObject", name, dst) for doc in "xy" for name, dst in (("X", 3), ("Y", None)))}


def test_values_are_read_behind_joins(spark, small_tables):
    """What a reference leads to is read for the objects that are referred to, not for all before they are joined."""
    rows = corpus._model(spark, small_tables)
    last = spark.createDataFrame([("1", 0, 40), ("2", 0, 99)], "doc_id string, pos int, info long")
    found = families.info_values(last, rows, "Title")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "parseJson" in plan[: plan.index("Join")] and "parseJson" not in plan[plan.index("Join") :]
    assert [tuple(r) for r in found.collect()] == [("1", "(n)")]


def test_a_status_asks_rows_that_tell_roots(spark):
    """The scan keeps what may tell a catalog, trailers among it, so that no second one looks for trailers and no other object is joined."""
    objects = b"%PDF-1.4\n" + b"".join(b"%d 0 obj << /Root 1 0 R >> endobj\n" % n for n in range(1, 30))
    cross = b"40 0 obj << /Type /XRef /Root 3 0 R >>\nstream\nx\nendstream endobj "
    deep = b"trailer << /Root 2 0 R /X " + b"[" * 300 + b">>"
    assert [row[1] for row in documents._naming_roots(objects + cross + b"trailer << /Root 2 0 R >> trailer << /Root (4 0 R) >>")] == [-1, -1, 2, 3, 40]
    assert [row[1] for row in documents._naming_roots(objects + cross + deep)] == [3, 40]
    asked = {"classic": objects + b"trailer << /Root 2 0 R >>", "gone": objects + b"trailer << /Root 2 0 R >> trailer << /Root 77 0 R >>", "cross": objects + cross, "deep": objects + cross + deep, "none": objects + deep, "no header": objects[9:] + cross}
    status = documents.parse_status(documents.from_memory(spark, asked))
    assert {r.doc_id: r.status for r in status.collect()} == {"classic": "success", "gone": "parseFailed", "cross": "success", "deep": "success", "none": "parseFailed", "no header": "parseFailed"}
    assert status._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
