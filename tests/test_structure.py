import json

from pyspark.sql import functions as F

from quillspark.operators import hierarchy, structure


def test_tables_from_one_scan(spark):
    values = {
        1: {"S": "/Document", "Pg": "9 0 R", "K": ["2 0 R", "3 0 R"]}, 2: {"S": "/P", "P": "1 0 R", "K": 4}, 3: {"S": "/Artifact", "P": "1 0 R", "K": [{"Type": "/MCR", "MCID": 5, "Pg": "8 0 R"}, {"Type": "/OBJR", "Obj": "30 0 R"}, {"Type": "/MCR"}, -1, {"Type": "/OBJR"}, "(x)", None, 1.5]},
        4: {"P": "3 0 R", "K": []}, 5: [1], 6: {"S": "/P", "K": list(range(7))}, 7: {"S": "/Inner", "X": {"S": "/No", "K": 3}},
    }
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = spark.createDataFrame([(1, n, json.dumps(v)) for n, v in values.items()] + [(1, 8, None)], "doc_id int, node bigint, j string").mapInPandas(counted, "doc_id int, node bigint, j string")
    made = structure.structure_tables(rows.select("doc_id", "node", F.try_parse_json("j").alias("value")), most_kids=6)
    got = {name: sorted((tuple(r)[1:] for r in getattr(made, name).collect()), key=str) for name in ("nodes", "children", "content", "references", "artifacts", "warnings")}
    assert seen.value == 8  # one scan for all of them
    assert got["nodes"] == [(1, None, "Document", 9), (2, 1, "P", None), (3, 1, "Artifact", None), (4, 3, None, None), (6, None, "P", None), (7, None, "Inner", None)]
    assert got["children"] == [(1, 0, 2), (1, 1, 3)] and got["references"] == [(3, 1, None, 30)] and got["artifacts"] == [(3, None, "Artifact")]
    assert got["content"] == sorted([(2, 0, None, 4), (3, 0, 8, 5)] + [(6, i, None, i) for i in range(6)], key=str)
    assert set(got["warnings"]) == {(3, 2, "bad content number"), (3, 3, "bad content number"), (3, 4, "reference without an object"), (3, 5, "unknown kid"), (4, None, "missing role"), (5, None, "not a dictionary"), (6, None, "kid cap reached"), (3, None, "kid cap reached"), (8, None, "not a dictionary")}
    assert made.metrics == {"node": 6, "child": 2, "content": 8, "reference": 1, "artifact": 1, "warning": 9}
    assert {(r.node, r.mcid): r.page for r in structure.paged_content(made).collect() if r.node != 6} == {(2, 4): 9, (3, 5): 8}
    none = structure.structure_tables(rows.filter("node > 99").select("doc_id", "node", F.try_parse_json("j").alias("value")))
    assert none.nodes.count() == none.warnings.count() == 0 and none.metrics["node"] == 0


def test_inherited_values_in_chains_and_cycles(spark):
    chain = [(1, i, i - 1 if i else None, "top" if i == 0 else "mid" if i == 70 else None) for i in range(120)] + [(2, 1, 2, None), (2, 2, 1, None), (3, 5, 99, None), (3, 6, 5, "x")]
    nodes = spark.createDataFrame(chain, "doc_id int, node bigint, parent bigint, v string")
    got = {(r.doc_id, r.node): r.up for r in hierarchy.inherited(nodes, "v", "up").collect()}
    assert all(got[1, i] == ("top" if i < 70 else "mid") for i in range(120)) and got[2, 1] is got[2, 2] is got[3, 5] is None and got[3, 6] == "x"
    above = {(r.doc_id, r.node): r.up for r in hierarchy.nearest_value(nodes, None, "v", "up", own=False).collect()}
    assert above[1, 0] is None and above[1, 70] == "top" and above[1, 71] == "mid" and above[3, 6] is None


def test_layers_of_attributes(spark):
    elements = spark.createDataFrame(
        [(1, 1, {"a": "own", "n": None}, ["x", "y", "x"]), (1, 2, None, ["y", "gone", None]), (1, 3, {"a": "z"}, None), (2, 1, None, ["x"]), (1, 4, {}, []), (1, 5, None, ["two"])], "doc_id int, node int, attributes map<string,string>, classes array<string>"
    )
    classes = spark.createDataFrame([(1, "x", {"a": "xa", "b": "xb"}), (1, "y", {"b": "yb", "n": "yn"}), (1, "two", {"t": "p"}), (1, "two", {"t": "q", "u": None}), (1, "empty", None)], "doc_id int, class string, attributes map<string,string>")
    got = {(r.doc_id, r.node, r.name): (r.value, r.layer) for r in structure.layered_attributes(elements, classes).collect()}
    assert got == {(1, 1, "a"): ("own", 3), (1, 1, "b"): ("xb", 2), (1, 1, "n"): ("yn", 1), (1, 2, "b"): ("yb", 0), (1, 2, "n"): ("yn", 0), (1, 3, "a"): ("z", 0), (1, 5, "t"): ("q", 0)}
    assert {tuple(r) for r in structure.unresolved_classes(elements, classes).collect()} == {(1, 2, "gone"), (2, 1, "x")}
    assert structure.layered_attributes(elements.limit(0), classes).count() == 0
