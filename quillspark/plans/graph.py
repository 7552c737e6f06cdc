"""Queries over graphs and nested values of the driver's tables: visit order, reach, paths, VARIANT, isolation, scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import checked, nested
from quillspark.operators import graphs, hierarchy, isolation, reports, scopes, structure
from quillspark.plans.registry import query, table
from quillspark.shared import spread, tasks_for

#: Rows of a table that one task makes trees of values of.
VALUES_A_TASK = 20_000

# Trees of parts: node k hangs on k // 3; every tenth node of a document is a root of its own.

_NODES = "n AS (SELECT p_partkey % 5 AS doc_id, p_partkey // 5 AS node, CASE WHEN p_partkey // 5 % 10 <> 0 THEN p_partkey // 5 // 3 END AS parent, p_size AS ord FROM part)"
_ORDERED = f"""WITH RECURSIVE {_NODES}, placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, parent ORDER BY ord, node) AS place FROM n),
t AS (SELECT doc_id, node, [place] AS key, 0 AS depth FROM placed WHERE parent IS NULL UNION ALL SELECT p.doc_id, p.node, list_append(t.key, p.place), t.depth + 1 FROM placed p JOIN t ON t.doc_id = p.doc_id AND t.node = p.parent),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY key) - 1 AS pre FROM t)
"""


def _forest(spark, sf_dir: str) -> DataFrame:
    place = F.floor(F.col("p_partkey") / 5).cast("bigint")
    return table(spark, sf_dir, "part").select((F.col("p_partkey") % 5).alias("doc_id"), place.alias("node"), F.when(place % 10 != 0, F.floor(place / 3).cast("bigint")).alias("parent"), F.col("p_size").alias("ord"))


@query(_ORDERED + "SELECT a.doc_id, a.node, a.pre, a.depth::BIGINT AS depth, a.pre + (SELECT count(*) FROM o b WHERE b.doc_id = a.doc_id AND b.key[1:len(a.key)] = a.key) - 1 AS last FROM o a")
def visit_order(spark, sf_dir):
    return graphs.visit_order(_forest(spark, sf_dir))[0]


@query(_ORDERED + "SELECT doc_id, node, 'depthCap' AS kind FROM o WHERE depth > 2 AND pre < 30 UNION ALL SELECT doc_id, node, 'nodeCap' FROM o WHERE pre >= 30")
def visit_warnings(spark, sf_dir):
    return graphs.visit_order(_forest(spark, sf_dir), most_nodes=30, most_depth=2)[1]


@query(
    """WITH RECURSIVE l AS (SELECT DISTINCT l_linenumber % 2 AS doc_id, l_suppkey AS src, (l_suppkey + l_partkey * 31) % (SELECT count(*) FROM supplier) AS dst FROM lineitem WHERE l_quantity < 2),
w AS (SELECT d AS doc_id, s_suppkey AS node, 0 AS steps FROM supplier, range(0, 2) r(d) WHERE s_suppkey % 40 = 1 UNION SELECT w.doc_id, l.dst, w.steps + 1 FROM w JOIN l ON l.doc_id = w.doc_id AND l.src = w.node WHERE w.steps < 12)
SELECT doc_id, node, min(steps) AS steps, false AS truncated FROM w GROUP BY doc_id, node"""
)
def reachable_objects(spark, sf_dir):
    return graphs.reachable(*_links(spark, sf_dir))


def _links(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Links among suppliers in two documents, with cycles, and every fortieth supplier as a root of both."""
    supplier = table(spark, sf_dir, "supplier")
    n, key = supplier.count(), F.col("l_suppkey")
    links = table(spark, sf_dir, "lineitem").filter("l_quantity < 2").select((F.col("l_linenumber") % 2).cast("bigint").alias("doc_id"), key.alias("src"), ((key + F.col("l_partkey") * 31) % n).alias("dst"))
    roots = supplier.filter("s_suppkey % 40 = 1").select(F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("doc_id"), F.col("s_suppkey").alias("node"))
    return links, roots


@query(
    """WITH RECURSIVE l AS (SELECT DISTINCT l_linenumber % 2 AS doc_id, l_suppkey AS src, (l_suppkey + l_partkey * 31) % (SELECT count(*) FROM supplier) AS dst FROM lineitem WHERE l_quantity < 2),
w AS (SELECT d AS doc_id, s_suppkey AS node, 0 AS steps FROM supplier, range(0, 2) r(d) WHERE s_suppkey % 40 = 1 UNION SELECT w.doc_id, l.dst, w.steps + 1 FROM w JOIN l ON l.doc_id = w.doc_id AND l.src = w.node WHERE w.steps < 12),
m AS (SELECT doc_id, node, min(steps) AS steps FROM w GROUP BY doc_id, node), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY steps, node) AS nth, count(*) OVER (PARTITION BY doc_id) AS n FROM m)
SELECT doc_id, node, steps, n > 20 AS truncated FROM k WHERE nth <= 20"""
)
def reachable_in_budget(spark, sf_dir):
    return graphs.reachable(*_links(spark, sf_dir), budget=20)


@query(
    """WITH s AS (SELECT l_orderkey AS k, count(*) AS n, list(CAST(q AS VARCHAR) ORDER BY l_linenumber) AS v FROM (SELECT l_orderkey, l_linenumber, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2) GROUP BY 1)
SELECT l_orderkey * 10 + l_linenumber AS id, o_orderstatus AS status, o_orderpriority AS priority, c_mktsegment AS segment, n_name AS nation, CASE WHEN n = 1 THEN v[1] END AS only_line, CASE WHEN n > 1 THEN v END AS lines, coalesce(n, 0) AS n_lines
FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderkey % 5 <> 0 LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN s ON k = o_orderkey"""
)
def path_values(spark, sf_dir):
    """Five rules over line -> order -> customer -> nation and order -> lines; every fifth order is missing."""
    line = table(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    lines = line.groupBy("l_orderkey", "l_linenumber", "id").agg(F.min("l_quantity").alias("l_quantity"))  # a number may come twice
    orders = table(spark, sf_dir, "orders").filter("o_orderkey % 5 <> 0").withColumn("id", F.col("o_orderkey"))
    edges = {
        ("line", "order"): graphs.Edge("order", orders, "l_orderkey"),
        ("order", "customer"): graphs.Edge("customer", table(spark, sf_dir, "customer").withColumn("id", F.col("c_custkey")), "o_custkey"),
        ("customer", "nation"): graphs.Edge("nation", table(spark, sf_dir, "nation").withColumn("id", F.col("n_nationkey")), "c_nationkey"),
        ("order", "lines"): graphs.Edge("line", lines.select("id", "l_quantity"), links=lines.select(F.col("l_orderkey").alias("src"), F.col("id").alias("dst"), F.col("l_linenumber").alias("ord"))),
        ("line", "supplier"): graphs.Edge("supplier", table(spark, sf_dir, "supplier").withColumn("id", F.col("s_suppkey")), "l_suppkey"),
    }
    paths = {"status": ["order", "o_orderstatus"], "priority": ["order", "o_orderpriority"], "segment": ["order", "customer", "c_mktsegment"], "nation": ["order", "customer", "nation", "n_name"], "lines": ["order", "lines", "l_quantity"]}
    found = graphs.path_values(line, "line", edges, paths)
    return found.select("id", *[F.col(f"{r}.scalar").alias(r) for r in ("status", "priority", "segment", "nation")], F.col("lines.scalar").alias("only_line"), F.col("lines.list").alias("lines"), F.col("lines.n").alias("n_lines"))


# Nested values of the tables' rows.


def _records(spark, sf_dir: str) -> DataFrame:
    """Turns of conversations as nested records whose inner keys and texts look like the record's own."""
    turn = F.col("turn")
    deep = F.struct(F.lit("/Deep").alias("Type"), F.array(F.col("conv_id"), turn).alias("At"))
    inner = F.struct(F.lit("/Inner").alias("Type"), F.lit("/wrong").alias("Role"), deep.alias("Below"))
    record = F.struct(inner.alias("Inner"), F.concat(F.lit("(<< /Type /Page >> ["), "text", F.lit(")")).alias("Text"), F.concat(F.lit("/"), "role").alias("Type"), F.when(turn % 2 == 0, turn).alias("Size"), F.when(turn % 3 == 0, "/x").alias("Role"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.parse_json(F.to_json(record)).alias("value"))


@query(
    """WITH c AS (SELECT * FROM conversations)
SELECT conv_id, turn, path, depth, v AS value FROM (
 SELECT conv_id, turn, 'Text' AS path, 1 AS depth, '(<< /Type /Page >> [' || text || ')' AS v FROM c WHERE text IS NOT NULL UNION ALL SELECT conv_id, turn, 'Type', 1, '/' || role FROM c WHERE role IS NOT NULL UNION ALL SELECT conv_id, turn, 'Size', 1, CAST(turn AS VARCHAR) FROM c WHERE turn % 2 = 0 UNION ALL SELECT conv_id, turn, 'Role', 1, '/x' FROM c WHERE turn % 3 = 0
 UNION ALL SELECT conv_id, turn, 'Inner.Type', 2, '/Inner' FROM c UNION ALL SELECT conv_id, turn, 'Inner.Role', 2, '/wrong' FROM c UNION ALL SELECT conv_id, turn, 'Inner.Below.Type', 3, '/Deep' FROM c UNION ALL SELECT conv_id, turn, 'Inner.Below.At.0', 4, CAST(conv_id AS VARCHAR) FROM c UNION ALL SELECT conv_id, turn, 'Inner.Below.At.1', 4, CAST(turn AS VARCHAR) FROM c)"""
)
def nested_entries(spark, sf_dir):
    found = nested.all_entries(_records(spark, sf_dir), "value").filter("NOT container")
    return found.select("conv_id", "turn", F.array_join("path", ".").alias("path"), "depth", F.try_variant_get("value", "$", "string").alias("value"))


@query(
    """SELECT conv_id, turn, name, CASE name WHEN 'Type' THEN coalesce('/' || role, NULL) WHEN 'Size' THEN CASE WHEN role = 'user' THEN CAST(length(text) AS VARCHAR) WHEN turn % 2 = 0 THEN CAST(turn AS VARCHAR) END WHEN 'Role' THEN CASE WHEN role = 'user' AND turn % 3 = 0 THEN '/x' END END AS value,
CASE WHEN name = 'Role' AND role IS DISTINCT FROM 'user' THEN 'unknown property: Role' WHEN name = 'Other' THEN 'unknown property: Other' END AS error FROM conversations, (SELECT unnest(['Type', 'Size', 'Role', 'Other']) AS name)"""
)
def property_fallback(spark, sf_dir):
    """Properties of a turn: a user's Size and Role are typed, Type and Size generic, everything else is unknown."""
    value = F.col("value")
    rows = _records(spark, sf_dir).join(table(spark, sf_dir, "conversations"), ["conv_id", "turn"])
    typed = {"user": {"Size": checked.prop(F.length("text").cast("string"), "string"), "Role": nested.dictionary_property(value, "Role", "string", ["Role"])}}
    generic = {name: nested.dictionary_property(value, name, "string", ["Type", "Size"]) for name in ("Type", "Size")}
    made = [(name, nested.property_of(name, "string", F.col("role"), typed, generic, F.lit(True))) for name in ("Type", "Size", "Role", "Other")]
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), p.value.alias("value"), p.err.alias("error")) for name, p in made]))
    return rows.select("conv_id", "turn", each.alias("p")).select("conv_id", "turn", "p.*")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 100 <> 7 THEN o_orderkey // 3 END AS third, CASE WHEN o_orderkey % 100 = 7 THEN 'ValueError: order ' || o_orderkey END AS error FROM orders")
def isolated_rows(spark, sf_dir):
    def third(key):
        if key % 100 == 7:
            raise ValueError(f"order {key}")
        return [(key // 3,)]

    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return isolation.map_isolated(rows.withColumn("key", F.col("id")), "id", ["key"], third, "third long")


# Event streams: what a scope, opened and closed by events, leaves in force, and caps between two events of a kind.

_KINDS = "CASE event_id % 7 WHEN 0 THEN 'open' WHEN 1 THEN 'close' WHEN 2 THEN 'set' WHEN 3 THEN 'set' ELSE 'use' END"


def _events(spark, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 7
    kind = F.when(k == 0, "open").when(k == 1, "close").when(k < 4, "set").otherwise("use")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.when(kind == "set", F.col("event_type")).alias("value"), F.length("props").cast("long").alias("bytes"))


@query(
    f"""WITH RECURSIVE e AS (SELECT user_id AS doc_id, event_id AS seq, {_KINDS} AS kind, event_type AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
r AS (SELECT doc_id, 0::BIGINT AS n, 0::BIGINT AS seq, '' AS kind, [NULL::VARCHAR] AS stack FROM (SELECT DISTINCT doc_id FROM e) UNION ALL
 SELECT e.doc_id, e.n, e.seq, e.kind, CASE e.kind WHEN 'open' THEN list_append(stack, stack[-1]) WHEN 'close' THEN CASE WHEN len(stack) > 1 THEN stack[:-2] ELSE stack END WHEN 'set' THEN list_append(stack[:-2], e.value) ELSE stack END FROM r JOIN e ON e.doc_id = r.doc_id AND e.n = r.n + 1)
SELECT doc_id, seq, CAST(len(stack) - 1 AS BIGINT) AS depth, stack[-1] AS value FROM r WHERE kind = 'use'"""
)
def scoped_state(spark, sf_dir):
    return scopes.in_force(_events(spark, sf_dir), block_rows=5000).filter("kind = 'use'").select("doc_id", "seq", "depth", "value")


_SEGMENTS = """WITH e AS (SELECT user_id AS doc_id, event_id AS seq, event_id % 11 = 0 AS ends, length(props) AS bytes FROM events), s AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment FROM e),
c AS (SELECT *, count(*) OVER w AS n, sum(bytes) OVER w AS b FROM s WHERE NOT ends WINDOW w AS (PARTITION BY doc_id, segment ORDER BY seq))
"""


@query(_SEGMENTS + "SELECT doc_id, seq, CAST(segment AS BIGINT) AS segment, n AS count, CAST(b AS BIGINT) AS bytes FROM c WHERE n <= 6 AND b <= 70")
def segment_caps(spark, sf_dir):
    return scopes.capped_segments(_segments(spark, sf_dir), 6, 70, block_rows=5000)[0].select("doc_id", "seq", "segment", "count", F.col("running_bytes").alias("bytes"))


def _segments(spark, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("doc_id", "seq", (F.col("seq") % 11 == 0).alias("ends"), "bytes")


@query(_SEGMENTS + "SELECT doc_id, CAST(segment AS BIGINT) AS segment, min(seq) AS seq FROM c WHERE n > 6 OR b > 70 GROUP BY 1, 2")
def segment_warnings(spark, sf_dir):
    return scopes.capped_segments(_segments(spark, sf_dir), 6, 70, block_rows=5000)[1]


# Structure elements: parts as binary heaps, whose kids are of every kind.


def _elements(spark, sf_dir: str) -> DataFrame:
    part, k, size = table(spark, sf_dir, "part"), F.floor(F.col("p_partkey") / 3).cast("bigint"), F.col("p_size")
    ref = lambda n: F.concat(n.cast("string"), F.lit(" 0 R"))
    kids = F.concat(F.lit("["), size.cast("string"), F.lit(',{"Type":"/MCR","Pg":"77 0 R","MCID":'), (size - 10).cast("string"), F.lit('},{"Type":"/OBJR"'), F.when(size % 2 == 0, F.concat(F.lit(',"Obj":"'), ref(k), F.lit('"'))).otherwise(""), F.lit('},"'), ref(k * 2), F.lit('","(text)"]'))
    fields = F.concat_ws(",", F.when(size % 9 != 0, F.concat(F.lit('"S":"/'), F.when(size % 5 == 0, "Artifact").otherwise(F.concat(F.lit("H"), (size % 8).cast("string"))), F.lit('"'))), F.when(k > 1, F.concat(F.lit('"P":"'), ref(F.floor(k / 2).cast("bigint")), F.lit('"'))), F.when(size % 4 == 0, F.concat(F.lit('"Pg":"'), ref(size), F.lit('"'))), F.concat(F.lit('"K":'), kids))
    rows = spread(part.filter(k >= 1).select("p_partkey", "p_size"), VALUES_A_TASK).select((F.col("p_partkey") % 3).alias("doc_id"), k.alias("node"), F.concat(F.lit("{"), fields, F.lit("}")).alias("json"))
    return rows.select("doc_id", "node", F.try_parse_json("json").alias("value"))


_ELEMENTS = """WITH RECURSIVE e AS (SELECT p_partkey % 3 AS doc_id, p_partkey // 3 AS node, CASE WHEN p_partkey // 3 > 1 THEN p_partkey // 3 // 2 END AS parent, p_size AS size, CASE WHEN p_size % 4 = 0 THEN p_size::BIGINT END AS page,
 CASE WHEN p_size % 9 <> 0 THEN CASE WHEN p_size % 5 = 0 THEN 'Artifact' ELSE 'H' || (p_size % 8) END END AS role FROM part WHERE p_partkey // 3 >= 1),
up AS (SELECT doc_id, node, parent AS top, page FROM e UNION ALL SELECT u.doc_id, u.node, e.parent, e.page FROM up u JOIN e ON e.doc_id = u.doc_id AND e.node = u.top WHERE u.page IS NULL),
pages AS (SELECT doc_id, node, max(page) AS inherited FROM up GROUP BY 1, 2)
"""


@query(
    _ELEMENTS
    + """SELECT 'node' AS tag, doc_id, node, role, page, parent AS target, NULL::BIGINT AS mcid FROM e UNION ALL SELECT 'child', doc_id, node, NULL, NULL, node * 2, NULL FROM e UNION ALL SELECT 'reference', doc_id, node, NULL, page, node, NULL FROM e WHERE size % 2 = 0 UNION ALL SELECT 'artifact', doc_id, node, role, page, NULL, NULL FROM e WHERE role = 'Artifact'
UNION ALL SELECT 'content', doc_id, node, NULL, inherited, NULL, size FROM e JOIN pages USING (doc_id, node) UNION ALL SELECT 'content', doc_id, node, NULL, 77, NULL, size - 10 FROM e WHERE size >= 10"""
)
def structure_tables(spark, sf_dir):
    """Five tables from one scan, marked content with inherited pages."""
    made = structure.structure_tables(_elements(spark, sf_dir))
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda df, tag, role, page, target, mcid: df.select(F.lit(tag).alias("tag"), "doc_id", "node", role.alias("role"), page.alias("page"), target.alias("target"), mcid.alias("mcid"))
    c, text, number = F.col, none("string"), none("bigint")
    out = row(made.nodes, "node", c("role"), c("page"), c("parent"), number).unionByName(row(made.children, "child", text, number, c("target"), number)).unionByName(row(made.references, "reference", text, c("page"), c("target"), number))
    return out.unionByName(row(made.artifacts, "artifact", c("role"), c("page"), number, number)).unionByName(row(structure.paged_content(made), "content", text, c("page"), number, c("mcid")))


@query(_ELEMENTS + "SELECT doc_id, node, NULL::INT AS ord, 'missing role' AS message FROM e WHERE role IS NULL UNION ALL SELECT doc_id, node, 1, 'bad content number' FROM e WHERE size < 10 UNION ALL SELECT doc_id, node, 2, 'reference without an object' FROM e WHERE size % 2 = 1 UNION ALL SELECT doc_id, node, 4, 'unknown kid' FROM e")
def structure_warnings(spark, sf_dir):
    return structure.structure_tables(_elements(spark, sf_dir)).warnings


# Attributes of orders: their own, then those of their classes, which customers' segments and priorities define.

_LAYERS = """WITH m AS (SELECT o_orderpriority AS class, 'status' AS name, 'by ' || o_orderpriority AS value FROM orders GROUP BY ALL UNION ALL SELECT o_orderpriority, 'least', CAST(min(o_orderkey) AS VARCHAR) FROM orders GROUP BY 1 UNION ALL SELECT o_orderstatus, 'status', 'is ' || o_orderstatus FROM orders GROUP BY 1, 3),
l AS (SELECT o_orderkey AS node, unnest([o_orderpriority, o_orderstatus, 'none']) AS class, unnest([0, 1, 2]) AS layer FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, unnest([o_orderstatus, o_orderpriority]), unnest([0, 1]) FROM orders WHERE o_orderkey % 5 <> 0)
"""


def _layers(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    classes = F.when(k % 5 == 0, F.array("o_orderpriority", "o_orderstatus", F.lit("none"))).otherwise(F.array("o_orderstatus", "o_orderpriority"))
    elements = orders.select(F.lit(1).alias("doc_id"), k.alias("node"), F.when(k % 3 == 0, F.create_map(F.lit("status"), F.concat(F.lit("own "), "o_orderstatus"))).alias("attributes"), classes.alias("classes"))
    by_priority = orders.groupBy(F.col("o_orderpriority").alias("class")).agg(F.min("o_orderkey").alias("least"))
    of_priority = by_priority.select("class", F.create_map(F.lit("status"), F.concat(F.lit("by "), "class"), F.lit("least"), F.col("least").cast("string")).alias("attributes"))
    of_status = orders.select(F.col("o_orderstatus").alias("class")).distinct().select("class", F.create_map(F.lit("status"), F.concat(F.lit("is "), "class")).alias("attributes"))
    return elements, of_priority.unionByName(of_status).withColumn("doc_id", F.lit(1))


@query(_LAYERS + ", a AS (SELECT node, name, value, layer FROM l JOIN m USING (class) UNION ALL SELECT o_orderkey, 'status', 'own ' || o_orderstatus, 9 FROM orders WHERE o_orderkey % 3 = 0) SELECT node, name, arg_max(value, layer) AS value FROM a GROUP BY node, name")
def layered_attributes(spark, sf_dir):
    return structure.layered_attributes(*_layers(spark, sf_dir)).select("node", "name", "value")


@query("SELECT o_orderkey AS node, 'none' AS class FROM orders WHERE o_orderkey % 5 = 0")
def unresolved_classes(spark, sf_dir):
    return structure.unresolved_classes(*_layers(spark, sf_dir)).select("node", "class")


@query(
    """WITH RECURSIVE n AS (SELECT p_partkey % 3 AS doc_id, p_partkey // 3 AS node, CASE WHEN p_partkey // 3 > 1 THEN p_partkey // 3 // 2 END AS parent, CASE p_size % 5 WHEN 0 THEN 'Table' WHEN 1 THEN 'TR' WHEN 2 THEN 'TD' WHEN 3 THEN 'TH' ELSE 'Div' END AS role FROM part WHERE p_partkey // 3 >= 1),
t AS (SELECT doc_id, node, role, [node] AS key, NULL::BIGINT AS tbl FROM n WHERE parent IS NULL UNION ALL SELECT n.doc_id, n.node, n.role, list_append(t.key, n.node), CASE WHEN t.role = 'Table' THEN t.node ELSE t.tbl END FROM n JOIN t ON t.doc_id = n.doc_id AND t.node = n.parent)
SELECT doc_id, tbl AS "table", node, role, CAST(row_number() OVER (PARTITION BY doc_id, tbl ORDER BY key) - 1 AS INTEGER) AS place FROM t WHERE tbl IS NOT NULL AND role IN ('TR', 'TD', 'TH')"""
)
def table_members(spark, sf_dir):
    node, size = F.floor(F.col("p_partkey") / 3).cast("bigint"), F.col("p_size") % 5
    role = F.when(size == 0, "Table").when(size == 1, "TR").when(size == 2, "TD").when(size == 3, "TH").otherwise("Div")
    nodes = table(spark, sf_dir, "part").filter(node >= 1).select((F.col("p_partkey") % 3).alias("doc_id"), node.alias("node"), F.when(node > 1, F.floor(node / 2).cast("bigint")).alias("parent"), F.lit(0).alias("ord"), role.alias("role"))
    return hierarchy.table_members(nodes)


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN CASE o_orderkey % 4 WHEN 0 THEN 'valid' WHEN 2 THEN 'parseFailed' END WHEN o_orderkey % 10 > 7 THEN 'parseFailed' WHEN o_orderkey % 7 = 0 THEN 'encrypted' WHEN o_orderkey % 5 = 0 THEN CASE o_orderkey % 4 WHEN 0 THEN 'valid' WHEN 1 THEN 'invalid' WHEN 2 THEN 'parseFailed' END
WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderstatus = 'F' THEN 'valid' ELSE 'invalid' END ELSE CASE WHEN o_orderstatus = 'O' THEN 'valid' ELSE 'invalid' END END AS outcome FROM (SELECT DISTINCT o_orderkey, o_orderstatus FROM orders)"""
)
def report_outcomes(spark, sf_dir):
    """Reports with fields at several depths: a later list's own field gives way to that of the key before it."""
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    flag = lambda s: F.when(status == s, "true").otherwise("false")
    deep = F.concat(F.lit('"jobs":[{"a":{"isCompliant":"no"}},{"b":{"isCompliant":'), flag("O"), F.lit('}}],"z":{"isCompliant":null}'))
    own = F.when(k % 2 == 0, F.concat(F.lit('"isCompliant":'), flag("F"), F.lit(","))).otherwise("")
    fields = F.when(k % 5 == 0, F.lit('"none":[{"isCompliant":1}]')).otherwise(F.concat(own, deep))
    json = F.concat(F.lit('{"summary":{"failedToParse":'), F.greatest(k % 10 - 7, F.lit(0)).cast("string"), F.lit(',"in":[{"encrypted":'), F.when(k % 7 == 0, 2).otherwise(0).cast("string"), F.lit("}]},"), fields, F.lit("}"))
    code = F.when(k % 4 == 2, 7).otherwise((k % 4).cast("int"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    # distinct orders are few bytes, which come in few tasks; each grows into a report
    rows = orders.distinct().repartition(tasks_for(orders, VALUES_A_TASK))
    return reports.report_outcomes(rows.select(k.alias("id"), F.when(k % 6 == 0, "no json").otherwise(json).alias("json"), code.alias("exit_code")))
