import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillspark.functions import nested
from quillspark.functions.checked import prop
from quillspark.operators import graphs, scopes

NODES = "doc_id int, node bigint, parent bigint, ord int"


def slow_order(rows):
    first, seen = {}, defaultdict(int)
    for d, n, p, o in rows:
        if n is None:
            continue
        seen[d, n] += 1
        key = (p is not None, p or 0, o is not None, o or 0)
        if (d, n) not in first or key < first[d, n][0]:
            first[d, n] = (key, p, o)
    warnings = {(d, n, "repeated") for (d, n), k in seen.items() if k > 1}
    children = defaultdict(list)
    for (d, n), (_, p, o) in first.items():
        if p is not None and (d, p) not in first:
            warnings.add((d, n, "orphan"))
            p = None
        children[d, p].append((o is not None, o or 0, n))
    out = {}
    for d in {d for d, _ in first}:
        count, stack = 0, [(n, 0) for *_, n in sorted(children[d, None], reverse=True)]
        while stack:
            n, depth = stack.pop()
            out[d, n] = (count, depth)
            count += 1
            stack += [(m, depth + 1) for *_, m in sorted(children[d, n], reverse=True)]
    warnings |= {(d, n, "cycle") for d, n in first if (d, n) not in out}
    return out, warnings


def check_order(spark, rows):
    found, warned = graphs.visit_order(spark.createDataFrame(rows, NODES))
    got = {(r.doc_id, r.node): (r.pre, r.depth, r.last) for r in found.collect()}
    want, warnings = slow_order(rows)
    assert {k: v[:2] for k, v in got.items()} == want
    by_place = defaultdict(dict)
    for (d, _), (pre, depth, last) in got.items():
        by_place[d][pre] = (depth, last)
    for (d, _), (pre, depth, last) in got.items():
        end = pre
        while end + 1 in by_place[d] and by_place[d][end + 1][0] > depth:
            end += 1
        assert last == end
    assert {(r.doc_id, r.node, r.kind) for r in warned.collect()} == warnings


def test_order_of_forests(spark):
    rng, rows = random.Random(4), []
    for d in range(4):
        n = (1, 7, 60, 200)[d]
        rows += [(d, i, rng.randrange(i) if i and rng.random() < 0.95 else None, rng.randint(0, 3)) for i in range(n)]
    rows += [(9, 1, 2, 0), (9, 2, 3, 0), (9, 3, 1, 0), (9, 4, 3, 0), (9, 5, None, 0), (9, 6, 77, 1), (9, 7, 5, 2), (9, 7, 5, 1), (9, 7, 6, 0), (9, None, 5, 0), (9, 8, 8, 0), (9, 10, 5, None)]
    check_order(spark, rows)
    assert graphs.visit_order(spark.createDataFrame([], NODES))[0].count() == 0


def test_order_of_a_long_chain_and_caps(spark):
    n = 20_000
    chain = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit(0).alias("ord"))
    found, _ = graphs.visit_order(chain)
    assert found.filter((F.col("pre") == F.col("node")) & (F.col("depth") == F.col("node")) & (F.col("last") == n - 1)).count() == n
    capped, warned = graphs.visit_order(chain.limit(100), most_nodes=40, most_depth=29)
    assert capped.count() == 30 and {r.kind: r.n for r in warned.groupBy("kind").agg(F.count("*").alias("n")).collect()} == {"nodeCap": 60, "depthCap": 10}


@pytest.mark.parametrize(("budget", "parts"), [(None, 1), (25, 1), (25, 40), (0, 4)])
def test_reach(spark, budget, parts):
    rng = random.Random(7)
    links = [(d, rng.randrange(60), rng.randrange(60)) for d in range(3) for _ in range(90)] + [(0, 1, None), (0, None, 2), (0, 5, 5)]
    roots = [(d, rng.randrange(60)) for d in range(3) for _ in range(2)] + [(0, None), (7, 1), (7, 1)]
    steps = {(d, n): 0 for d, n in roots if n is not None}
    frontier = set(steps)
    while frontier:
        frontier = {(d, b) for d, a, b in links if b is not None and (d, a) in frontier and (d, b) not in steps}
        steps |= {x: 1 + max(steps.values()) for x in frontier}
    want = {}
    for d in {d for d, _ in steps}:
        mine = sorted((s, n) for (e, n), s in steps.items() if e == d)
        cut = budget is not None and len(mine) > budget
        want |= {(d, n): (s, cut) for s, n in (mine[:budget] if cut else mine)}
    got = graphs.reachable(spark.createDataFrame(links, "doc_id int, src int, dst int").repartition(parts), spark.createDataFrame(roots, "doc_id int, node int").repartition(parts), budget)
    assert {(r.doc_id, r.node): (r.steps, r.truncated) for r in got.collect()} == want


def test_paths_share_joins_and_tell_counts(spark):
    a = spark.createDataFrame([(1, 10), (2, 11), (3, None), (4, 99)], "id int, b int")
    b = spark.createDataFrame([(10, "x", 5), (11, None, 6)], "id int, name string, c int")
    c = spark.createDataFrame([(5, "five"), (6, "six")], "id int, word string")
    d = spark.createDataFrame([(100, "p"), (101, "q"), (102, None), (103, "s")], "id int, tag string")
    links = spark.createDataFrame([(5, 101, 1), (5, 100, 2), (5, 102, 0), (6, 103, 0), (6, 999, 1)], "src int, dst int, ord int")
    edges = {("a", "b"): graphs.Edge("b", b, "b"), ("b", "c"): graphs.Edge("c", c, "c"), ("c", "d"): graphs.Edge("d", d, links=links), ("a", "unused"): graphs.Edge("d", d, "b")}
    paths = {"name": ["b", "name"], "word": ["b", "c", "word"], "tags": ["b", "c", "d", "tag"], "again": ["b", "c", "word"], "own": ["b"]}
    found = graphs.path_values(a, "a", edges, paths)
    got = {r.id: r for r in found.collect()}
    assert got[1].name.scalar == "x" and got[2].name.n == 0 and got[2].name.scalar is None and got[1].word == got[1].again and got[1].own.scalar == "10"
    assert got[1].tags.list == ["q", "p"] and got[1].tags.n == 2 and got[1].tags.scalar is None and got[2].tags.scalar == "s" and got[2].tags.list is None
    assert got[3].word.n == got[4].tags.n == 0 and len(got) == 4
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 4  # one for each edge that a path names, and that of links to their objects
    few = {r.id: r for r in graphs.path_values(a, "a", edges, {"tags": ["b", "c", "d", "tag"]}, most=1).collect()}
    assert few[1].tags.error == "list too long" and few[1].tags.list is None and few[2].tags.scalar == "s" and few[2].tags.error is None
    with pytest.raises(KeyError):
        graphs.path_values(a, "a", edges, {"bad": ["nowhere", "name"]})


def slow_state(rows):
    out, stacks = [], {}
    for d, s, kind, value in sorted(rows):
        stack = stacks.setdefault(d, [None])
        if kind == "open":
            stack.append(stack[-1])
        elif kind == "close" and len(stack) > 1:
            stack.pop()
        elif kind == "set" and value is not None:
            stack[-1] = value
        out.append((d, s, len(stack) - 1, stack[-1]))
    return out


@pytest.mark.parametrize("block_rows", [3, 50, 100_000])
def test_scopes_against_a_stack(spark, block_rows):
    rng = random.Random(11)
    rows = [(d, s, rng.choice(["open", "open", "close", "close", "set", "use"]), rng.choice([None, "a", "b", "c"])) for d in range(4) for s in range(150)]
    rows += [(8, s, "open" if s < 40 else "use" if s == 40 else "close", None) for s in range(82)] + [(9, 0, "set", "z")] + [(9, 1 + s, "open" if s < 30 else "use", None) for s in range(31)] + [(10, 5, "close", None), (10, 6, "use", None)]
    found = scopes.in_force(spark.createDataFrame(rows, "doc_id int, seq bigint, kind string, value string"), block_rows)
    assert sorted((r.doc_id, r.seq, r.depth, r.value) for r in found.collect()) == slow_state(rows)
    assert scopes.in_force(spark.createDataFrame([], "doc_id int, seq bigint, kind string, value string"), block_rows).count() == 0


@pytest.mark.parametrize("block_rows", [4, 100_000])
def test_caps_of_segments_with_a_hot_stream(spark, block_rows):
    rng = random.Random(2)
    rows = [(0 if rng.random() < 0.7 else rng.randint(1, 5), s, rng.random() < 0.15, rng.choice([None, 0, 1, 5, 30])) for s in range(600)]
    kept, warned, state = [], [], {}
    for d, s, ends, size in rows:
        seg, n, b, cut = state.get(d, (0, 0, 0, False))
        if ends:
            state[d] = (seg + 1, 0, 0, False)
            continue
        n, b = n + 1, b + (size or 0)
        if n > 5 or b > 40:
            warned += [] if cut else [(d, seg, s)]
            cut = True
        else:
            kept.append((d, s, seg, n, b))
        state[d] = (seg, n, b, cut)
    got, warnings = scopes.capped_segments(spark.createDataFrame(rows, "doc_id int, seq bigint, ends boolean, bytes bigint"), 5, 40, block_rows)
    assert sorted((r.doc_id, r.seq, r.segment, r["count"], r.running_bytes) for r in got.collect()) == sorted(kept)
    assert sorted(map(tuple, warnings.collect())) == sorted(warned)


def test_entries_and_properties_of_nested_values(spark):
    texts = ['{"a":{"a":[1,{"b":"x] << /a"}]},"b":null}', "[[],{}]", "3", None, '{"it\'s":{"q\\"":true}}']
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, j string").select("i", F.try_parse_json("j").alias("v"))
    got = nested.all_entries(rows, "v").select("i", F.array_join("path", "/").alias("p"), "depth", "key", "container", F.try_variant_get("value", "$", "string").alias("s"))
    found = {(r.i, r.p): (r.depth, r.key, r.container, r.s) for r in got.collect()}
    assert found[0, "a/a/1/b"] == (4, "b", False, "x] << /a") and found[0, "a/a"][:3] == (2, "a", True) and found[0, "b"] == (1, "b", False, None) and found[0, "a/a/0"] == (3, None, False, "1")
    assert {k for k in found if k[0] in (1, 2, 3)} == {(1, "0"), (1, "1")} and found[4, "it's/q\""] == (2, 'q"', False, "true")
    assert nested.all_entries(rows, "v", max_levels=1).agg(F.max("depth")).first()[0] == 1 and nested.all_entries(rows.limit(0), "v").count() == 0
    v = F.col("v")
    listed, other, wrong = (nested.dictionary_property(v, *x) for x in (("b", "string", ["a", "b"]), ("c", "string", ["a"]), ("a", "number", ["a"])))
    r = rows.filter("i = 0").select(listed.value.alias("a"), listed.err.alias("b"), other.err.alias("c"), wrong.err.alias("d"), nested.at(v, "a", "a", 1, "b", kind="string").alias("e")).first()
    assert tuple(r) == (None, None, "unknown property: c", "wrong type: a", "x] << /a")
    typed = {"f": {"x": prop(F.lit("typed"), "string"), "n": prop(F.lit(None).cast("string"), "string")}}
    generic = {k: prop(F.lit("generic"), "string") for k in ("x", "n", "g")}
    for name, family, is_object, want in (("x", "f", True, ("typed", None)), ("n", "f", True, (None, None)), ("g", "f", True, ("generic", None)), ("x", "other", True, ("generic", None)), ("g", "f", False, (None, "unknown property: g")), ("zz", "f", True, (None, "unknown property: zz"))):
        p = nested.property_of(name, "string", F.lit(family), typed, generic, F.lit(is_object))
        assert tuple(spark.range(1).select(p.value, p.err).first()) == want, name
