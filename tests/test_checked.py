import math

import pytest
from pyspark.sql import functions as F

from quillspark.functions import checked as c


def run(spark, frame, **made):
    pairs = [F.struct(x.value.cast("string").alias("v"), x.err.alias("e")).alias(k) for k, x in made.items()]
    return [{k: (r[k].v, r[k].e) for k in made} for r in frame.select("i", *pairs).orderBy("i").collect()]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(0, 1.5, "aé,b,,", True), (1, -7.5, "", False), (2, None, None, None), (3, 8.0, "x/y", True)], "i int, n double, s string, b boolean")


def test_equality(spark, rows):
    n, s, null = c.prop("n", "number"), c.prop("s", "string"), c.lit(None)
    got = run(spark, rows, near=c.eq(n, c.lit(1.5 + 1e-16)), null=c.eq(n, null), both=c.eq(null, null), cross=c.eq(n, s), ne=c.ne(s, c.lit("")))
    assert [g["near"][0] for g in got] == ["true", "false", "false", "false"]
    assert [g["null"][0] for g in got] == ["false", "false", "true", "false"]
    assert {g["both"][0] for g in got} == {"true"} and got[0]["cross"][0] == "false" and got[1]["ne"][0] == "false" and got[2]["ne"][0] == "true"


def test_numbers_and_errors(spark, rows):
    n, s = c.prop("n", "number"), c.prop("s", "string")
    got = run(spark, rows, rem=c.rem(n, c.lit(2)), zero=c.div(n, c.lit(0)), wrong=c.add(n, s), band=c.bit_and(n, c.lit(12)), sh=c.shift_right(n, c.lit(1)), far=c.shift_right(n, c.lit(64)), lt=c.lt(n, c.lit(2)))
    assert float(got[1]["rem"][0]) == math.fmod(-7.5, 2)
    assert all(g["zero"][1] for g in got) and all(g["wrong"][1] for g in got)
    assert got[0]["band"][1] == "not an integer" and float(got[3]["band"][0]) == 8 & 12 and float(got[3]["sh"][0]) == 4 and got[3]["far"][1] == "shift out of range"
    assert got[2]["lt"][1] and got[0]["lt"] == ("true", None)


def test_short_circuit(spark, rows):
    b, bad = c.prop("b", "bool"), c.gt(c.div(c.prop("n", "number"), c.lit(0)), c.lit(1))
    got = run(spark, rows, a=c.and_(b, bad), o=c.or_(b, bad), t=c.choose(b, c.lit(True), bad), n=c.not_(b), none_=c.exists_(), all_=c.all_())
    assert [g["a"] for g in got][1] == ("false", None) and got[0]["a"][1] == "division by zero"
    assert got[0]["o"] == ("true", None) and got[1]["o"][1] == "division by zero" and got[2]["o"][1].startswith("type mismatch")
    assert got[0]["t"] == ("true", None) and got[1]["t"][1] == "division by zero"
    assert got[0]["n"][0] == "false" and got[0]["none_"][0] == "false" and got[0]["all_"][0] == "true"


def test_strings_count_bytes(spark, rows):
    s = c.prop("s", "string")
    parts = c.split(s, ",")
    got = run(spark, rows, size=c.size(s), at=c.index_of(s, c.lit(",")), rest=c.slice_(s, 3), mid=c.slice_(s, 2), n=c.size(parts), empty=c.is_empty(s), first=c.find_index_equals(parts, "b"), tail=c.size(c.slice_(parts, 1)), se=c.search(s, "[,/]"))
    assert float(got[0]["size"][0]) == len("aé,b,,".encode()) and float(got[0]["at"][0]) == 3 and got[0]["rest"][0] == ",b,,"
    assert got[0]["mid"][0] == ""  # within a character
    assert float(got[0]["n"][0]) == 4 and float(got[0]["first"][0]) == 1 and float(got[0]["tail"][0]) == 3 and float(got[0]["se"][0]) == 3
    assert got[1]["empty"][0] == "true" and float(got[1]["at"][0]) == -1 and got[2]["size"][1]


def test_patterns_have_limits(spark, rows):
    s = c.prop("s", "string")
    got = run(spark, rows, ok=c.matches(s, "^x"), ahead=c.matches(s, "a(?=b)"), back=c.matches(s, r"(a)\1"), long=c.matches(s, "a" * 513))
    assert got[3]["ok"] == ("true", None) and all(got[0][k][1] for k in ("ahead", "back", "long"))
    long = spark.createDataFrame([(0, "y" * 5000)], "i int, s string")
    assert run(spark, long, t=c.matches(s, "y"))[0]["t"][1] == "text too long"


def test_outcome(spark, rows):
    got = rows.select("i", c.outcome(c.gt(c.prop("n", "number"), c.lit(0))).alias("o")).orderBy("i").collect()
    assert [r.o for r in got] == ["passed", "failed", "unsupported", "passed"]
    assert rows.select(c.outcome(c.prop("n", "number")).alias("o")).distinct().collect()[0].o == "unsupported"


def test_limits_of_all_pattern_functions(spark):
    long = spark.createDataFrame([(0, "y" * 5001, ["y" * 5000, "n"])], "i int, s string, l array<string>")
    text, items = c.prop("s", "string"), c.prop("l", "list")
    got = run(spark, long, at=c.search(text, "y"), hits=c.size(c.filter_matches(items, "n")), others=c.size(c.filter_not_matches(items, "n")), far=c.size(c.filter_matches(items, "a" * 513)), ahead=c.size(c.filter_not_matches(items, "a(?=b)")))[0]
    assert [got[k][1] for k in ("at", "hits", "others", "far", "ahead")] == ["text too long"] * 3 + ["pattern too long", "pattern not supported"]


def nested(depth):
    n = c.prop("n", "number")
    test = c.prop("b", "bool")
    for i in range(depth):
        test = c.not_(c.or_(c.and_(test, c.lt(c.div(n, c.lit(i + 1)), c.lit(3))), c.eq(n, c.lit(i))))
    return test


def test_deep_expressions_stay_small(spark, rows):
    sizes = [len(rows.select(c.outcome(nested(d)).alias("o"), c.error(nested(d)).alias("e"))._jdf.queryExecution().optimizedPlan().toString()) for d in (8, 16, 32, 64)]
    assert all(b < 4.5 * a for a, b in zip(sizes, sizes[1:])) and sizes[-1] < 1_500_000  # with the square of the depth at most
    def truth(row, depth):
        value = row.b
        for i in range(depth):
            if value is None:
                return "unsupported"
            left = value
            if left:
                if row.n is None:
                    return "unsupported"
                left = row.n / (i + 1) < 3
            value = not (left or (row.n is not None and abs(row.n - i) < 1e-12))
        return "passed" if value else "failed"

    for depth in (1, 2, 7, 20):
        got = rows.select("i", "n", "b", c.outcome(nested(depth)).alias("o")).collect()
        assert [r.o for r in got] == [truth(r, depth) for r in got]


def test_values_bound_once_are_right(spark, rows):
    s, n = c.prop("s", "string"), c.prop("n", "number")
    deep = s
    for _ in range(12):
        deep = c.slice_(deep, 0)
    number = c.choose(c.eq(n, c.lit(8)), n, c.prop("n", "number"))
    for _ in range(3):
        number = c.choose(c.eq(number, c.lit(8)), number, number)
    got = run(spark, rows, text=deep, at=c.index_of(deep, c.slice_(c.lit("xx,"), 2)), same=c.eq(number, n), band=c.bit_and(c.add(n, c.lit(0)), c.lit(12)), sh=c.shift_right(c.mul(n, c.lit(1)), c.lit(1)))
    assert [g["text"][0] for g in got if g["text"][1] is None] == ["aé,b,,", "", "x/y"] and got[2]["text"][1] and float(got[0]["at"][0]) == 3 and [g["same"][0] for g in got] == ["true"] * 4
    assert got[0]["band"][1] == "not an integer" and float(got[3]["band"][0]) == 8 and float(got[3]["sh"][0]) == 4


def test_parse_facts(spark):
    fact = "array<struct<kind:string,declared:bigint,discovered:bigint>>"
    rows = spark.createDataFrame([(0, [("header", None, None), ("streamLength", 3, 4)]), (1, [("encrypted", None, None), ("streamLength", 3, 3)]), (2, None)], f"i int, facts {fact}")
    got = run(spark, rows, h=c.has_parse_fact("facts", "header"), e=c.has_parse_fact("facts", "encryption"), m=c.has_parse_fact("facts", "streamLengthMismatch"), o=c.has_parse_fact("facts", "other"))
    assert [[g[k][0] for k in "hemo"] for g in got] == [["true", "false", "true", "false"], ["false", "true", "false", "false"], ["false"] * 4]


def test_budgets():
    test = c.lit(True)
    for _ in range(31):
        test = c.not_(test)
    assert c.over_budget(test) is None and c.over_budget(c.not_(test)) == "budget exceeded: depth"
    assert c.over_budget(c.or_(*[c.lit(True)] * 16)) is None and c.over_budget(c.or_(*[c.eq(c.lit(1), c.lit(1))] * 33)) is not None
