import re
from collections import Counter
from itertools import permutations

import pytest

from quillspark.llm.filter_audit import audit, failure_flags

SCHEMA = "doc_id long, text string, lang string, part string, A int, n string, digest string"
NAMES = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def slow_flags(rows):
    out = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = any(j is not None and i is not None and j < i and (u or "") == t for j, u, _ in rows)
        out.append((i, lang or "", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), smaller)))
    return out


def slow_audit(rows, labels):
    flags, good, toxic = slow_flags(rows), {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    out, shapley = [], Counter()
    for part in {p for _, p, _ in flags}:
        mine = [(i, f) for i, p, f in flags if p == part]
        for order in permutations(range(5)):
            left = mine
            for step, k in enumerate(order):
                gone = [(i, f) for i, f in left if f[k]]
                left = [(i, f) for i, f in left if not f[k]]
                fails = sum(f[k] for _, f in mine)
                only = sum(f[k] and sum(f) == 1 for _, f in mine)
                out.append([part, "".join("ABCDE"[x] for x in order), step + 1, len(left), len(gone), fails - len(gone), only, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), k])
                shapley[part, k] += len(gone)
    return sorted((*r[:-1], shapley[r[0], r[-1]]) for r in out)


def check(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "clash", 7, "n", "d") for r in rows], SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit(docs, marks)
    assert got.columns == NAMES
    assert sorted(tuple(r) for r in got.collect()) == slow_audit(rows, labels)


def words(n, of=10**9):
    return " ".join(f"w{i % of}" for i in range(n))


def test_every_order_on_odd_rows(spark):
    rows = [
        (1, None, "en"), (2, "", None), (3, " \t\n\x0b\x0c\r ", ""), (4, words(99), "en"), (5, words(100), "en"), (6, words(100), "de"), (6, words(100), "de"), (7, words(100, 80), "en"),
        (8, words(100, 79), "en"), (9, "A" + "b" * 9, "fr"), (10, "AA" + "b" * 9, "fr"), (11, words(120) + " #", "en"), (12, words(50, 3) + " A|B", "de"), (None, words(100), "en"), (None, None, None),
        (13, "X" * 300_000 + " y" * 50_000, "en"), (14, words(100) + " x", "en"), (15, "É" * 40 + "a" * 60, None), (5, words(100), "en"),
    ]
    labels = [(5, 1, 0), (5, 0, 1), (6, 1, 1), (8, 0, 1), (11, 1, None), (12, None, 1), (None, 1, 1), (99, 1, 1), (4, 1, 0)]
    check(spark, rows, labels)


def test_hot_text_and_many_parts(spark):
    rows = [(i, "same text", f"p{i % 3}") for i in range(400)] + [(1000 + i, words(100 + i, 70 + i), f"q{i}") for i in range(20)]
    check(spark, rows, [(i, i % 2, int(i % 3 == 0)) for i in range(0, 400, 5)])


def test_empty_table_and_flags(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(none, labels).collect() == []
    rows = [(3, "same", "a"), (1, "same", "b"), (2, "other", None), (None, "same", "a"), (1, "same", "b")]
    got = failure_flags(spark.createDataFrame([(*r, "", 0, "", "") for r in rows], SCHEMA)).collect()
    assert sorted(((r.doc_id, r.part, (r.A, r.B, r.C, r.D, r.E)) for r in got), key=str) == sorted(slow_flags(rows), key=str)


@pytest.mark.parametrize("parts", [1, 64])
def test_same_rows_at_any_partitioning(spark, parts):
    rows = [(i, words(90 + i % 20, 75 + i % 9) + " #" * (i % 2), "ab"[i % 2]) for i in range(60)]
    docs = spark.createDataFrame([(*r, "", 0, "", "") for r in rows], SCHEMA).repartition(parts)
    got = audit(docs, spark.createDataFrame([(4, 1, 1)], "doc_id long, quality int, toxic int"))
    assert sorted(tuple(r) for r in got.collect()) == slow_audit(rows, [(4, 1, 1)])
