import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.llm.common import LOWER, UPPER
from quillspark.llm.spelling import anagram_key, near_pairs, roots, spelling_variants

SCHEMA = "doc_id long, text string, word string, n int, form string"
FOLD = str.maketrans(UPPER, LOWER)


def slow_words(rows):
    found = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += len(run) >= 7
    return {w: n for w, n in found.items() if n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_variants(rows):
    words = slow_words(rows)
    form, count = {}, {}
    for w, n in words.items():
        close = [v for v in words if abs(len(v) - len(w)) < 2 and v != w and near(v, w)]
        best = min(close, key=lambda v: (-words[v], v), default=None)
        form[w], count[w] = best if best is not None and words[best] >= 10 * n else None, len(close)
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, count[w], words[form[w]] if form[w] else None))
    return sorted(out, key=str)


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "clash", 1, "f") for i, t in rows], SCHEMA)
    got = spelling_variants(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == slow_variants(rows)


def test_random_vocabulary(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcé×") for _ in range(rng.randint(6, 9))) for _ in range(60)]

    def edited(w):
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcé") + w[i:], w[:i] + rng.choice("abcé") + w[i + 1 :]])

    pool = base + [edited(rng.choice(base)) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(40))) for i in range(60)] + [(100 + i, " ".join(rng.choice(base[:9]) for _ in range(200))) for i in range(20)]
    check(spark, rows)


def test_odd_rows(spark):
    long = "ÿ" * 30_000
    rows = [(1, None), (2, ""), (3, "kurz ab 12345678"), (None, "Straßenbahn strassenbahn"), (None, "Straßenbahn"), (4, f"{long} {long} {long}a {long}a"), (5, "ABCDEFG abcdefg ÀBCDEFG àbcdefg× àbcdefg"), (5, "ABCDEFG abcdefg ÀBCDEFG àbcdefg× àbcdefg")]
    rows += [(6, "listener " * 400), (7, "listenes " * 30 + "listeness " * 2 + "enlister " * 40), (8, "listenet " * 400), (9, "aaaaaaaa " * 300 + "aaaaaaa " * 20 + "aaaaaaaaa " * 2)]
    check(spark, rows)


def test_empty_table(spark):
    assert spelling_variants(spark.createDataFrame([], SCHEMA)).collect() == []
    assert spelling_variants(spark.createDataFrame([(1, "short words only", "", 0, "")], SCHEMA)).collect() == []


def test_chain_of_forms(spark):
    chain = [(f"w{i:02}", f"w{i + 1:02}" if i < 20 else None) for i in range(21)]
    got = roots(spark.createDataFrame(chain, "word string, form string")).collect()
    assert {r.root for r in got} == {"w20"} and len(got) == 21


def test_keys_are_equal_for_anagrams_and_pairs_come_once(spark):
    df = spark.createDataFrame([("listen é", 1), ("silent é", 1), ("éilent s", 1)], "word string, n long")
    assert df.select(F.countDistinct(anagram_key("word"))).first()[0] == 1
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(7, 9))) for _ in range(300)})
    got = [(r.word, r.near) for r in near_pairs(spark.createDataFrame([(w, 2) for w in words], "word string, n long")).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in words for b in words if a != b and near(a, b)}


@pytest.mark.parametrize("parts", [1, 50])
def test_same_rows_at_any_partitioning(spark, parts):
    rows = [(i, "listener listenes enlister lostener " * (1 + i % 5)) for i in range(40)]
    docs = spark.createDataFrame([(*r, "", 0, "") for r in rows], SCHEMA).repartition(parts)
    assert sorted((tuple(r) for r in spelling_variants(docs).collect()), key=str) == slow_variants(rows)
