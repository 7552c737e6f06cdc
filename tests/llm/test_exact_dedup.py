import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from quillspark.llm.exact_dedup import deduplicated, exact_dedup
from quillspark.llm.common import LOWER, UPPER

SCHEMA = "doc_id long, text string, keep_id string, norm string"
FOLD = str.maketrans(UPPER, LOWER)


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(FOLD)].append(doc_id)
    out, kept = [], set()
    for doc_id, text in rows:
        norm = (text or "").translate(FOLD)
        ids = [i for i in groups[norm] if i is not None]
        keep = max(ids) if ids else None
        stays = doc_id == keep and norm not in kept
        if stays:
            kept.add(norm)
        out.append((doc_id, keep, len(groups[norm]), stays, hashlib.sha256(norm.encode()).hexdigest()))
    return out


def key(row):
    return tuple((x is None, x) for x in row)


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "clash", None) for i, t in rows], SCHEMA)
    got = [tuple(r) for r in exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    left = deduplicated(docs)
    assert left.columns == docs.columns
    assert sorted(((r[0], (r[1] or "").translate(FOLD)) for r in left.collect()), key=key) == sorted(((i, (t or "").translate(FOLD)) for (i, t), b in zip(rows, brute(rows)) if b[3]), key=key)


def test_groups_nulls_repeats_and_long_texts(spark):
    long = "Word " * 40_000
    rows = [(1, "Abc"), (2, "aBC"), (3, "abd"), (4, None), (5, ""), (6, "ÀB"), (7, "àb"), (8, long), (9, long.lower()), (9, long.lower()), (None, "abc"), (None, "solo"), (None, "solo"), (3, "zzz")]
    check(spark, rows)


def test_hot_text_and_shared_head(spark):
    rows = [(i, "same text") for i in range(300)] + [(1000 + i, "h" * 100 + str(i % 7)) for i in range(200)]
    check(spark, rows)


def test_full_comparisons_decide_where_keys_collide(spark):
    """A grouping by digest would give one group for each key here."""
    rows = [(i, f"text {i % 11} of eleven") for i in range(200)] + [(500 + i, f"alone {i}") for i in range(60)] + [(None, "text 3 of ELEVEN")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for collide in (lambda norm: F.lit(0).cast("long"), lambda norm: F.length(norm).cast("long")):
        got = [tuple(r) for r in exact_dedup(docs, key=collide).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
        assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_one_task_does_not_hold_a_hot_group(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'a copy' ELSE concat('own ', id) END AS text")
    found = exact_dedup(docs)
    assert found.filter("kept").count() == 4000 - 1333 and found.filter("group_size = 1334 AND keep_id = 3999").count() == 1334


def test_empty(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    assert deduplicated(spark.createDataFrame([], SCHEMA)).count() == 0
