"""Filter interaction audit: what each of five filters removes in every order, from one cube.

1. Each document gives five failure flags in the task that reads it.  Whether a smaller id has the same
   text is known from the smallest id of each text digest; a row is looked up by (digest, id), so that a
   text with millions of copies is not one key of the join.
2. Counts of (part, flags), at most 32 for a part, go through SQL's CUBE over the five flags and part.
   The row of a grouping set whose selected flags are all false counts the survivors of that subset.
3. Subsets that differ in one filter are joined: 80 pairs for a part give what the filter removes after
   the others.  The 600 steps of the 120 orders look their pair up.

The pair from no filter at all tells how many documents fail a filter, that from the other four how many
fail it alone; a filter's sum over all orders weighs each pair with the orders that pass through it.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialise, table, text_or_empty

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITALS_PERCENT = 100, 80, 10
SYMBOLS = r"[#$%&*|]"
_ALL = 2 ** len(FILTERS) - 1


def bit(letter: str) -> int:
    """A filter's bit in a subset, the first filter's being the highest as in ``grouping_id``."""
    return 1 << (len(FILTERS) - 1 - FILTERS.index(letter))


def failure_flags(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``part``, ``A`` to ``E`` (true: fails) for each row of *docs* (``doc_id``, ``text``, ``lang``).

    Null text counts as empty, null lang as the empty string.  A text without words has no share of distinct
    words or capitals to fail by.  E compares whole texts by SHA-256; rows with the same id and text don't
    fail each other, and a null id neither fails nor makes another row fail.  Very long texts are read
    whole.  Other columns are ignored, whatever their names.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("part"), text_or_empty().alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    n, capitals = F.size("words"), F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    flags = [
        (n < MIN_WORDS).alias("A"),
        (100 * F.size(F.array_distinct("words")) < MIN_DISTINCT_PERCENT * n).alias("B"),
        (100 * capitals.cast("long") > MAX_CAPITALS_PERCENT * F.length("text").cast("long")).alias("C"),
        F.col("text").rlike(SYMBOLS).alias("D"),
    ]
    # written, so that texts are read once
    light = materialise(rows.select("doc_id", "part", *flags, F.unhex(F.sha2("text", 256)).alias("digest")), "filter-audit-flags")
    firsts = materialise(light.groupBy("digest").agg(F.min("doc_id").alias("first_id")), "filter-audit-firsts").withColumnRenamed("digest", "first_digest")
    met = light.join(firsts, (F.col("digest") == F.col("first_digest")) & (F.col("doc_id") == F.col("first_id")), "left")
    return met.select("doc_id", "part", *FILTERS[:4], (F.col("first_id").isNull() & F.col("doc_id").isNotNull()).alias("E"))


def survivors(counts: DataFrame) -> DataFrame:
    """``part``, ``A`` to ``E``, ``n``, ``good``, ``toxic`` -> those three for each part and ``subset`` of filters, zeros included."""
    cube = counts.cube(*FILTERS, "part").agg(F.grouping_id().alias("gid"), *[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    none_fails = ~F.greatest(*[F.coalesce(F.col(f), F.lit(False)) for f in FILTERS])
    kept = cube.filter((F.col("gid").bitwiseAND(1) == 0) & none_fails)
    kept = kept.select("part", (_ALL - F.shiftright("gid", 1)).cast("int").alias("subset"), "n", "good", "toxic")
    every = counts.select("part").distinct().withColumn("subset", F.explode(F.sequence(F.lit(0), F.lit(_ALL))))
    return every.join(kept, ["part", "subset"], "left").na.fill(0, ["n", "good", "toxic"])


def _pairs(kept: DataFrame) -> DataFrame:
    """What each filter removes from the survivors of each subset without it: 80 rows for a part."""
    spark = kept.sparkSession
    known = [(s, f, s | bit(f), factorial(bin(s).count("1")) * factorial(4 - bin(s).count("1"))) for f in FILTERS for s in range(_ALL + 1) if not s & bit(f)]
    pairs = spark.createDataFrame(known, "before int, filter string, after int, orders long")
    b = kept.select("part", F.col("subset").alias("before"), *[F.col(c).alias(f"{c}_before") for c in ("n", "good", "toxic")])
    a = kept.withColumnRenamed("subset", "after")
    met = b.join(F.broadcast(pairs), "before").join(a, ["part", "after"])
    return met.select("part", "before", "filter", "orders", F.col("n").alias("kept"), (F.col("n_before") - F.col("n")).alias("removed"), (F.col("good_before") - F.col("good")).alias("good_lost"), (F.col("toxic_before") - F.col("toxic")).alias("toxic_lost"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Each part's counts at every step of every order of the five filters.

    *labels* has ``doc_id``, ``quality``, ``toxic``; a document with several labels is good (toxic) if one
    says so, and one without labels is neither.  Null ids have no labels.  Every row of *docs* counts,
    repeats too.  Steps without documents have zeros; an empty table has no part and gives no row.
    Nulls and ties of texts are as in :func:`failure_flags`.
    """
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = failure_flags(docs).join(marks, "doc_id", "left")
    counts = rows.groupBy("part", *FILTERS).agg(F.count("*").alias("n"), F.count(F.when(F.col("good"), 1)).alias("good"), F.count(F.when(F.col("toxic"), 1)).alias("toxic"))
    counts = materialise(counts, "filter-audit-counts")
    pairs = materialise(_pairs(survivors(counts)), "filter-audit-pairs")
    of_filter = pairs.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("before") == 0, F.col("removed"))).alias("fails"),
        F.sum(F.when(F.col("orders") == factorial(4), F.when(F.col("before") != 0, F.col("removed")))).alias("unique_fails"),
        F.sum(F.col("removed") * F.col("orders")).alias("shapley"),
    )
    steps = [("".join(order), i + 1, f, sum(map(bit, order[:i]))) for order in permutations(FILTERS) for i, f in enumerate(order)]
    steps = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, filter string, before int")
    out = F.broadcast(steps).join(pairs, ["filter", "before"]).join(of_filter, ["part", "filter"])
    return out.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Every document at every step of every order, without subsets.
ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS (
  SELECT part, w.doc_id,
         [len(ws) < 100,
          100 * len(list_distinct(ws)) < 80 * len(ws),
          100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t),
          regexp_matches(t, '[#$%&*|]'),
          coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)] AS fails,
         coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
  FROM w LEFT JOIN (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = w.doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
met AS (  -- the step at which each kind of document goes, 6 if it stays
  SELECT *, coalesce(list_min([i FOR i IN [1, 2, 3, 4, 5] IF fails[ascii(substr(filter_order, i, 1)) - 64]]), 6) AS gone FROM c, orders),
s AS (
  SELECT part, filter_order, step::INT AS step, substr(filter_order, step, 1) AS letter, sum(CASE WHEN gone > step THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN gone = step THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN gone < step AND fails[ascii(substr(filter_order, step, 1)) - 64] THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN fails[ascii(substr(filter_order, step, 1)) - 64] AND len([x FOR x IN fails IF x]) = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN gone = step THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN gone = step THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM met, (SELECT unnest([1, 2, 3, 4, 5]) AS step) GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM s
"""
