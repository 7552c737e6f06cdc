"""Spelling variant grouping by anagram hashing (DataFrame functions only).

1. Words are counted where the texts are; a word is one row from there on, however often it occurs.
2. A word's anagram key is the sum of the fifth powers of its code points.  Two words are one addition or
   removal apart only if their keys differ by one letter's value, and one exchange apart only if they
   differ by two letters' values.  Instead of adding every value of the alphabet to every key, a word
   gives its key and its key less each of its letters' values: equal reduced keys are then all of these
   differences (whole with less-one: addition and removal; less-one with less-one: exchange).
3. One edit leaves the first or the last half of a word as it is, so the half goes into the join beside the
   reduced key, which keeps anagrams that share nothing else apart.  A pair that agrees in both halves is
   left to the first.
4. The order of letters is verified by an edit distance of exactly one.
5. A word's form is its near word of largest count; forms are followed to the last by joins that double
   their reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import LOWER, UPPER, materialise, table, text_or_empty

RUN = r"[A-Za-zÀ-ÿ]+"
MIN_LETTERS, MIN_COUNT, MIN_RATIO, DELETE_EVERY = 7, 2, 10, 31
#: Keys are sums modulo this prime, which no run of letters can overflow.
MODULUS = 2**61 - 1


def letter_value(letter: str | Column) -> Column:
    """The fifth power of a letter's code point, a long."""
    code = F.ascii(letter).cast("long")
    return code * code * code * code * code


def words_of(docs: DataFrame) -> DataFrame:
    """``word``, ``n``: the words of all texts of *docs* (``doc_id``, ``text``) that occur at least twice.

    Null and empty texts have none; a null id is written as nothing before the colon.  Runs of letters are
    taken whole, however long, and repeated rows count again.  Other columns are ignored.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text_or_empty(), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.filter(F.length("run") >= MIN_LETTERS).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    h, length = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")), F.length("run")
    place = (h % length).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), place), F.col("run").substr(place + 2, length))
    words = runs.select(F.when(h % DELETE_EVERY == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= MIN_LETTERS)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_COUNT)


def anagram_key(word: str | Column) -> Column:
    """The sum of a word's letter values; equal for anagrams."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda total, letter: F.pmod(total + letter_value(letter), F.lit(MODULUS)))


def _reduced(words: DataFrame) -> DataFrame:
    """Each word as it is and less each of its letters: ``key``, ``half`` (the first or last of what remains), ``last``, ``whole``."""
    letters = F.array_distinct(F.split("word", ""))
    each = words.withColumn("sum", anagram_key("word"))
    each = each.select("word", "n", "sum", F.explode(F.concat(F.array(F.lit(None).cast("string")), letters)).alias("letter"))
    whole = F.col("letter").isNull()
    remains = F.length("word") - F.when(whole, 0).otherwise(1)
    each = each.select("word", "n", F.pmod(F.col("sum") - F.when(whole, 0).otherwise(letter_value("letter")), F.lit(MODULUS)).alias("key"), whole.alias("whole"), remains.alias("remains"))
    first = F.floor(F.col("remains") / 2).cast("int")
    halves = F.array(
        F.struct(F.lit(False).alias("last"), F.substring("word", F.lit(1), first).alias("half")),
        F.struct(F.lit(True).alias("last"), F.substring("word", F.length("word") - (F.col("remains") - first) + 1, F.col("remains")).alias("half")),
    )
    return each.select("word", "n", "key", "whole", "remains", F.explode(halves).alias("h")).select("word", "n", "key", "whole", "remains", "h.last", "h.half")


def near_pairs(words: DataFrame) -> DataFrame:
    """``word``, ``n``, ``near``, ``near_n`` for all ordered pairs of *words* (distinct ``word``, ``n``) one letter apart."""
    rows = materialise(_reduced(words), "spelling-reduced")
    a, b = (rows.select([F.col(c).alias(f"{c}_{side}") for c in rows.columns]) for side in "ab")
    first = F.floor(F.col("remains_a") / 2).cast("int")
    opening = F.substring("word_a", F.lit(1), first) == F.substring("word_b", F.lit(1), first)
    # every pair once: the shorter word is whole, words of equal length come in order
    in_order = ~F.col("whole_b") & (F.col("whole_a") | (F.col("word_a") < F.col("word_b")))
    same = (F.col("key_a") == F.col("key_b")) & (F.col("half_a") == F.col("half_b")) & (F.col("last_a") == F.col("last_b")) & (F.col("remains_a") == F.col("remains_b"))
    met = a.join(b, same & in_order & (~F.col("last_a") | ~opening)).filter(F.levenshtein("word_a", "word_b", 1) == 1)
    pair = [F.struct(F.col(f"word_{x}").alias("word"), F.col(f"n_{x}").alias("n"), F.col(f"word_{y}").alias("near"), F.col(f"n_{y}").alias("near_n")) for x, y in ("ab", "ba")]
    return met.select(F.explode(F.array(*pair)).alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """``word``, ``form`` (null: none) -> ``word``, ``root``: the last of the forms, the word itself if it has none.

    Counts grow tenfold with each form, so there is no cycle; each round doubles the reach.
    """
    reached = materialise(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = materialise(reached.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        reached = new.select("word", "root")
        if new.filter("moved").isEmpty():
            return forms.join(reached, "word", "left").select("word", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Every word of at least seven letters and two occurrences with its near words, form and root.

    ``form`` is the near word of the largest count (ties: the smallest by code points), if that is at least
    ten times the word's count, else null.  An empty table, or one without such words, gives no row.
    Nulls, repeats and long texts are as in :func:`words_of`.
    """
    words = materialise(words_of(docs), "spelling-words")
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    known = words.join(near, "word", "left")
    enough = -F.col("best.less") >= MIN_RATIO * F.col("n")
    forms = known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))
    forms = materialise(forms, "spelling-forms")
    return forms.join(roots(forms.select("word", "form")), "word").select("word", "form", "root", "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


#: Near words share what remains after one letter is taken from one or both; crc32 is worked out bit by bit.
ORACLE_SQL = r"""
WITH RECURSIVE t AS (
  SELECT list_transform(range(256), lambda k: list_reduce(list_prepend(k, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_table),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode(id || ':' || run)) + 1), lambda i: ('0x' || substr(hex(encode(id || ':' || run)), (2 * i - 1)::BIGINT, 2))::BIGINT)),
             lambda c, b: xor(c >> 8, crc_table[xor(c & 255, b) + 1])), 4294967295::BIGINT) AS h
  FROM counted, t),
formed AS (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM formed WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS (SELECT DISTINCT word, n, i AS place, substr(word, 1, i - 1) || substr(word, i + 1) AS remains FROM words, range(1, 100000) r(i) WHERE i <= length(word)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.remains = b.remains AND a.place = b.place AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN less b ON a.word = b.remains
  UNION SELECT b.word, a.word, a.n FROM words a JOIN less b ON a.word = b.remains),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM pairs GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * w.n THEN top END AS form_n,
         CASE WHEN top >= 10 * w.n THEN (SELECT min(p.near) FROM pairs p WHERE p.word = w.word AND p.near_n = top) END AS form
  FROM words w LEFT JOIN best USING (word)),
follow(word, last_form) AS (
  SELECT word, word FROM forms UNION SELECT f.word, g.form FROM follow f JOIN forms g ON g.word = f.last_form WHERE g.form IS NOT NULL)
SELECT word, form, (SELECT last_form FROM follow f JOIN forms g ON g.word = f.last_form WHERE f.word = o.word AND g.form IS NULL) AS root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n
FROM forms o
"""
