"""Roll-ups over a corpus: clusters, coverage, comparison with another validator, gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.derived import REASON_CATEGORIES, reason_category
from quillspark.functions.nested import all_entries


def basis_points(part: Column, whole: Column) -> Column:
    """floor(part * 10000 / whole), 0 for an empty whole."""
    return F.when(whole == 0, F.lit(0).cast("bigint")).otherwise(F.floor(part.cast("bigint") * 10_000 / F.when(whole != 0, whole)).cast("bigint"))


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, 0 for an empty whole."""
    return F.when(whole == 0, F.lit(0).cast("bigint")).otherwise(F.floor(part.cast("bigint") * 100 / F.when(whole != 0, whole)).cast("bigint"))


def clusters(rows: DataFrame, keys: Sequence[str], example: str, examples: int = 3) -> DataFrame:
    """Counts by key with the first examples in sorted order.

    The examples are picked by rank among distinct ones, which Spark prunes in each task; no list of a
    whole cluster is built.
    """
    counted = rows.groupBy(*keys).agg(F.count("*").alias("count"))
    distinct = rows.select(*keys, example).distinct()
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(example))
    some = distinct.withColumn("_nth", nth).filter(F.col("_nth") <= examples)
    picked = some.groupBy(*keys).agg(F.array_sort(F.collect_list(example)).alias("examples"))
    return counted.join(picked, list(keys), "left")


def top_clusters(counted: DataFrame, keys: Sequence[str], most: int = 20) -> DataFrame:
    """The largest clusters, ties by key."""
    return counted.orderBy(F.desc("count"), *keys).limit(most)


def zero_filled(rows: DataFrame, key: str, categories: Sequence[str]) -> DataFrame:
    """Counts of all *categories*, 0 where none occurs."""
    every = rows.sparkSession.createDataFrame([(c,) for c in categories], f"{key} string")
    counted = rows.groupBy(key).agg(F.count("*").alias("_n"))
    return every.join(counted, key, "left").select(key, F.coalesce("_n", F.lit(0)).alias("count"))


def reason_counts(rules: DataFrame, key: str = "flavour") -> DataFrame:
    """*key*, ``category``, ``count``: the rules of each flavour that can't run, by every category of their ``reason``, 0 where none is.

    A flavour whose rules can all run has zeros; one aggregation, whatever the number of categories.
    """
    category = reason_category(F.col("reason"))
    counted = rules.groupBy(key).agg(*[F.count_if(category == c).alias(c) for c in REASON_CATEGORIES])
    every = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("count")) for c in REASON_CATEGORIES]))
    return counted.select(key, every.alias("_c")).select(key, "_c.*")


def coverage(rules: DataFrame, key: str = "flavour") -> DataFrame:
    """Per flavour: rules in all, lowered, bound, unsupported, and the percent that can run."""
    counted = rules.groupBy(key).agg(F.count("*").alias("total"), F.count_if("lowered").alias("lowered"), F.count_if("bound").alias("bound"), F.count_if(F.col("reason").isNotNull()).alias("unsupported"))
    return counted.withColumn("percent", percent(F.col("bound"), F.col("total")))


# Comparison with another validator.  Rows have ``ours`` and ``theirs`` (outcomes, null where a run gave
# none), ``our_run`` and ``their_run`` (completed, timeout or failed) and ``expected`` (a classification or null).


def false_compliant(ours: Column, theirs: Column) -> Column:
    """We say valid, they say invalid; whatever the row is classified as."""
    return F.coalesce((ours == "valid") & (theirs == "invalid"), F.lit(False))


def timed_out(our_run: Column, their_run: Column) -> Column:
    return our_run.eqNullSafe("timeout") | their_run.eqNullSafe("timeout")


def drift_class(ours: Column, theirs: Column, our_run: Column, their_run: Column, expected: Column) -> Column:
    """The first that applies: match, a reviewed false-compliant row, unexpected drift, the expected class.

    Only two completed runs with an outcome each can match.  A false-compliant row may only be excused as
    ``ambiguity`` or owned up to as ``bug``; a timeout is never expected.
    """
    agree = F.coalesce(ours == theirs, F.lit(False)) & our_run.eqNullSafe("completed") & their_run.eqNullSafe("completed")
    return (
        F.when(agree, "match")
        .when(false_compliant(ours, theirs), F.when(expected.isin("ambiguity", "bug"), expected).otherwise("unexpectedDrift"))
        .when(timed_out(our_run, their_run), "unexpectedDrift")
        .otherwise(F.coalesce(expected, F.lit("unexpectedDrift")))
    )


def release_blocking(classification: Column, is_false_compliant: Column, late: Column) -> Column:
    return is_false_compliant | classification.isin("unexpectedDrift", "bug") | late


def compared(rows: DataFrame) -> DataFrame:
    """*rows* with ``classification``, ``false_compliant``, ``timed_out`` and ``release_blocking``."""
    ours, theirs, runs = F.col("ours"), F.col("theirs"), (F.col("our_run"), F.col("their_run"))
    rows = rows.withColumn("classification", drift_class(ours, theirs, *runs, F.col("expected"))).withColumn("false_compliant", false_compliant(ours, theirs)).withColumn("timed_out", timed_out(*runs))
    return rows.withColumn("release_blocking", release_blocking(F.col("classification"), F.col("false_compliant"), F.col("timed_out")))


def comparison_summary(rows: DataFrame) -> DataFrame:
    """One row over :func:`compared` rows: totals, drift, blockers and the match rate in basis points."""
    is_ = lambda x: F.count_if(F.col("classification") == x)
    counted = rows.agg(
        F.count("*").alias("total"), is_("match").alias("matches"), F.count_if(F.col("classification") != "match").alias("mismatches"), F.count_if(~F.col("classification").isin("match", "unexpectedDrift")).alias("classified_mismatches"), is_("unexpectedDrift").alias("unexpected_drift"),
        F.count_if("false_compliant").alias("false_compliant"), F.count_if("release_blocking").alias("release_blocking"), F.count_if("timed_out").alias("timeouts"),
    )
    return counted.withColumn("match_basis_points", basis_points(F.col("matches"), F.col("total")))


def grouped_summaries(rows: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Counts by each dimension alone, in one pass by grouping sets; rows without a value of it don't count."""
    present = lambda f: F.coalesce(*[F.when(F.grouping(d) == 0, f(d)) for d in dimensions])
    grouped = rows.groupingSets([[F.col(d)] for d in dimensions], *[F.col(d) for d in dimensions])
    found = grouped.agg(present(lambda d: F.lit(d)).alias("dimension"), present(lambda d: F.col(d).cast("string")).alias("value"), F.count("*").alias("count"), F.count_if(F.col("classification") == "match").alias("matches"))
    return found.select("dimension", "value", "count", "matches").filter(F.col("value").isNotNull())


def release_gate(rows: DataFrame, least_rows: int, least_basis_points: int = 9_500, require_rows: bool = True) -> DataFrame:
    """One row over compared rows with a ``tier``: whether a release passes, and the real-world tier's size and rate.

    No row of any tier may be false-compliant or drift unexpectedly; the real-world tier (T3) must be large
    enough, if that is required, and match often enough, if it has rows.
    """
    real = F.col("tier").eqNullSafe("T3")
    counted = rows.agg(
        F.count_if("false_compliant").alias("false_compliant"), F.count_if(F.col("classification") == "unexpectedDrift").alias("unexpected_drift"), F.count_if(real).alias("t3_rows"), F.count_if(real & (F.col("classification") == "match")).alias("t3_matches")
    )
    counted = counted.withColumn("t3_basis_points", basis_points(F.col("t3_matches"), F.col("t3_rows")))
    enough = (F.col("t3_rows") >= least_rows) if require_rows else F.lit(True)
    often = (F.col("t3_rows") == 0) | (F.col("t3_basis_points") >= least_basis_points)
    return counted.withColumn("passed", (F.col("false_compliant") == 0) & (F.col("unexpected_drift") == 0) & enough & often)


MAX_EXPECTED_FEATURES, MAX_PRODUCER_BYTES = 64, 256


def invalid_manifest_rows(rows: DataFrame) -> DataFrame:
    """Rows that may not be in a manifest.

    A tier that doesn't fit the licence, a match declared beforehand, no note for another expected class, a bad
    or repeated id; and, where the columns are there, too many ``features`` or a ``producer`` that is too long.
    """
    private = F.col("license") == "private"
    bad = (F.col("tier") == "T3") != private
    bad = bad | F.coalesce(F.col("expected") == "match", F.lit(False)) | (F.col("expected").isNotNull() & F.coalesce(F.trim("note") == "", F.lit(True)))
    if "features" in rows.columns:
        bad = bad | F.coalesce(F.size("features") > MAX_EXPECTED_FEATURES, F.lit(False))
    if "producer" in rows.columns:
        bad = bad | F.coalesce(F.octet_length("producer") > MAX_PRODUCER_BYTES, F.lit(False))
    bad = bad | ~F.rlike("id", F.lit("^[A-Za-z0-9._:-]{1,128}$"))
    many = rows.groupBy("id").count().filter("count > 1").select("id", F.lit(True).alias("_many"))
    return rows.join(many, "id", "left").filter(bad | F.coalesce("_many", F.lit(False))).drop("_many")


def repair_summary(items: DataFrame) -> DataFrame:
    """One row over repair items (``status``): how many of each status, and the worst exit category."""
    is_ = lambda x: F.count_if(F.col("status") == x)
    counted = items.agg(F.count("*").alias("total_files"), is_("succeeded").alias("succeeded"), is_("noAction").alias("no_action"), is_("refused").alias("refused"), is_("failed").alias("failed"))
    return counted.withColumn("category", F.when(F.col("failed") > 0, "internalError").when(F.col("refused") > 0, "processingFailed").otherwise("success"))


def report_outcomes(reports: DataFrame) -> DataFrame:
    """``id``, ``outcome`` of another validator's reports: ``id``, ``json`` (text), ``exit_code``; a report's id is unique.

    ``parseFailed`` where a field failedToParse at any depth is a number above 0, ``encrypted`` where a field encrypted
    is, else by the first boolean field isCompliant: a record's own comes before those of its values, which come
    in order of their keys or places.  What isn't JSON, or has none of these, goes by the exit code (0 valid, 1 invalid, 7
    parseFailed, else null).
    """
    rows = reports.select("id", F.try_parse_json("json").alias("value"))
    fields = all_entries(rows, "value").filter(F.col("key").isin("failedToParse", "encrypted", "isCompliant"))
    kind, holder = F.schema_of_variant("value"), F.slice("order", 1, F.col("depth") - 1)
    number = F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get("value", "$", "double"))
    is_compliant = (F.col("key") == "isCompliant") & (kind == "BOOLEAN")
    found = fields.groupBy("id").agg(
        F.bool_or((F.col("key") == "failedToParse") & (number > 0)).alias("failed"), F.bool_or((F.col("key") == "encrypted") & (number > 0)).alias("locked"), F.min_by(F.when(is_compliant, F.try_variant_get("value", "$", "boolean")), F.when(is_compliant, holder)).alias("compliant")
    )
    code = F.col("exit_code")
    outcome = F.when(F.col("failed"), "parseFailed").when(F.col("locked"), "encrypted").when(F.col("compliant"), "valid").when(~F.col("compliant"), "invalid").when(code == 0, "valid").when(code == 1, "invalid").when(code == 7, "parseFailed")
    return reports.select("id", "exit_code").join(found, "id", "left").select("id", outcome.alias("outcome"))
