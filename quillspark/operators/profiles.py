"""Which profiles a document is checked against: claims in its metadata, a choice, or a default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.reports import percent

# The declarations that claim a conformance.
DECLARATIONS = {"http://pdfa.org/declarations/wtpdf#accessibility1.0": "accessibility", "http://pdfa.org/declarations/wtpdf#reuse1.0": "reuse"}


def compatibility_group(family: Column, part: Column) -> Column:
    """Which generation of the format a flavour is about; flavours of both can't be checked together."""
    first = (family == "pdfa") & part.between(1, 3) | (family == "pdfua") & (part == 1)
    return F.when(first, "pdf-1").otherwise("pdf-2")


def declaration_claims(declarations: DataFrame) -> DataFrame:
    """Claims (``doc_id``, ``ordinal``, ``family``, ``part``, ``conformance``) that declaration URIs (``doc_id``, ``ordinal``, ``uri``) make."""
    known = F.element_at(F.create_map(*[F.lit(x) for item in DECLARATIONS.items() for x in item]), F.col("uri"))
    return declarations.select("doc_id", "ordinal", F.lit("wtpdf").alias("family"), F.lit(1).alias("part"), known.alias("conformance")).filter("conformance IS NOT NULL")


def claimed_declarations(claims: DataFrame) -> DataFrame:
    """The URIs behind claims of that family, sorted, as a list per document."""
    back = {v: k for k, v in DECLARATIONS.items()}
    uri = F.element_at(F.create_map(*[F.lit(x) for item in back.items() for x in item]), F.col("conformance"))
    return claims.filter("family = 'wtpdf'").groupBy("doc_id").agg(F.array_sort(F.collect_set(uri)).alias("declarations"))


def family_present(claims: DataFrame, family: str) -> DataFrame:
    return claims.groupBy("doc_id").agg(F.bool_or(F.col("family") == family).alias("present"))


def detect_profiles(documents: DataFrame, claims: DataFrame, catalogue: DataFrame, default: str | None = None) -> DataFrame:
    """``doc_id``, ``ordinal``, ``profile_id``, ``outcome`` for every document and claim.

    *claims* has ``doc_id``, ``ordinal``, ``family``, ``part``, ``conformance`` (null or empty are the same);
    *catalogue* the last three and ``profile_id``.  A claim is ``selected`` if its profile is in the group
    of the document's first one, ``incompatible`` otherwise, ``unsupported`` without a profile.  A document
    without any profile falls back on *default* (``fallback``), or has ``none``.
    """
    same = ["family", "part", "conformance"]
    plain = F.coalesce("conformance", F.lit(""))
    known = catalogue.select("family", "part", plain.alias("conformance"), "profile_id")
    rows = claims.withColumn("conformance", plain).join(known, same, "left").withColumn("group", F.when(F.col("profile_id").isNotNull(), compatibility_group(F.col("family"), F.col("part"))))
    # a document has a handful of claims; the first group is a partial aggregate
    first = rows.filter("group IS NOT NULL").groupBy("doc_id").agg(F.min_by("group", "ordinal").alias("first_group"))
    judged = documents.select("doc_id").join(first, "doc_id", "left").join(rows, "doc_id", "left")
    outcome = F.when(F.col("group") == F.col("first_group"), "selected").when(F.col("group").isNotNull(), "incompatible").when(F.col("ordinal").isNotNull(), "unsupported")
    listed = judged.select("doc_id", "ordinal", F.when(F.col("group") == F.col("first_group"), F.col("profile_id")).alias("profile_id"), outcome.alias("outcome")).filter("outcome IS NOT NULL")
    without = documents.select("doc_id").join(first.select("doc_id"), "doc_id", "left_anti")
    instead = without.select("doc_id", F.lit(None).cast("int").alias("ordinal"), F.lit(default).cast("string").alias("profile_id"), F.lit("fallback" if default else "none").alias("outcome"))
    return listed.unionByName(instead)


def select_profiles(documents: DataFrame, selections: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Explicit choices (``doc_id`` and a flavour) -> ``profile_id``; a document without a choice, or with one that has no profile, has none."""
    plain = F.coalesce("conformance", F.lit(""))
    known = catalogue.select("family", "part", plain.alias("conformance"), "profile_id")
    chosen = selections.withColumn("conformance", plain).join(known, ["family", "part", "conformance"], "left").select("doc_id", "profile_id")
    return documents.select("doc_id").join(chosen, "doc_id", "left")


def catalogue_entries(versions: DataFrame, rules: DataFrame) -> DataFrame:
    """The catalogue: of each profile its newest version, with what of its rules can run.

    *versions* has ``profile_id``, ``version`` (dotted numbers), ``family``, ``part``, ``conformance``, ``source``;
    *rules* ``profile_id``, ``version``, ``rule_id``, ``reason`` (null if the rule can run).  Versions are compared number by
    number, so 1.10 is newer than 1.9; of equal ones the least ``source`` stands.  A rule listed twice counts once,
    unsupported if any of its rows is.  A profile without rules covers nothing, a version that isn't dotted
    numbers is the oldest, and rules of other versions or unknown profiles don't count.
    """
    numbers = F.transform(F.split("version", "\\."), lambda x: x.try_cast("bigint"))
    order = F.when(F.rlike("version", F.lit(r"^\d{1,18}(\.\d{1,18})*$")), numbers)
    body = F.struct("version", "family", "part", F.coalesce("conformance", F.lit("")).alias("conformance"), "source")
    ranked = versions.select("profile_id", F.coalesce(order, F.array(F.lit(-1).cast("bigint"))).alias("_order"), "source", body.alias("entry"))
    newest = ranked.groupBy("profile_id").agg(F.max("_order").alias("_order")).join(ranked, ["profile_id", "_order"]).groupBy("profile_id").agg(F.min_by("entry", F.struct("source", F.col("entry.version"), F.to_json("entry"))).alias("entry"))
    one = rules.groupBy("profile_id", "version", "rule_id").agg(F.bool_or(F.col("reason").isNotNull()).alias("_unsupported"))
    counted = one.groupBy("profile_id", "version").agg(F.count("*").alias("rules"), F.count_if("_unsupported").alias("unsupported"))
    found = newest.select("profile_id", "entry.*").join(counted, ["profile_id", "version"], "left").fillna(0, ["rules", "unsupported"])
    runs = F.col("rules") - F.col("unsupported")
    return found.withColumn("executable", runs).withColumn("percent", percent(runs, F.col("rules")))


def family_key(policy: Column, family: Column) -> Column:
    """Under what a corpus row is counted: ``auto`` for a policy that detects, else the flavour's family."""
    return F.when(policy.startswith("auto"), "auto").otherwise(family)
