"""Rules over objects: outcomes, capped failures, accounting, verdicts and status."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.checked import Checked, error, outcome, over_budget, unsupported


@dataclass(frozen=True)
class Rule:
    profile_id: str
    rule_id: str
    object_type: str
    test: Checked
    message: str = ""
    deferred: bool = False
    #: A rule that can't be bound to a family or property; it counts once in every document's account.
    unsupported: str | None = field(default=None)

    @property
    def bound_test(self) -> Checked:
        """The test, or what stands for one that no object could finish within the budgets."""
        budget = over_budget(self.test)
        return unsupported(budget) if budget else self.test


CHECKS = "array<struct<profile_id:string,rule_pos:int,rule_id:string,deferred:boolean,outcome:string,error:string>>"


def apply_rules(objects: DataFrame, rules: Sequence[Rule], keep: Sequence[str] = ()) -> DataFrame:
    """One row per object and rule of its family or super types, in one pass over *objects*.

    *objects* has ``doc_id``, ``family``, ``supertypes``, ``identity_key``, ``visit_seq`` and the
    properties.  The rules are column expressions, so nothing is joined or shuffled here.
    """
    types = F.array_distinct(F.concat(F.array("family"), F.coalesce("supertypes", F.array().cast("array<string>"))))
    by_type: dict[str, list] = {}
    for i, r in enumerate(rules):
        if r.unsupported is None:
            test = r.bound_test
            made = F.struct(F.lit(r.profile_id).alias("profile_id"), F.lit(i).alias("rule_pos"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.deferred).alias("deferred"), outcome(test).alias("outcome"), error(test).alias("error"))
            by_type.setdefault(r.object_type, []).append(made)
    # a row meets the rules of its own types only: the branches of other types aren't evaluated
    checks = F.lit(None).cast(CHECKS)
    for name, made in by_type.items():
        checks = F.when(F.col("_type") == name, F.array(*made).cast(CHECKS)).otherwise(checks)
    own = ["doc_id", "family", "identity_key", "visit_seq", *keep]
    rows = objects.withColumn("_type", F.explode(F.filter(types, lambda x: x.isin(*by_type)))) if by_type else objects.withColumn("_type", F.lit(None).cast("string")).limit(0)
    return rows.select(*own, F.explode(checks).alias("check")).select(*own, "check.*")


def static_unsupported(spark, rules: Sequence[Rule]) -> DataFrame:
    """A row for each rule that couldn't be bound, numbered as :func:`sorted_unsupported` does."""
    rows = [(r.profile_id, r.rule_id, r.object_type, r.unsupported) for r in rules]
    return sorted_unsupported(spark.createDataFrame(rows, "profile_id string, rule_id string, object_type string, reason string"))


def sorted_unsupported(rules: DataFrame) -> DataFrame:
    """The rules that have a ``reason`` not to be bound, each once, with ``ordinal`` in each profile by id, type and reason."""
    own = ["profile_id", "rule_id", "object_type", "reason"]
    order = Window.partitionBy("profile_id").orderBy("rule_id", "object_type", "reason")
    return rules.filter("reason IS NOT NULL").select(*own).distinct().withColumn("ordinal", F.row_number().over(order))


def retained_failures(outcomes: DataFrame, most: int | None) -> DataFrame:
    """At most *most* failures of each document, profile and rule in visit order (None: all), with their ordinals."""
    failed = outcomes.filter(F.col("outcome") == "failed")
    order = ["deferred", "visit_seq", "rule_pos"]
    if most is not None:
        nth = F.row_number().over(Window.partitionBy("doc_id", "profile_id", "rule_id").orderBy(*order))
        failed = failed.withColumn("_nth", nth).filter(F.col("_nth") <= most).drop("_nth")
    return failed.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id", "profile_id").orderBy(*order)))


def account(outcomes: DataFrame, documents: DataFrame | None = None, rules: Sequence[Rule] = ()) -> DataFrame:
    """Counts per document and profile; failures and rules count checks, and an error counts as a check.

    With *documents* (``doc_id``) each of them has an account under every profile of *rules*, also where no
    rule met one of its objects, and each rule that couldn't be bound counts as unsupported in all of them.
    """
    is_ = lambda x: F.col("outcome") == x
    counted = outcomes.groupBy("doc_id", "profile_id").agg(
        F.count("*").alias("checks_executed"), F.count_if(is_("failed")).alias("failed_rules"), F.count_if(is_("unsupported")).alias("unsupported_rules"), F.count_if(is_("passed") | is_("unsupported")).alias("passed_checks")
    )
    if documents is not None:
        unbound = {r.profile_id: 0 for r in rules}
        for r in rules:
            unbound[r.profile_id] += r.unsupported is not None
        every = F.array(*[F.struct(F.lit(k).alias("profile_id"), F.lit(n).cast("bigint").alias("unbound")) for k, n in unbound.items()])
        base = documents.select("doc_id").distinct().withColumn("p", F.explode(every)).select("doc_id", "p.*")
        counts = ["checks_executed", "failed_rules", "unsupported_rules", "passed_checks"]
        counted = base.join(counted, ["doc_id", "profile_id"], "left").select("doc_id", "profile_id", "unbound", *[F.coalesce(x, F.lit(0)).alias(x) for x in counts])
        counted = counted.withColumn("unsupported_rules", F.col("unsupported_rules") + F.col("unbound")).drop("unbound")
    return counted.withColumn("rules_executed", F.col("checks_executed")).withColumn("compliant", (F.col("failed_rules") == 0) & (F.col("unsupported_rules") == 0))


def document_status(accounts: DataFrame, policies: DataFrame | None = None) -> DataFrame:
    """``incomplete`` if anything is unsupported, else ``valid`` if all profiles comply, else ``invalid``.

    A failed policy (``doc_id``, ``policy_passed``) only turns ``valid`` into ``invalid``.
    """
    status = F.when(F.bool_or(F.col("unsupported_rules") > 0), "incomplete").when(F.bool_and("compliant"), "valid").otherwise("invalid")
    found = accounts.groupBy("doc_id").agg(status.alias("status"))
    if policies is None:
        return found
    joined = found.join(policies.select("doc_id", "policy_passed"), "doc_id", "left")
    return joined.select("doc_id", F.when((F.col("status") == "valid") & (~F.coalesce("policy_passed", F.lit(True))), "invalid").otherwise(F.col("status")).alias("status"))


# Exit codes by status, worst last.
EXIT_CODES = {"valid": 0, "invalid": 1, "parseFailed": 2, "encrypted": 3, "incomplete": 4, "internal": 70}


def exit_code(status):
    code = F.lit(None).cast("int")
    for name, value in EXIT_CODES.items():
        code = F.when(status == name, F.lit(value)).otherwise(code)
    return code


def batch_summary(statuses: DataFrame) -> DataFrame:
    """One row: documents by status, the worst exit code and the exit category."""
    is_ = lambda *x: F.count_if(F.col("status").isin(*x))
    counted = statuses.agg(
        F.count("*").alias("total"), is_("valid").alias("valid"), is_("invalid").alias("invalid"), is_("parseFailed").alias("parse_failed"), is_("encrypted").alias("encrypted"), is_("incomplete").alias("incomplete"), is_("internal").alias("internal_errors"),
        F.coalesce(F.max(exit_code(F.col("status"))), F.lit(0)).alias("exit_code"),
    )
    broken = (F.col("parse_failed") + F.col("encrypted") + F.col("incomplete") + F.col("internal_errors")) > 0
    return counted.withColumn("category", F.when(broken, "processingFailed").when(F.col("invalid") > 0, "validationFailed").otherwise("success"))
