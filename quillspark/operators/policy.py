"""Policies: quantified questions about the features of a document, and feature extraction."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.checked import EPSILON

OPERATORS = ("exists", "absent", "equals", "notEquals", "min", "max")
MAX_RULES = 1024


@dataclass(frozen=True)
class PolicyRule:
    rule_id: str
    family: str
    field: str
    operator: str
    value: bool | float | str | None = None


def check_policies(rules: Sequence[PolicyRule], schema: Mapping[str, Sequence[str]]) -> None:
    """Refuse unknown families and fields, wrong values, and fewer than one or more than 1,024 rules."""
    if not 1 <= len(rules) <= MAX_RULES:
        raise ValueError("a policy has 1 to 1024 rules")
    for r in rules:
        if r.operator not in OPERATORS or r.field not in schema.get(r.family, ()):
            raise ValueError(f"{r.rule_id}: unknown operator, family or field")
        number = isinstance(r.value, (int, float)) and not isinstance(r.value, bool)
        if (r.operator in ("exists", "absent")) != (r.value is None) or r.operator in ("min", "max") and not number:
            raise ValueError(f"{r.rule_id}: wrong value for {r.operator}")


def _typed(value) -> str:
    return "bool_value" if isinstance(value, bool) else "string_value" if isinstance(value, str) else "number_value"


def _holds(r: PolicyRule) -> Column:
    """An aggregate over the features of one document; no feature at all is the empty quantifier."""
    mine = (F.col("family") == r.family) & (F.col("field") == r.field)
    present = mine & F.col("present")
    if r.operator in ("exists", "absent"):
        return (F.count_if(present) > 0) if r.operator == "exists" else (F.count_if(present) == 0)
    value = F.col(_typed(r.value))
    if r.operator in ("equals", "notEquals"):
        same = F.abs(value - F.lit(float(r.value))) < EPSILON if _typed(r.value) == "number_value" else value == F.lit(r.value)
        hits = F.count_if(present & ~F.col("redacted") & same)
        return (hits > 0) if r.operator == "equals" else (hits == 0)
    finite = present & ~F.isnan("number_value")
    return F.count_if(finite & ((F.col("number_value") >= float(r.value)) if r.operator == "min" else (F.col("number_value") <= float(r.value)))) > 0


def evaluate_policies(features: DataFrame, documents: DataFrame, rules: Sequence[PolicyRule]) -> DataFrame:
    """``doc_id``, ``rule_id``, ``passed``, ``matches`` for every document and rule, one aggregation in all.

    *features* is long: ``doc_id``, ``family``, ``field``, ``present``, ``redacted`` and a value by type.
    Documents without features answer as for an empty set.
    """
    aggregates = [F.struct(F.lit(r.rule_id).alias("rule_id"), _holds(r).alias("passed"), F.count_if((F.col("family") == r.family) & (F.col("field") == r.field)).alias("matches")).alias(f"r{i}") for i, r in enumerate(rules)]
    # one row for each document, so that documents without features are there; its nulls match nothing
    empty = documents.select("doc_id").distinct()
    for name, kind in features.dtypes:
        if name != "doc_id":
            empty = empty.withColumn(name, F.lit(None).cast(kind))
    grouped = features.unionByName(empty).groupBy("doc_id").agg(*aggregates)
    return grouped.select("doc_id", F.explode(F.array(*[f"r{i}" for i in range(len(rules))])).alias("r")).select("doc_id", "r.*")


def selected_families(selection: Sequence[str] | str | None, rules: Sequence[PolicyRule] | None) -> Sequence[str] | str | None:
    """Feature families to extract: ``all``, a list, or None; a policy adds its own families to a list and asks for all otherwise."""
    if rules is None:
        return selection
    return "all" if selection in (None, "all") else sorted({*selection, *(r.family for r in rules)})


#: The bound of a policy file, which is read whole.
MAX_POLICY_BYTES = 1024 * 1024


def read_policy(spark, path: str, schema: Mapping[str, Sequence[str]]) -> list[PolicyRule]:
    """Rules of a policy file (JSON: ``rules``, a list of ``id``, ``family``, ``field``, ``operator``, ``value``), checked."""
    row = spark.read.format("binaryFile").load(path).select("length", F.when(F.col("length") <= MAX_POLICY_BYTES, F.col("content")).alias("content")).first()
    if row is None or row["content"] is None:
        raise ValueError("no policy file, or one that is too large")
    found = json.loads(bytes(row["content"]).decode("utf-8"))
    if set(found) - {"schemaVersion", "name", "rules"} or not isinstance(found.get("rules"), list):
        raise ValueError("a policy has rules and no other fields than schemaVersion and name")
    names = {"id", "family", "field", "operator", "value"}
    if any(not isinstance(r, dict) or set(r) - names or not {"id", "family", "field", "operator"} <= set(r) for r in found["rules"]):
        raise ValueError("a policy rule has id, family, field, operator and value")
    rules = [PolicyRule(r["id"], r["family"], r["field"], r["operator"], r.get("value")) for r in found["rules"]]
    check_policies(rules, schema)
    return rules


def policy_report(evaluated: DataFrame) -> DataFrame:
    return evaluated.groupBy("doc_id").agg(F.bool_and("passed").alias("policy_passed"), F.count_if(~F.col("passed")).alias("failed_rules"))


def extract_features(objects: DataFrame, family: str, fields: Mapping[str, str], unredacted: Sequence[str] = ()) -> DataFrame:
    """Long features of a family: strings that aren't allow-listed are given by their byte count alone."""
    made = []
    for name, kind in fields.items():
        column = F.col(name)
        redacted = kind == "string" and name not in unredacted
        made.append(
            F.struct(
                F.lit(name).alias("field"), column.isNotNull().alias("present"), F.lit(redacted).alias("redacted"),
                (column if kind == "bool" else F.lit(None).cast("boolean")).alias("bool_value"),
                (column.cast("double") if kind == "number" else F.octet_length(column).cast("double") if redacted else F.lit(None).cast("double")).alias("number_value"),
                (column if kind == "string" and not redacted else F.lit(None).cast("string")).alias("string_value"),
            )
        )
    return objects.select("doc_id", F.lit(family).alias("family"), F.explode(F.array(*made)).alias("f")).select("doc_id", "family", "f.*")
