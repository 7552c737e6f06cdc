"""Reports as rows of text, written by Spark's writers: JSON, text, XML and HTML.

A report row has ``doc_id``, ``path``, ``status``, ``profiles`` (array of structs with profile_id,
compliant, checks_executed, failed_rules, unsupported_rules, passed_checks and failures).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.rules import retained_failures
from quillspark.shared import materialise

# One sentence per status.
STATEMENTS = {
    "valid": "The document complies with the profile.",
    "invalid": "The document does not comply with the profile.",
    "incomplete": "The document could not be checked completely.",
    "encrypted": "The document is encrypted.",
    "parseFailed": "The document could not be parsed.",
}
FIRST = 5


UNSUPPORTED = "array<struct<profile_id:string,rule_id:string,reason:string>>"
FEATURES = "array<struct<family:string,field:string,bool_value:boolean,number_value:double,string_value:string,redacted:boolean>>"
POLICY = "array<struct<rule_id:string,passed:boolean>>"


def build_reports(statuses: DataFrame, accounts: DataFrame, failures: DataFrame, unsupported: DataFrame | None = None, warnings: DataFrame | None = None, features: DataFrame | None = None, policies: DataFrame | None = None) -> DataFrame:
    """One nested report per document; *failures* are those retained under a cap, so lists stay bounded.

    *unsupported* (``doc_id``, ``profile_id``, ``rule_id``, ``reason``), *warnings* (``doc_id``, ``warning``),
    *features* (as extracted) and *policies* (``doc_id``, ``rule_id``, ``passed``) fill further lists, in order
    of their text; they are bounded by rules, families and caps, not by the objects.
    """
    listed = F.array_sort(F.collect_list(F.struct("ordinal", "rule_id", "identity_key")))
    own = failures.groupBy("doc_id", "profile_id").agg(listed.alias("failures"))
    profile = F.struct("profile_id", "compliant", "checks_executed", "failed_rules", "unsupported_rules", "passed_checks", F.coalesce("failures", F.array().cast("array<struct<ordinal:int,rule_id:string,identity_key:string>>")).alias("failures"))
    profiles = accounts.join(own, ["doc_id", "profile_id"], "left").groupBy("doc_id").agg(F.array_sort(F.collect_list(profile)).alias("profiles"))
    rows = statuses.join(profiles, "doc_id", "left")
    more = {
        "unsupported": (unsupported, F.struct("profile_id", "rule_id", "reason"), UNSUPPORTED),
        "warnings": (warnings, F.col("warning"), "array<string>"),
        "features": (features, F.struct("family", "field", "bool_value", "number_value", "string_value", "redacted"), FEATURES),
        "policy": (policies, F.struct("rule_id", "passed"), POLICY),
    }
    for name, (frame, item, kind) in more.items():
        none = F.array().cast(kind)
        if frame is None:
            rows = rows.withColumn(name, none)
        else:
            rows = rows.join(frame.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).cast(kind).alias(name)), "doc_id", "left").withColumn(name, F.coalesce(name, none))
    return rows.select("doc_id", F.col("doc_id").cast("string").alias("path"), "status", "profiles", *more)


def redacted(reports: DataFrame) -> DataFrame:
    return reports.withColumn("path", F.lit(None).cast("string"))


def as_json(reports: DataFrame, pretty: bool = False) -> DataFrame:
    """Camel-case JSON, one document a row."""
    profiles = F.transform(
        "profiles",
        lambda p: F.struct(p["profile_id"].alias("profileId"), p["compliant"].alias("isCompliant"), p["checks_executed"].alias("checksExecuted"), p["failed_rules"].alias("failedRules"), p["unsupported_rules"].alias("unsupportedRules"), p["failures"].alias("failedAssertions")),
    )
    return reports.select("doc_id", F.to_json(F.struct(F.struct("path").alias("source"), "status", profiles.alias("profileReports")), {"pretty": "true"} if pretty else {}).alias("value"))


def as_text(reports: DataFrame) -> DataFrame:
    """``path: status``, profiles, counts, and the first five failures of each document."""
    total = lambda name: F.aggregate("profiles", F.lit(0).cast("bigint"), lambda a, p: a + p[name])
    flat = F.slice(F.flatten(F.transform("profiles", lambda p: p["failures"])), 1, FIRST)
    lines = F.transform(flat, lambda f: F.concat(F.lit("  "), f["rule_id"], F.lit(" at "), F.coalesce(f["identity_key"], F.lit("unknown"))))
    names = F.array_join(F.transform("profiles", lambda p: p["profile_id"]), ", ")
    value = F.concat_ws("\n", F.concat(F.coalesce("path", F.lit("<memory>")), F.lit(": "), F.col("status")), F.concat(F.lit("profiles: "), names), F.format_string("checks: %d passed, %d failed, %d unsupported", total("checks_executed") - total("failed_rules"), total("failed_rules"), total("unsupported_rules")), F.array_join(lines, "\n"))
    extra = F.concat(
        F.transform("unsupported", lambda u: F.concat(F.lit("  unsupported "), u["rule_id"], F.lit(": "), F.coalesce(u["reason"], F.lit("")))),
        F.transform("warnings", lambda w: F.concat(F.lit("  warning: "), w)),
        F.when(F.size("features") > 0, F.array(F.format_string("features: %d", F.size("features")))).otherwise(F.array().cast("array<string>")),
        F.transform("policy", lambda p: F.concat(F.lit("  policy "), p["rule_id"], F.when(p["passed"], ": passed").otherwise(": failed"))),
    )
    whole = F.rtrim(value)
    return reports.select("doc_id", F.when(F.size(extra) > 0, F.concat_ws("\n", whole, F.array_join(extra, "\n"))).otherwise(whole).alias("value"))


def xml_text(value: Column) -> Column:
    """Escaped text; characters that XML 1.0 forbids are an error, which ends the query."""
    escaped = F.replace(F.replace(F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    illegal = F.rlike(value, F.lit("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]"))
    return F.when(illegal, F.raise_error(F.lit("a character that XML does not allow"))).otherwise(escaped)


def statement(status: Column) -> Column:
    pairs = [F.lit(x) for item in STATEMENTS.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), status), F.lit(""))


def _xml_profile(p: Column) -> Column:
    failed = F.array_join(F.transform(p["failures"], lambda f: F.concat(F.lit('<check rule="'), xml_text(f["rule_id"]), F.lit('" location="'), xml_text(F.coalesce(f["identity_key"], F.lit("unknown"))), F.lit('"/>'))), "")
    return F.concat(
        F.lit('<validationReport profileName="'), xml_text(p["profile_id"]), F.lit('" isCompliant="'), p["compliant"].cast("string"), F.lit('"><details passedChecks="'), (p["checks_executed"] - F.size(p["failures"])).cast("string"), F.lit('" failedChecks="'), p["failed_rules"].cast("string"),
        F.lit('" unsupportedRules="'), p["unsupported_rules"].cast("string"), F.lit('"/>'), failed, F.lit("</validationReport>"),
    )


def xml_feature_value(f: Column) -> Column:
    """A feature's value by its type; a redacted string has its bytes only."""
    typed = lambda kind, inner: F.concat(F.lit(f'<value type="{kind}">'), inner, F.lit("</value>"))
    return (
        F.when(f["redacted"] & f["number_value"].isNotNull(), F.concat(F.lit('<value type="redactedString" bytes="'), f["number_value"].cast("bigint").cast("string"), F.lit('"></value>')))
        .when(f["bool_value"].isNotNull(), typed("bool", f["bool_value"].cast("string")))
        .when(f["number_value"].isNotNull(), typed("number", f["number_value"].cast("string")))
        .when(f["string_value"].isNotNull(), typed("string", xml_text(f["string_value"])))
        .otherwise('<value type="null"></value>')
    )


def _xml_extras() -> Column:
    features = F.array_join(F.transform("features", lambda f: F.concat(F.lit('<feature family="'), xml_text(f["family"]), F.lit('" field="'), xml_text(f["field"]), F.lit('">'), xml_feature_value(f), F.lit("</feature>"))), "")
    policy = F.array_join(F.transform("policy", lambda p: F.concat(F.lit('<policyRule id="'), xml_text(p["rule_id"]), F.lit('" passed="'), p["passed"].cast("string"), F.lit('"/>'))), "")
    warnings = F.array_join(F.transform("warnings", lambda w: F.concat(F.lit("<warning>"), xml_text(w), F.lit("</warning>"))), "")
    wrap = lambda name, inner: F.when(inner != "", F.concat(F.lit(f"<{name}>"), inner, F.lit(f"</{name}>"))).otherwise("")
    return F.concat(wrap("featuresReport", features), wrap("policyReport", policy), wrap("warnings", warnings))


CHECK_ORDER = ["doc_id", "profile_id", "part", "place", "deferred", "visit_seq", "rule_pos", "identity_key"]


def check_lines(outcomes: DataFrame, most: int | None, passed: bool = False) -> DataFrame:
    """The assertions of each document and profile as lines of XML, in ``CHECK_ORDER``.

    ``part`` 0 is ``failedChecks``, with at most *most* failures of a rule (None: all), ``part`` 1, only if *passed*
    asks for it, is ``passedChecks``, with all of them.  ``place`` 0 opens an element, 1 is a check and 2 closes
    it; a document without such checks has no element.  The lines are rows of their own, so that a document with
    a third of all checks is no list in one row and its range is sorted by many tasks.
    """
    own = ["doc_id", "profile_id", "deferred", "visit_seq", "rule_pos", "identity_key", "rule_id"]
    kept = retained_failures(outcomes, most).select(*own, F.lit(0).alias("part"))
    if passed:
        kept = kept.unionByName(outcomes.filter("outcome = 'passed'").select(*own, F.lit(1).alias("part")))
    kept = materialise(kept, "report-checks")  # both unions below ask it
    status = F.when(F.col("part") == 0, "failed").otherwise("passed")
    check = F.concat(F.lit('<check ruleId="'), xml_text(F.col("rule_id")), F.lit('" status="'), status, F.lit('" location="'), xml_text(F.coalesce("identity_key", F.lit("unknown"))), F.lit('"/>'))
    lines = kept.select("doc_id", "profile_id", "part", F.lit(1).alias("place"), "deferred", "visit_seq", "rule_pos", "identity_key", check.alias("value"))
    element = F.concat(status, F.lit("Checks>"))
    ends = kept.select("doc_id", "profile_id", "part").distinct().withColumn("end", F.explode(F.array(F.struct(F.lit(0).alias("place"), F.concat(F.lit("<"), element).alias("value")), F.struct(F.lit(2).alias("place"), F.concat(F.lit("</"), element).alias("value")))))
    return lines.unionByName(ends.select("doc_id", "profile_id", "part", "end.*"), allowMissingColumns=True)


def write_checks(outcomes: DataFrame, most: int | None, path: str, passed: bool = False) -> None:
    """Write :func:`check_lines` in order, a part file each range; never over an existing folder."""
    check_lines(outcomes, most, passed).orderBy(*CHECK_ORDER).select("value").write.mode("error").text(path)


def as_xml(reports: DataFrame) -> DataFrame:
    """One ``job`` element a document; a document without profiles has one empty validation report."""
    inside = F.when(F.size("profiles") > 0, F.array_join(F.transform("profiles", _xml_profile), "")).otherwise('<validationReport profileName="" isCompliant="false"><details passedChecks="0" failedChecks="0" unsupportedRules="0"/></validationReport>')
    value = F.concat(F.lit("<job><item><name>"), xml_text(F.coalesce("path", F.lit(""))), F.lit("</name></item><statement>"), statement(F.col("status")), F.lit("</statement>"), inside, _xml_extras(), F.lit("</job>"))
    return reports.select("doc_id", value.alias("value"))


def as_raw_xml(reports: DataFrame) -> DataFrame:
    """One ``processorResult`` element a document: its item, the reports of its profiles, features, policy and warnings."""
    profiles = F.coalesce(F.array_join(F.transform("profiles", _xml_profile), ""), F.lit(""))
    value = F.concat(F.lit('<processorResult status="'), F.col("status"), F.lit('"><item><name>'), xml_text(F.coalesce("path", F.lit(""))), F.lit("</name></item>"), profiles, _xml_extras(), F.lit("</processorResult>"))
    return reports.select("doc_id", value.alias("value"))


def as_html_rows(reports: DataFrame) -> DataFrame:
    """Table rows of the HTML report; a page puts them between a head and a foot."""
    names = F.array_join(F.transform("profiles", lambda p: p["profile_id"]), ", ")
    return reports.select("doc_id", F.concat(F.lit("<tr><td>"), xml_text(F.coalesce("path", F.lit(""))), F.lit("</td><td>"), F.col("status"), F.lit("</td><td>"), xml_text(names), F.lit("</td></tr>")).alias("value"))


RENDERERS = {"json": as_json, "jsonPretty": lambda r: as_json(r, True), "text": as_text, "xml": as_xml, "rawXml": as_raw_xml, "html": as_html_rows}

# What stands before and after the documents of a batch.
_XML_HEAD = '<?xml version="1.0" encoding="utf-8"?>'
BATCH = {
    "json": ('{"items":[', "]"),
    "text": ("", ""),
    "xml": (_XML_HEAD + "<report><jobs>", "</jobs>"),
    "rawXml": (_XML_HEAD + "<rawReport><processorResults>", "</processorResults>"),
    "html": ("<!DOCTYPE html><html><body><table>", "</table>"),
}


def batch_lines(reports: DataFrame, summary: DataFrame, form: str) -> DataFrame:
    """A batch as lines in order of ``part``, ``doc_id``: the head, a line for each document, and the foot with the summary.

    *summary* is the one row of ``rules.batch_summary``.  Written in this order, the part files one after
    the other are the report.
    """
    if form not in BATCH:
        raise ValueError(f"unknown format {form}")
    head, foot = BATCH[form]
    names = [c for c in summary.columns]
    camel = lambda name: name.split("_")[0] + "".join(x.title() for x in name.split("_")[1:])
    if form == "json":
        ending = F.concat(F.lit(foot + ',"summary":'), F.to_json(F.struct(*[F.col(c).alias(camel(c)) for c in names])), F.lit("}"))
    elif form == "text":
        ending = F.concat_ws(", ", *[F.concat(F.lit(camel(c) + ": "), F.col(c).cast("string")) for c in names])
    elif form == "html":
        ending = F.concat(F.lit(foot + "<p>"), F.concat_ws(", ", *[F.concat(F.lit(camel(c) + ": "), F.col(c).cast("string")) for c in names]), F.lit("</p></body></html>"))
    else:
        attributes = F.concat(*[F.concat(F.lit(f' {camel(c)}="'), F.col(c).cast("string"), F.lit('"')) for c in names])
        ending = F.concat(F.lit(foot + "<batchSummary"), attributes, F.lit("/></report>" if form == "xml" else "/></rawReport>"))
    rows = RENDERERS[form](reports).select(F.lit(1).alias("part"), F.col("doc_id").cast("string").alias("doc_id"), "value")
    if form == "json":  # a comma before every document but the first; written, so that the reports are made once
        rows = materialise(rows, "report-lines")
        first = rows.agg(F.min("doc_id")).first()[0]
        rows = rows.withColumn("value", F.when(F.col("doc_id") == F.lit(first), F.col("value")).otherwise(F.concat(F.lit(","), F.col("value"))))
    begin = summary.select(F.lit(0).alias("part"), F.lit("").alias("doc_id"), F.lit(head).alias("value"))
    end = summary.select(F.lit(2).alias("part"), F.lit("").alias("doc_id"), ending.alias("value"))
    return begin.unionByName(rows).unionByName(end).filter("value <> ''")


def write_batch(reports: DataFrame, summary: DataFrame, form: str, path: str) -> None:
    """Write a batch in order, a part file each range of documents; never over an existing folder."""
    batch_lines(reports, summary, form).orderBy("part", "doc_id").select("value").write.mode("error").text(path)


def write_reports(reports: DataFrame, form: str, path: str) -> None:
    """Write reports in parallel, a part file each task; never over an existing folder."""
    if form not in RENDERERS:
        raise ValueError(f"unknown format {form}")
    RENDERERS[form](reports).select("value").write.mode("error").text(path)


def write_comparison(rows: DataFrame, summary: DataFrame, folder: str) -> None:
    """Compared *rows*, their one-row *summary* and what blocks a release, as JSON in three new folders below *folder*.

    ``drift`` has the rows that don't match and weren't expected to drift, and the false-compliant ones.  An empty
    table writes empty folders.
    """
    base = folder.rstrip("/")
    rows.write.mode("error").json(f"{base}/corpus")
    summary.write.mode("error").json(f"{base}/summary")
    rows.filter("release_blocking").write.mode("error").json(f"{base}/drift")
