"""The registered queries of the engine and the SQL that must give the same rows.

The driver's tables stand in for model objects: ``documents`` and ``pages`` for documents and pages,
``conversations`` for the ordered children of a document, ``events`` for the operators of a content
stream, ``lineitem`` and ``orders`` for objects with references, ``labels`` for facts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import checked as c
from quillspark.functions import derived
from quillspark.operators import accessibility, content, hierarchy, joins, metadata, model, policy, profiles, reports, rules, sinks
from quillspark.plans.registry import ORACLE_SQL, QUERIES, query, table
from quillspark.shared import materialise

__all__ = ["ORACLE_SQL", "QUERIES"]

# Rules over documents.

PROFILE = "corpus-1a"


def document_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.lit("document").alias("family"), F.array(F.lit("object")).alias("supertypes"), F.concat(F.lit("document:"), "doc_id").alias("identity_key"), F.lit(0).alias("visit_seq"), "text", "lang", "source", "n_chars")


def document_rules() -> list[rules.Rule]:
    text, lang, n = c.prop("text", "string"), c.prop("lang", "string"), c.prop("n_chars", "number")
    return [
        rules.Rule(PROFILE, "doc-has-text", "document", c.not_(c.is_empty(text))),
        rules.Rule(PROFILE, "doc-lang-known", "document", c.exists_(*[c.eq(lang, c.lit(x)) for x in ("en", "de", "fr", "es")])),
        rules.Rule(PROFILE, "doc-size", "document", c.and_(c.ge(n, c.lit(40)), c.le(n, c.lit(20_000)))),
        rules.Rule(PROFILE, "doc-no-table", "object", c.choose(c.eq(lang, c.lit("en")), c.not_(c.contains(text, c.lit(" | "))), c.lit(True))),
        rules.Rule(PROFILE, "doc-no-links", "document", c.not_(c.matches(text, "https?://"))),
    ]


_OUTCOMES = """
WITH o AS (
  SELECT doc_id, unnest(['doc-has-text', 'doc-lang-known', 'doc-size', 'doc-no-table', 'doc-no-links']) AS rule_id,
         unnest([0, 1, 2, 3, 4]) AS rule_pos,
         unnest([
           CASE WHEN text IS NULL THEN 'unsupported' WHEN strlen(text) > 0 THEN 'passed' ELSE 'failed' END,
           CASE WHEN lang IN ('en', 'de', 'fr', 'es') THEN 'passed' ELSE 'failed' END,
           CASE WHEN n_chars IS NULL THEN 'unsupported' WHEN n_chars BETWEEN 40 AND 20000 THEN 'passed' ELSE 'failed' END,
           CASE WHEN lang = 'en' AND text IS NULL THEN 'unsupported' WHEN lang = 'en' AND contains(text, ' | ') THEN 'failed' ELSE 'passed' END,
           CASE WHEN text IS NULL OR strlen(text) > 4096 THEN 'unsupported' WHEN regexp_matches(text, 'https?://') THEN 'failed' ELSE 'passed' END
         ]) AS outcome
  FROM documents
), a AS (
  SELECT doc_id, count(*) AS checks_executed, count(*) FILTER (outcome = 'failed') AS failed_rules, count(*) FILTER (outcome = 'unsupported') AS unsupported_rules FROM o GROUP BY doc_id
), s AS (
  SELECT doc_id, CASE WHEN unsupported_rules > 0 THEN 'incomplete' WHEN failed_rules = 0 THEN 'valid' ELSE 'invalid' END AS status FROM a
)
"""


@query(_OUTCOMES + "SELECT doc_id, rule_id, outcome FROM o")
def rule_outcomes(spark, sf_dir):
    return rules.apply_rules(document_objects(spark, sf_dir), document_rules()).select("doc_id", "rule_id", "outcome")


@query(_OUTCOMES + f"SELECT doc_id, '{PROFILE}' AS profile_id, checks_executed, checks_executed AS rules_executed, failed_rules, unsupported_rules, checks_executed - failed_rules AS passed_checks, failed_rules = 0 AND unsupported_rules = 0 AS compliant FROM a")
def rule_accounting(spark, sf_dir):
    return rules.account(rules.apply_rules(document_objects(spark, sf_dir), document_rules()))


@query(_OUTCOMES + "SELECT doc_id, status FROM s")
def rule_verdict(spark, sf_dir):
    return rules.document_status(rules.account(rules.apply_rules(document_objects(spark, sf_dir), document_rules())))


@query(
    _OUTCOMES
    + """SELECT count(*) AS total, count(*) FILTER (status = 'valid') AS valid, count(*) FILTER (status = 'invalid') AS invalid, CAST(0 AS BIGINT) AS parse_failed, CAST(0 AS BIGINT) AS encrypted,
    count(*) FILTER (status = 'incomplete') AS incomplete, CAST(0 AS BIGINT) AS internal_errors, max(CASE status WHEN 'valid' THEN 0 WHEN 'invalid' THEN 1 ELSE 4 END) AS exit_code,
    CASE WHEN count(*) FILTER (status = 'incomplete') > 0 THEN 'processingFailed' WHEN count(*) FILTER (status = 'invalid') > 0 THEN 'validationFailed' ELSE 'success' END AS category FROM s"""
)
def batch_summary(spark, sf_dir):
    return rules.batch_summary(rule_verdict(spark, sf_dir))


@query(_OUTCOMES + ", p AS (SELECT doc_id, coalesce(bool_and(toxic = 0), true) AS ok FROM labels GROUP BY doc_id) SELECT s.doc_id, CASE WHEN status = 'valid' AND NOT coalesce(ok, true) THEN 'invalid' ELSE status END AS status FROM s LEFT JOIN p USING (doc_id)")
def verdict_with_policy(spark, sf_dir):
    accounts = rules.account(rules.apply_rules(document_objects(spark, sf_dir), document_rules()))
    policies = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.bool_and(F.col("toxic") == 0).alias("policy_passed"))
    return rules.document_status(accounts, policies)


@query(
    "WITH f AS (SELECT l_suppkey AS doc_id, l_orderkey * 10 + l_linenumber AS visit_seq FROM lineitem WHERE NOT l_quantity < 49), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY visit_seq) AS k FROM f) "
    "SELECT doc_id, visit_seq, CAST(k AS INTEGER) AS ordinal FROM n WHERE k <= 10"
)
def failure_cap(spark, sf_dir):
    objects = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.lit("item").alias("family"), F.array().cast("array<string>").alias("supertypes"), F.lit(None).cast("string").alias("identity_key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("visit_seq"), "l_quantity")
    rule = rules.Rule("p", "quantity-small", "item", c.lt(c.prop("l_quantity", "number"), c.lit(49)))
    return rules.retained_failures(rules.apply_rules(objects, [rule]), 10).select("doc_id", "visit_seq", "ordinal")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_tax) < 2.220446049250313e-16 THEN 'unsupported' WHEN l_discount / l_tax < 1.5 THEN 'passed' ELSE 'failed' END AS outcome FROM lineitem")
def rule_division(spark, sf_dir):
    test = c.lt(c.div(c.prop("l_discount", "number"), c.prop("l_tax", "number")), c.lit(1.5))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", c.outcome(test).alias("outcome"))


@query("WITH r AS (SELECT DISTINCT p_brand AS profile_id, p_type AS rule_id, 'size' || (p_size % 4) AS object_type, CASE p_size % 3 WHEN 1 THEN 'unknown property' WHEN 2 THEN 'unknown link' END AS reason FROM part) SELECT *, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY rule_id, object_type, reason) AS INTEGER) AS ordinal FROM r WHERE reason IS NOT NULL")
def static_unsupported(spark, sf_dir):
    size = F.col("p_size")
    reason = F.when(size % 3 == 1, "unknown property").when(size % 3 == 2, "unknown link")
    return rules.sorted_unsupported(table(spark, sf_dir, "part").select(F.col("p_brand").alias("profile_id"), F.col("p_type").alias("rule_id"), F.concat(F.lit("size"), (size % 4).cast("string")).alias("object_type"), reason.alias("reason")))


@query(_OUTCOMES + f"SELECT documents.doc_id, '{PROFILE}' AS profile_id, coalesce(a.failed_rules, 0) AS failed_rules, coalesce(a.unsupported_rules, 0) + 1 AS unsupported_rules, 'incomplete' AS status FROM (SELECT DISTINCT doc_id FROM documents) documents LEFT JOIN (SELECT * FROM a WHERE doc_id % 3 <> 0) a USING (doc_id)")
def rule_unbound(spark, sf_dir):
    """A rule that can't be bound leaves every document incomplete, also those that no rule touches."""
    made = [*document_rules(), rules.Rule(PROFILE, "doc-pages", "page", c.unsupported("unknown property"), unsupported="unknown property")]
    touched = document_objects(spark, sf_dir).filter("doc_id % 3 <> 0")
    accounts = rules.account(rules.apply_rules(touched, made), table(spark, sf_dir, "documents"), made)
    return accounts.join(rules.document_status(accounts), "doc_id").select("doc_id", "profile_id", "failed_rules", "unsupported_rules", "status")


@query("SELECT doc_id, unnest(['deep', 'large', 'within']) AS rule_id, unnest(['unsupported', 'unsupported', CASE WHEN lang = 'en' THEN 'passed' ELSE 'failed' END]) AS outcome, unnest(['budget exceeded: depth', 'budget exceeded: instructions', NULL]) AS error FROM documents")
def rule_budget(spark, sf_dir):
    lang = c.eq(c.prop("lang", "string"), c.lit("en"))
    deep, large, within = lang, c.or_(*[c.or_(*[lang] * 16)] * 12), lang
    for _ in range(40):
        deep = c.not_(deep)
    for _ in range(14):
        within = c.not_(c.not_(within))
    made = [rules.Rule(PROFILE, "deep", "document", deep), rules.Rule(PROFILE, "large", "document", large), rules.Rule(PROFILE, "within", "document", within)]
    return rules.apply_rules(document_objects(spark, sf_dir), made).select("doc_id", "rule_id", "outcome", "error")


@query("SELECT doc_id, true AS header, coalesce(lang = 'de', false) AS encryption, n_chars IS DISTINCT FROM strlen(text) AS mismatch, false AS other FROM documents")
def has_parse_fact(spark, sf_dir):
    fact = lambda kind, declared=None, discovered=None: F.struct(F.lit(kind).alias("kind"), (F.lit(None) if declared is None else declared).cast("bigint").alias("declared"), (F.lit(None) if discovered is None else discovered).cast("bigint").alias("discovered"))
    facts = F.array(fact("header"), fact("streamLength", F.col("n_chars"), F.octet_length("text")), F.when(F.col("lang") == "de", fact("encrypted")).otherwise(fact("plain")))
    rows = table(spark, sf_dir, "documents").withColumn("facts", facts)
    return rows.select("doc_id", *[c.has_parse_fact("facts", name).value.alias(k) for k, name in (("header", "header"), ("encryption", "encryption"), ("mismatch", "streamLengthMismatch"), ("other", "unknown"))])


_REPORT = f"""
, fails AS (SELECT doc_id, rule_id, row_number() OVER (PARTITION BY doc_id ORDER BY rule_pos) AS k FROM o WHERE outcome = 'failed')
, lines AS (SELECT doc_id, string_agg('  ' || rule_id || ' at document:' || doc_id, chr(10) ORDER BY k) FILTER (k <= 5) AS l FROM fails GROUP BY doc_id)
SELECT a.doc_id, a.doc_id || ': ' || status || chr(10) || 'profiles: {PROFILE}' || chr(10) || 'checks: ' || (checks_executed - failed_rules) || ' passed, ' || failed_rules || ' failed, ' || unsupported_rules || ' unsupported' || coalesce(chr(10) || l, chr(10)) AS value
FROM a JOIN s USING (doc_id) LEFT JOIN lines USING (doc_id)
"""


@query(_OUTCOMES + _REPORT)
def report_text(spark, sf_dir):
    return sinks.as_text(_reports(spark, sf_dir))


def _reports(spark, sf_dir):
    # written once: accounts, status and failures would each run all rules again
    outcomes = materialise(rules.apply_rules(document_objects(spark, sf_dir), document_rules()), "outcomes")
    accounts = rules.account(outcomes)
    return sinks.build_reports(rules.document_status(accounts), accounts, rules.retained_failures(outcomes, 100))


@query(
    _OUTCOMES
    + f""", fails AS (SELECT doc_id, string_agg('<check rule="' || rule_id || '" location="document:' || doc_id || '"/>', '' ORDER BY rule_pos) AS l FROM o WHERE outcome = 'failed' GROUP BY doc_id)
SELECT a.doc_id, '<job><item><name>' || a.doc_id || '</name></item><statement>' || CASE status WHEN 'valid' THEN 'The document complies with the profile.' WHEN 'invalid' THEN 'The document does not comply with the profile.' ELSE 'The document could not be checked completely.' END
 || '</statement><validationReport profileName="{PROFILE}" isCompliant="' || (failed_rules = 0 AND unsupported_rules = 0) || '"><details passedChecks="' || (checks_executed - failed_rules) || '" failedChecks="' || failed_rules || '" unsupportedRules="' || unsupported_rules || '"/>' || coalesce(l, '') || '</validationReport></job>' AS value
FROM a JOIN s USING (doc_id) LEFT JOIN fails USING (doc_id)"""
)
def report_xml(spark, sf_dir):
    return sinks.as_xml(_reports(spark, sf_dir))


@query(
    _OUTCOMES
    + f""", c AS (SELECT doc_id, rule_id, rule_pos, outcome, CASE outcome WHEN 'failed' THEN 0 ELSE 1 END AS part FROM o WHERE outcome IN ('failed', 'passed'))
SELECT doc_id, '{PROFILE}' AS profile_id, part, 1 AS place, rule_pos, '<check ruleId="' || rule_id || '" status="' || outcome || '" location="document:' || doc_id || '"/>' AS value FROM c
UNION ALL SELECT doc_id, '{PROFILE}', part, unnest([0, 2]), NULL, unnest(['<', '</']) || outcome || 'Checks>' FROM (SELECT DISTINCT doc_id, part, outcome FROM c)"""
)
def report_check_lines(spark, sf_dir):
    lines = sinks.check_lines(rules.apply_rules(document_objects(spark, sf_dir), document_rules()), None, passed=True)
    return lines.select("doc_id", "profile_id", "part", "place", "rule_pos", "value")


@query(_OUTCOMES + f"SELECT doc_id, '<tr><td>' || doc_id || '</td><td>' || status || '</td><td>{PROFILE}</td></tr>' AS value FROM s")
def report_html(spark, sf_dir):
    return sinks.as_html_rows(_reports(spark, sf_dir))


@query(
    _OUTCOMES
    + f""", fails AS (SELECT doc_id, string_agg('{{"ordinal":' || k || ',"rule_id":"' || rule_id || '","identity_key":"document:' || doc_id || '"}}', ',' ORDER BY k) AS l FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rule_pos) AS k FROM o WHERE outcome = 'failed') GROUP BY doc_id)
SELECT a.doc_id, '{{"source":{{}},"status":"' || status || '","profileReports":[{{"profileId":"{PROFILE}","isCompliant":' || (failed_rules = 0 AND unsupported_rules = 0) || ',"checksExecuted":' || checks_executed || ',"failedRules":' || failed_rules || ',"unsupportedRules":' || unsupported_rules || ',"failedAssertions":[' || coalesce(l, '') || ']}}]}}' AS value
FROM a JOIN s USING (doc_id) LEFT JOIN fails USING (doc_id)"""
)
def report_json(spark, sf_dir):
    return sinks.as_json(sinks.redacted(_reports(spark, sf_dir)))


@query(
    _OUTCOMES
    + f""", fails AS (SELECT doc_id, string_agg('<check rule="' || rule_id || '" location="document:' || doc_id || '"/>', '' ORDER BY rule_pos) AS l FROM o WHERE outcome = 'failed' GROUP BY doc_id)
SELECT a.doc_id, '<processorResult status="' || status || '"><item><name>' || a.doc_id || '</name></item><validationReport profileName="{PROFILE}" isCompliant="' || (failed_rules = 0 AND unsupported_rules = 0) || '"><details passedChecks="' || (checks_executed - failed_rules) || '" failedChecks="' || failed_rules || '" unsupportedRules="' || unsupported_rules || '"/>' || coalesce(l, '') || '</validationReport></processorResult>' AS value
FROM a JOIN s USING (doc_id) LEFT JOIN fails USING (doc_id)"""
)
def report_raw_xml(spark, sf_dir):
    return sinks.as_raw_xml(_reports(spark, sf_dir))


@query(
    _OUTCOMES
    + f"""SELECT 0 AS part, '' AS doc_id, '<!DOCTYPE html><html><body><table>' AS value UNION ALL SELECT 1, CAST(doc_id AS VARCHAR), '<tr><td>' || doc_id || '</td><td>' || status || '</td><td>{PROFILE}</td></tr>' FROM s UNION ALL
SELECT 2, '', '</table><p>total: ' || count(*) || ', valid: ' || count(*) FILTER (status = 'valid') || ', invalid: ' || count(*) FILTER (status = 'invalid') || ', parseFailed: 0, encrypted: 0, incomplete: ' || count(*) FILTER (status = 'incomplete') || ', internalErrors: 0, exitCode: ' || max(CASE status WHEN 'valid' THEN 0 WHEN 'invalid' THEN 1 ELSE 4 END)
 || ', category: ' || CASE WHEN count(*) FILTER (status = 'incomplete') > 0 THEN 'processingFailed' WHEN count(*) FILTER (status = 'invalid') > 0 THEN 'validationFailed' ELSE 'success' END || '</p></body></html>' FROM s"""
)
def report_batch_html(spark, sf_dir):
    found = _reports(spark, sf_dir)
    return sinks.batch_lines(found, rules.batch_summary(found.select("doc_id", "status")), "html")


# Predicate functions.


def _values(spark, sf_dir, name, keys, **made):
    return table(spark, sf_dir, name).select(*keys, *[x.value.alias(k) for k, x in made.items()])


@query("SELECT doc_id, CAST(strlen(text) AS DOUBLE) AS bytes, strlen(text) = 0 AS is_empty FROM documents")
def expr_size(spark, sf_dir):
    text = c.prop("text", "string")
    return _values(spark, sf_dir, "documents", ["doc_id"], bytes=c.size(text), is_empty=c.is_empty(text))


@query("SELECT doc_id, CAST(CASE WHEN instr(text, 'è') > 0 THEN strlen(left(text, instr(text, 'è') - 1)) ELSE -1 END AS DOUBLE) AS at, contains(text, 'è') AS found FROM documents")
def expr_index_of(spark, sf_dir):
    text = c.prop("text", "string")
    return _values(spark, sf_dir, "documents", ["doc_id"], at=c.index_of(text, c.lit("è")), found=c.contains(text, c.lit("è")))


@query("SELECT page_id, string_split(url, '/') AS parts, CAST(len(string_split(url, '/')) AS DOUBLE) AS n FROM pages")
def expr_split(spark, sf_dir):
    parts = c.split(c.prop("url", "string"), "/")
    return _values(spark, sf_dir, "pages", ["page_id"], parts=parts, n=c.size(parts))


@query("SELECT l_orderkey, l_linenumber, CAST(l_orderkey & 6 AS DOUBLE) AS masked, CAST(l_orderkey >> 2 AS DOUBLE) AS shifted FROM lineitem")
def expr_bits(spark, sf_dir):
    key = c.prop("l_orderkey", "number")
    return _values(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber"], masked=c.bit_and(key, c.lit(6)), shifted=c.shift_right(key, c.lit(2)))


@query("SELECT c_custkey, (c_acctbal - 5000) % 7 AS rem, abs(c_acctbal) AS size, c_acctbal * 2 + 1 AS scaled, c_acctbal - 1 AS less FROM customer")
def expr_arithmetic(spark, sf_dir):
    bal = c.prop("c_acctbal", "number")
    return _values(spark, sf_dir, "customer", ["c_custkey"], rem=c.rem(c.sub(bal, c.lit(5000)), c.lit(7)), size=c.abs_(bal), scaled=c.add(c.mul(bal, c.lit(2)), c.lit(1)), less=c.sub(bal, c.lit(1)))


@query("SELECT c_custkey, c_acctbal < 0 AS lt, c_acctbal <= 0 AS le, c_acctbal > 0 AS gt, c_acctbal >= 0 AS ge, c_mktsegment = 'BUILDING' AS eq, c_mktsegment <> 'BUILDING' AS ne, false AS cross_type FROM customer")
def expr_comparison(spark, sf_dir):
    bal, seg, zero = c.prop("c_acctbal", "number"), c.prop("c_mktsegment", "string"), c.lit(0)
    b = c.lit("BUILDING")
    return _values(spark, sf_dir, "customer", ["c_custkey"], lt=c.lt(bal, zero), le=c.le(bal, zero), gt=c.gt(bal, zero), ge=c.ge(bal, zero), eq=c.eq(seg, b), ne=c.ne(seg, b), cross_type=c.eq(seg, zero))


@query("SELECT c_custkey, CASE WHEN c_nationkey < 10 THEN 'passed' WHEN abs(c_nationkey - 10) < 1 THEN 'unsupported' WHEN c_acctbal / (c_nationkey - 10) > 100 THEN 'passed' ELSE 'failed' END AS either, CASE WHEN c_nationkey <> 10 THEN 'failed' ELSE 'unsupported' END AS both FROM customer")
def expr_short_circuit(spark, sf_dir):
    nation, bal = c.prop("c_nationkey", "number"), c.prop("c_acctbal", "number")
    ratio = c.gt(c.div(bal, c.sub(nation, c.lit(10))), c.lit(100))
    either, both = c.or_(c.lt(nation, c.lit(10)), ratio), c.and_(c.eq(nation, c.lit(10)), ratio)
    return table(spark, sf_dir, "customer").select("c_custkey", c.outcome(either).alias("either"), c.outcome(both).alias("both"))


@query("SELECT page_id, regexp_matches(url, '^https') AS https, CAST(CASE WHEN regexp_matches(url, '[0-9]+') THEN strlen(regexp_extract(url, '^([^0-9]*)', 1)) ELSE -1 END AS DOUBLE) AS first_digit FROM pages")
def expr_matches(spark, sf_dir):
    url = c.prop("url", "string")
    return _values(spark, sf_dir, "pages", ["page_id"], https=c.matches(url, "^https"), first_digit=c.search(url, "[0-9]+"))


@query(
    """WITH p AS (SELECT page_id, string_split(url, '/') AS parts FROM pages)
SELECT page_id, list_filter(parts, lambda x: x IN ('en', 'de')) AS eq, list_filter(parts, lambda x: x NOT IN ('en', 'de')) AS ne, list_filter(parts, lambda x: regexp_matches(x, '[0-9]')) AS ma, list_filter(parts, lambda x: NOT regexp_matches(x, '[0-9]')) AS nm,
CAST(coalesce(list_position(list_transform(parts, lambda x: x IN ('en', 'de')), true), 0) - 1 AS DOUBLE) AS at, parts[3:] AS rest FROM p"""
)
def expr_list_filters(spark, sf_dir):
    parts = c.split(c.prop("url", "string"), "/")
    return _values(spark, sf_dir, "pages", ["page_id"], eq=c.filter_equals(parts, "en", "de"), ne=c.filter_not_equals(parts, "en", "de"), ma=c.filter_matches(parts, "[0-9]"), nm=c.filter_not_matches(parts, "[0-9]"), at=c.find_index_equals(parts, "en", "de"), rest=c.slice_(parts, 2))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand ELSE p_type END AS chosen, substring(p_name, 4) AS rest FROM part")
def expr_choose(spark, sf_dir):
    chosen = c.choose(c.gt(c.prop("p_size", "number"), c.lit(25)), c.prop("p_brand", "string"), c.prop("p_type", "string"))
    return _values(spark, sf_dir, "part", ["p_partkey"], chosen=chosen, rest=c.slice_(c.prop("p_name", "string"), 3))


# Joins and existence checks.


@query("SELECT l_orderkey, l_linenumber, o_orderstatus AS status FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 100000) o ON o_orderkey = l_orderkey")
def join_references(spark, sf_dir):
    objects = table(spark, sf_dir, "orders").filter("o_totalprice > 100000").withColumnRenamed("o_orderkey", "l_orderkey")
    return joins.resolve_references(table(spark, sf_dir, "lineitem"), objects, ["l_orderkey"], "o_orderstatus", "status").select("l_orderkey", "l_linenumber", "status")


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderpriority LIKE '1%' THEN o_orderpriority END, c_mktsegment) AS value FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def join_inline_or_reference(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("inline", F.when(F.col("o_orderpriority").like("1%"), F.col("o_orderpriority")))
    people = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return joins.inline_or_reference(rows, people, ["o_custkey"], "inline", "c_mktsegment", "value").select("o_orderkey", "value")


@query(
    """SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'label' END, CASE WHEN v.role IS NOT NULL THEN 'conversation' END) AS owner FROM documents d
LEFT JOIN (SELECT DISTINCT doc_id, quality FROM labels WHERE quality = 1) l USING (doc_id) LEFT JOIN (SELECT DISTINCT conv_id AS doc_id, 'x' AS role FROM conversations) v USING (doc_id)"""
)
def join_priority(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id", F.lit("label").alias("owner")).distinct()
    talks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit("conversation").alias("owner")).distinct()
    return joins.priority_join(table(spark, sf_dir, "documents").select("doc_id"), [(labels, ["doc_id"]), (talks, ["doc_id"])], "owner", "owner")


@query("SELECT user_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS owner FROM events GROUP BY user_id")
def join_last_owner(spark, sf_dir):
    return joins.last_owner(table(spark, sf_dir, "events").withColumnRenamed("event_type", "owner"), ["user_id"], ["ts", "event_id"], "owner")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def orphan_anti(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").filter("o_totalprice > 400000").withColumnRenamed("o_custkey", "c_custkey")
    return joins.orphans(table(spark, sf_dir, "customer"), orders, ["c_custkey"]).select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def ghost_anti(spark, sf_dir):
    return joins.orphans(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"]).select("o_orderkey")


@query("SELECT doc_id FROM documents WHERE EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def header_semi(spark, sf_dir):
    return joins.with_match(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id")


@query("SELECT doc_id FROM documents QUALIFY count(*) OVER (PARTITION BY text) > 1")
def duplicate_ids(spark, sf_dir):
    # by the digest of the text, so that no whole text is shuffled
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").alias("bytes"))
    return joins.repeated(rows, ["digest", "bytes"]).select("doc_id")


@query("SELECT l_suppkey AS doc_id, string_agg(DISTINCT l_returnflag, '&' ORDER BY l_returnflag) AS names FROM lineitem GROUP BY l_suppkey")
def inherited_names(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), "l_returnflag")
    return joins.joined_names(rows, ["doc_id"], "l_returnflag")


@query(
    """WITH u AS (SELECT DISTINCT o_custkey AS doc_id, o_orderpriority AS name FROM orders), k AS (SELECT DISTINCT o_custkey AS doc_id, o_orderpriority AS name FROM orders WHERE o_orderstatus = 'O')
SELECT doc_id, string_agg(name, '&' ORDER BY name) AS missing FROM u WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = u.doc_id AND k.name = u.name) GROUP BY doc_id"""
)
def undefined_names(spark, sf_dir):
    used = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("name"), "o_orderstatus")
    return joins.missing_names(used.select("doc_id", "name"), used.filter("o_orderstatus = 'O'"), ["doc_id"], "name")


@query("SELECT l_orderkey, l_returnflag, count(DISTINCT l_linestatus) <= 1 AS consistent FROM lineitem GROUP BY l_orderkey, l_returnflag")
def tint_consistency(spark, sf_dir):
    return joins.consistent(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_returnflag"], "l_linestatus")


_BASE = "WITH now AS (SELECT p_brand, p_type, count(*) AS count FROM part GROUP BY ALL), old AS (SELECT p_brand, p_type, count(*) AS count FROM part WHERE p_size > 20 GROUP BY ALL)"


@query(_BASE + " SELECT now.p_brand, now.p_type, now.count, old.count AS previous_count, now.count - old.count AS delta FROM now LEFT JOIN old ON now.p_brand IS NOT DISTINCT FROM old.p_brand AND now.p_type IS NOT DISTINCT FROM old.p_type")
def baseline_diff(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    count = lambda rows: rows.groupBy("p_brand", "p_type").agg(F.count("*").alias("count"))
    return joins.baseline_delta(count(part), count(part.filter("p_size > 20")), ["p_brand", "p_type"])


@query("WITH b AS (SELECT p_brand, count(*) AS total, sum(p_size)::BIGINT AS lowered FROM part GROUP BY 1), n AS (SELECT p_brand, count(*) AS total, sum(p_size)::BIGINT AS lowered FROM part WHERE p_size < 45 AND p_brand <> 'Brand#11' GROUP BY 1) SELECT b.p_brand, b.total, b.lowered, n.total AS now_total, n.lowered AS now_lowered FROM b LEFT JOIN n USING (p_brand) WHERE n.total IS NULL OR n.total < b.total OR n.lowered < b.lowered")
def coverage_diff(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    count = lambda rows: rows.groupBy("p_brand").agg(F.count("*").alias("total"), F.sum("p_size").alias("lowered"))
    return joins.coverage_decreases(count(part), count(part.filter("p_size < 45 AND p_brand <> 'Brand#11'")), "p_brand", ["total", "lowered"])


@query("SELECT c_nationkey, arg_min(c_name, struct_pack(a := c_acctbal, b := c_custkey)) AS c_name FROM customer GROUP BY c_nationkey")
def innermost_first(spark, sf_dir):
    return joins.first_per_key(table(spark, sf_dir, "customer"), ["c_nationkey"], ["c_acctbal", "c_custkey"], ["c_name"])


# Roll-ups.


@query(
    """WITH e AS (SELECT l_shipmode, list_sort(list(DISTINCT l_orderkey))[1:3] AS examples FROM (SELECT l_returnflag || l_linestatus AS l_shipmode, l_orderkey FROM lineitem) GROUP BY 1)
SELECT l_returnflag || l_linestatus AS l_shipmode, count(*) AS count, any_value(examples) AS examples FROM lineitem JOIN e ON e.l_shipmode = l_returnflag || l_linestatus GROUP BY 1"""
)
def unsupported_clusters(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("l_shipmode"), "l_orderkey")
    return reports.clusters(rows, ["l_shipmode"], "l_orderkey")


@query("SELECT p_brand, p_type, count(*) AS count FROM part GROUP BY ALL ORDER BY count DESC, p_brand, p_type LIMIT 20")
def cluster_top20(spark, sf_dir):
    counted = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("count"))
    return reports.top_clusters(counted, ["p_brand", "p_type"])


@query("SELECT * FROM (VALUES ('A'), ('N'), ('R'), ('X')) v(l_returnflag) LEFT JOIN LATERAL (SELECT count(*) AS count FROM lineitem l WHERE l.l_returnflag = v.l_returnflag) ON true")
def zero_fill(spark, sf_dir):
    return reports.zero_filled(table(spark, sf_dir, "lineitem"), "l_returnflag", ["A", "N", "R", "X"])


@query(
    """WITH r AS (SELECT l_returnflag AS flavour, CASE WHEN l_quantity < 5 THEN 'missingLink' WHEN l_quantity < 9 THEN 'missingProperty' WHEN l_quantity < 20 AND l_linenumber = 1 THEN 'unsupportedExpression' END AS c FROM lineitem)
SELECT flavour, category, count(*) FILTER (c = category) AS count FROM r, (SELECT unnest(['missingLink', 'missingObjectType', 'missingProperty', 'missingSemanticFamily', 'unsupportedExpression']) AS category) GROUP BY ALL"""
)
def profile_reasons(spark, sf_dir):
    q = F.col("l_quantity")
    reason = F.when(q < 5, "unknown validation model link: owner of a property").when(q < 9, "unknown property: size").when((q < 20) & (F.col("l_linenumber") == 1), "a property of a link")
    return reports.reason_counts(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flavour"), reason.alias("reason")))


@query(
    "SELECT l_shipflag AS flavour, count(*) AS total, count(*) FILTER (q > 10) AS lowered, count(*) FILTER (q > 20) AS bound, count(*) FILTER (q < 5) AS unsupported, count(*) FILTER (q > 20) * 100 // count(*) AS percent FROM (SELECT l_returnflag AS l_shipflag, l_quantity AS q FROM lineitem) GROUP BY 1"
)
def profile_coverage(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flavour"), (F.col("l_quantity") > 10).alias("lowered"), (F.col("l_quantity") > 20).alias("bound"), F.when(F.col("l_quantity") < 5, "small").alias("reason"))
    return reports.coverage(rows)


_COMPARED = """WITH r AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, CASE WHEN o_custkey % 4 = 0 THEN 'T3' ELSE 'T2' END AS tier,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderstatus = 'P' THEN 'incomplete' WHEN o_totalprice > 150000 THEN 'valid' ELSE 'invalid' END AS ours,
  CASE WHEN o_orderkey % 26 = 0 THEN NULL WHEN o_custkey % 3 = 0 THEN 'invalid' ELSE 'valid' END AS theirs,
  CASE WHEN o_orderkey % 97 = 0 THEN 'timeout' WHEN o_orderkey % 13 = 0 THEN 'failed' ELSE 'completed' END AS our_run, CASE WHEN o_orderkey % 89 = 0 THEN 'timeout' WHEN o_orderkey % 26 = 0 THEN 'failed' ELSE 'completed' END AS their_run,
  CASE left(o_orderpriority, 1) WHEN '5' THEN 'expectedDriftScope' WHEN '4' THEN 'ambiguity' WHEN '3' THEN 'bug' END AS expected FROM orders
), f AS (SELECT *, coalesce(ours = 'valid' AND theirs = 'invalid', false) AS false_compliant, our_run = 'timeout' OR their_run = 'timeout' AS timed_out FROM r
), g AS (SELECT *, CASE WHEN ours IS NOT NULL AND ours IS NOT DISTINCT FROM theirs AND our_run = 'completed' AND their_run = 'completed' THEN 'match'
   WHEN false_compliant THEN CASE WHEN expected IN ('ambiguity', 'bug') THEN expected ELSE 'unexpectedDrift' END WHEN timed_out THEN 'unexpectedDrift' ELSE coalesce(expected, 'unexpectedDrift') END AS classification FROM f
), k AS (SELECT *, false_compliant OR timed_out OR classification IN ('unexpectedDrift', 'bug') AS release_blocking FROM g)
"""


def _compared(spark, sf_dir):
    key = F.col("o_orderkey")
    expected = F.when(F.col("o_orderpriority").like("5%"), "expectedDriftScope").when(F.col("o_orderpriority").like("4%"), "ambiguity").when(F.col("o_orderpriority").like("3%"), "bug")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderpriority", "o_orderstatus", F.when(F.col("o_custkey") % 4 == 0, "T3").otherwise("T2").alias("tier"), expected.alias("expected"),
        F.when(key % 13 != 0, F.when(F.col("o_orderstatus") == "P", "incomplete").when(F.col("o_totalprice") > 150_000, "valid").otherwise("invalid")).alias("ours"),
        F.when(key % 26 != 0, F.when(F.col("o_custkey") % 3 == 0, "invalid").otherwise("valid")).alias("theirs"),
        F.when(key % 97 == 0, "timeout").when(key % 13 == 0, "failed").otherwise("completed").alias("our_run"), F.when(key % 89 == 0, "timeout").when(key % 26 == 0, "failed").otherwise("completed").alias("their_run"),
    )
    return reports.compared(rows)


@query(_COMPARED + "SELECT o_orderkey, classification, false_compliant, release_blocking FROM k")
def drift_classify(spark, sf_dir):
    return _compared(spark, sf_dir).select("o_orderkey", "classification", "false_compliant", "release_blocking")


@query(
    _COMPARED
    + """SELECT count(*) AS total, count(*) FILTER (classification = 'match') AS matches, count(*) FILTER (classification <> 'match') AS mismatches, count(*) FILTER (classification NOT IN ('match', 'unexpectedDrift')) AS classified_mismatches, count(*) FILTER (classification = 'unexpectedDrift') AS unexpected_drift,
 count(*) FILTER (false_compliant) AS false_compliant, count(*) FILTER (release_blocking) AS release_blocking, count(*) FILTER (timed_out) AS timeouts, count(*) FILTER (classification = 'match') * 10000 // count(*) AS match_basis_points FROM k"""
)
def comparison_summary(spark, sf_dir):
    return reports.comparison_summary(_compared(spark, sf_dir))


@query(
    _COMPARED
    + """, t AS (SELECT count(*) FILTER (false_compliant) AS false_compliant, count(*) FILTER (classification = 'unexpectedDrift') AS unexpected_drift, count(*) FILTER (tier = 'T3') AS t3_rows, count(*) FILTER (tier = 'T3' AND classification = 'match') AS t3_matches FROM k)
SELECT *, t3_matches * 10000 // t3_rows AS t3_basis_points, false_compliant = 0 AND unexpected_drift = 0 AND t3_rows >= 1000 AND t3_matches * 10000 // t3_rows >= 9500 AS passed FROM t"""
)
def release_gate(spark, sf_dir):
    return reports.release_gate(_compared(spark, sf_dir), 1000)


@query(
    _COMPARED
    + "SELECT 'o_orderpriority' AS dimension, o_orderpriority AS value, count(*) AS count, count(*) FILTER (classification = 'match') AS matches FROM k GROUP BY 2 UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*), count(*) FILTER (classification = 'match') FROM k GROUP BY 2 "
    "UNION ALL SELECT 'ours', ours, count(*), count(*) FILTER (classification = 'match') FROM k WHERE ours IS NOT NULL GROUP BY 2"
)
def grouped_summaries(spark, sf_dir):
    return reports.grouped_summaries(_compared(spark, sf_dir), ["o_orderpriority", "o_orderstatus", "ours"])


@query(
    "SELECT c_custkey FROM (SELECT *, CASE WHEN c_nationkey = 3 THEN c_name ELSE 'c:' || c_custkey % 700 END AS id FROM customer) WHERE (c_mktsegment = 'BUILDING') <> (c_nationkey % 5 = 0) OR NOT regexp_full_match(id, '[A-Za-z0-9._:-]{1,128}') "
    "OR id IN (SELECT CASE WHEN c_nationkey = 3 THEN c_name ELSE 'c:' || c_custkey % 700 END FROM customer GROUP BY 1 HAVING count(*) > 1)"
)
def manifest_validation(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") == 3, F.col("c_name")).otherwise(F.concat(F.lit("c:"), (F.col("c_custkey") % 700).cast("string"))).alias("id"), F.when(F.col("c_mktsegment") == "BUILDING", "T3").otherwise("T2").alias("tier"), F.when(F.col("c_nationkey") % 5 == 0, "private").otherwise("public").alias("license"), F.lit(None).cast("string").alias("expected"), F.lit(None).cast("string").alias("note"))
    return reports.invalid_manifest_rows(rows).select("c_custkey")


@query("SELECT count(*) FILTER (c_acctbal > 0) * 10000 // count(*) AS points FROM customer")
def basis_points(spark, sf_dir):
    return table(spark, sf_dir, "customer").agg(reports.basis_points(F.count_if(F.col("c_acctbal") > 0), F.count("*")).alias("points"))


@query("SELECT max(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 4 END) AS exit_code FROM orders")
def exit_worst(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "valid").when(F.col("o_orderstatus") == "O", "invalid").otherwise("incomplete")
    return table(spark, sf_dir, "orders").agg(F.max(rules.exit_code(status)).alias("exit_code"))


# Policies and features.

_POLICY_FIELDS = {"quality": "number", "toxic": "number"}


def _features(spark, sf_dir):
    return policy.extract_features(table(spark, sf_dir, "labels"), "label", _POLICY_FIELDS)


@query(
    """WITH d AS (SELECT doc_id, quality, toxic, labels.doc_id IS NOT NULL AS has FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, unnest(['has-quality', 'no-quality', 'good', 'not-toxic', 'at-least', 'at-most']) AS rule_id,
unnest([quality IS NOT NULL, quality IS NULL, coalesce(quality = 1, false), coalesce(toxic <> 1, true), coalesce(quality >= 1, false), coalesce(toxic <= 0, false)]) AS passed, CAST(has AS BIGINT) AS matches FROM d"""
)
def policy_operators(spark, sf_dir):
    wanted = [
        policy.PolicyRule("has-quality", "label", "quality", "exists"), policy.PolicyRule("no-quality", "label", "quality", "absent"), policy.PolicyRule("good", "label", "quality", "equals", 1),
        policy.PolicyRule("not-toxic", "label", "toxic", "notEquals", 1), policy.PolicyRule("at-least", "label", "quality", "min", 1), policy.PolicyRule("at-most", "label", "toxic", "max", 0),
    ]
    policy.check_policies(wanted, {"label": list(_POLICY_FIELDS)})
    return policy.evaluate_policies(_features(spark, sf_dir), table(spark, sf_dir, "documents"), wanted)


@query("SELECT doc_id, coalesce(quality = 1, false) AND coalesce(toxic <> 1, true) AS policy_passed, CAST(NOT coalesce(quality = 1, false) AS BIGINT) + CAST(NOT coalesce(toxic <> 1, true) AS BIGINT) AS failed_rules FROM documents LEFT JOIN labels USING (doc_id)")
def policy_report(spark, sf_dir):
    wanted = [policy.PolicyRule("good", "label", "quality", "equals", 1), policy.PolicyRule("not-toxic", "label", "toxic", "notEquals", 1)]
    return policy.policy_report(policy.evaluate_policies(_features(spark, sf_dir), table(spark, sf_dir, "documents"), wanted))


@query(
    """SELECT doc_id, 'text' AS field, text IS NOT NULL AS present, true AS redacted, CAST(strlen(text) AS DOUBLE) AS number_value, CAST(NULL AS VARCHAR) AS string_value FROM documents
UNION ALL SELECT doc_id, 'lang', lang IS NOT NULL, false, NULL, lang FROM documents UNION ALL SELECT doc_id, 'n_chars', n_chars IS NOT NULL, false, CAST(n_chars AS DOUBLE), NULL FROM documents"""
)
def feature_redaction(spark, sf_dir):
    found = policy.extract_features(table(spark, sf_dir, "documents"), "document", {"text": "string", "lang": "string", "n_chars": "number"}, ["lang"])
    return found.select("doc_id", "field", "present", "redacted", "number_value", "string_value")


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def json_feature(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("total"))


# Content streams, hierarchy, derived values.


def _stream(spark, sf_dir):
    ops = F.create_map(*[F.lit(x) for pair in (("click", "BDC"), ("view", "EMC"), ("purchase", "Tj"), ("signup", "q"), ("error", "Do")) for x in pair])
    op = F.when(F.col("event_id") % 11 == 0, "zz").otherwise(F.coalesce(F.element_at(ops, F.col("event_type")), F.lit("zz")))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.lit(0).alias("stream"), F.col("event_id").alias("seq"), op.alias("op"), F.concat(F.lit("R"), (F.col("event_id") % 7).cast("string")).alias("name"))


_STREAM = """WITH s AS (SELECT user_id AS doc_id, event_id AS seq, CASE WHEN event_id % 11 = 0 THEN 'zz' ELSE CASE event_type WHEN 'click' THEN 'BDC' WHEN 'view' THEN 'EMC' WHEN 'purchase' THEN 'Tj' WHEN 'signup' THEN 'q' WHEN 'error' THEN 'Do' ELSE 'zz' END END AS op, 'R' || (event_id % 7) AS name FROM events),
r AS (SELECT *, sum(CASE op WHEN 'BDC' THEN 1 WHEN 'EMC' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) AS t FROM s),
d AS (SELECT *, CAST(t - least(0, min(t) OVER (PARTITION BY doc_id ORDER BY seq)) AS BIGINT) AS depth FROM r)
"""


@query(_STREAM + "SELECT doc_id, seq, depth FROM d")
def nested_depth(spark, sf_dir):
    return content.with_depth(_stream(spark, sf_dir)).select("doc_id", "seq", F.col("marked_depth").alias("depth"))


@query(_STREAM + "SELECT seq, CASE op WHEN 'BDC' THEN 'markedContent' WHEN 'EMC' THEN 'markedContent' WHEN 'Tj' THEN 'textShow' WHEN 'q' THEN 'graphicsState' WHEN 'Do' THEN 'xObject' ELSE 'unknown' END AS operator_family FROM d")
def operator_families(spark, sf_dir):
    return content.classified(_stream(spark, sf_dir)).select("seq", "operator_family")


@query(
    _STREAM
    + """SELECT a.doc_id, a.seq AS start_seq, (SELECT min(b.seq) FROM d b WHERE b.doc_id = a.doc_id AND b.seq > a.seq AND b.op = 'EMC' AND b.depth = a.depth - 1) AS end_seq, a.depth,
 EXISTS (SELECT 1 FROM d x WHERE x.doc_id = a.doc_id AND x.op = 'Tj' AND x.seq > a.seq AND x.seq < coalesce((SELECT min(b.seq) FROM d b WHERE b.doc_id = a.doc_id AND b.seq > a.seq AND b.op = 'EMC' AND b.depth = a.depth - 1), 9223372036854775807)) AS has_text FROM d a WHERE a.op = 'BDC'"""
)
def marked_spans(spark, sf_dir):
    return content.marked_spans(_stream(spark, sf_dir)).select("doc_id", "start_seq", "end_seq", "depth", "has_text")


@query(_STREAM + "SELECT doc_id, seq, CASE WHEN name IN ('R0', 'R1', 'R2') THEN 'resolved' WHEN name = 'R3' THEN 'wrongType' ELSE 'missing' END AS status FROM d WHERE op = 'Do'")
def resource_resolution(spark, sf_dir):
    rows = _stream(spark, sf_dir)
    known = [("R0", 0, "xObject"), ("R1", 1, "xObject"), ("R2", 0, "xObject"), ("R2", 1, "font"), ("R3", 0, "font"), ("R3", 2, "xObject")]
    each = F.explode(F.array(*[F.struct(F.lit("xObject").alias("family"), F.lit(n).alias("name"), F.lit(s).alias("scope"), F.lit(f).alias("object_family")) for n, s, f in known]))
    resources = rows.select("doc_id").distinct().withColumn("r", each).select("doc_id", "r.*")
    return content.resolved_uses(content.resource_uses(rows), resources).select("doc_id", "seq", "status")


@query(_STREAM + "SELECT doc_id, count(*) AS operator_count, count(*) FILTER (op = 'zz') AS unknown_count, bool_or(op = 'Tj') AS has_text, max(depth) AS nesting_level FROM d GROUP BY doc_id")
def stream_summary(spark, sf_dir):
    return content.stream_summary(_stream(spark, sf_dir)).select("doc_id", "operator_count", "unknown_count", "has_text", "nesting_level")


def _tree(spark, sf_dir):
    """Suppliers' parts as binary heaps: node k hangs on k // 2."""
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 3).alias("doc_id"), F.floor(F.col("p_partkey") / 3).cast("bigint").alias("node"), "p_size", "p_type")
    parent = F.when(F.col("node") > 1, F.floor(F.col("node") / 2).cast("bigint"))
    return rows.filter("node >= 1").withColumn("parent", parent).withColumn("role", F.concat(F.lit("H"), (F.col("p_size") % 8).cast("string"))).withColumn("lang", F.when(F.col("p_size") % 5 == 0, F.col("p_type")))


_TREE = """WITH RECURSIVE t AS (SELECT p_partkey % 3 AS doc_id, p_partkey // 3 AS node, CASE WHEN p_partkey // 3 > 1 THEN p_partkey // 3 // 2 END AS parent, 'H' || (p_size % 8) AS role, CASE WHEN p_size % 5 = 0 THEN p_type END AS lang FROM part WHERE p_partkey // 3 >= 1),
up AS (SELECT doc_id, node, parent AS top, []::BIGINT[] AS path, 0 AS depth FROM t UNION ALL SELECT u.doc_id, u.node, t.parent, list_append(u.path, u.top), u.depth + 1 FROM up u JOIN t ON t.doc_id = u.doc_id AND t.node = u.top WHERE u.top IS NOT NULL),
p AS (SELECT doc_id, node, max(depth) AS depth, arg_max(path, depth) AS path FROM up GROUP BY doc_id, node)
"""


@query(_TREE + "SELECT doc_id, node, depth, path FROM p")
def tree_paths(spark, sf_dir):
    return hierarchy.ancestor_paths(_tree(spark, sf_dir))


@query(_TREE + ", c AS (SELECT doc_id, node, unnest(list_concat([node], path)) AS at, unnest(range(len(path) + 1)) AS step FROM p) SELECT c.doc_id, c.node, arg_min(t.lang, step) FILTER (t.lang IS NOT NULL) AS inherited_lang FROM c JOIN t ON t.doc_id = c.doc_id AND t.node = c.at GROUP BY c.doc_id, c.node")
def inherited_language(spark, sf_dir):
    nodes = _tree(spark, sf_dir)
    return hierarchy.inherited(nodes, "lang", "inherited_lang").select("doc_id", "node", "inherited_lang")


_NESTING = (
    _TREE
    + """, c AS (SELECT doc_id, node, unnest(path) AS at, unnest(range(len(path))) AS step FROM p), l AS (SELECT doc_id, node, CASE WHEN regexp_full_match(role, 'H[1-6]') THEN CAST(substring(role, 2, 1) AS INTEGER) ELSE 0 END AS level FROM t),
n AS (SELECT c.doc_id, c.node, arg_min(l.level, step) FILTER (l.level > 0) AS above FROM c JOIN l ON l.doc_id = c.doc_id AND l.node = c.at GROUP BY 1, 2)
SELECT l.doc_id, l.node, l.level, CASE WHEN l.level <= 1 THEN true ELSE coalesce(above < l.level, false) END AS nests FROM l LEFT JOIN n USING (doc_id, node)"""
)


@query(_NESTING)
def heading_nesting(spark, sf_dir):
    return hierarchy.node_facts(_tree(spark, sf_dir)).select("doc_id", "node", "level", "nests")


_ROLES = ["H1", "H2", "H3", "Formula", "Sect", "P", "Title", "BibEntry", "MathML", "TD", "Lbl", "Link", "Own"]


@query(
    _TREE.replace("'H' || (p_size % 8) AS role", f"{_ROLES}[p_size % 13 + 1] AS role")
    + """, c AS (SELECT doc_id, node, unnest(path) AS at, unnest(range(len(path))) AS step FROM p), l AS (SELECT *, CASE WHEN regexp_full_match(role, 'H[1-6]') THEN CAST(substring(role, 2, 1) AS INTEGER) ELSE 0 END AS level FROM t),
n AS (SELECT c.doc_id, c.node, arg_min(l.level, step) FILTER (l.level > 0) AS above, arg_min(l.lang, step) FILTER (l.lang IS NOT NULL) AS parent_lang, bool_or(l.role IN ('Formula', 'MathML')) AS f FROM c JOIN l ON l.doc_id = c.doc_id AND l.node = c.at GROUP BY 1, 2)
SELECT l.doc_id, l.node, l.role, role <> 'Own' AS standard, role IN ('Sect', 'Title') AS grouping, CASE WHEN level > 0 THEN 'heading' WHEN role = 'TD' THEN 'table' WHEN role = 'Lbl' THEN 'list' WHEN role = 'Link' THEN 'link' END AS role_family,
 l.level, CASE WHEN l.level <= 1 THEN true ELSE coalesce(above < l.level, false) END AS nests, parent_lang, coalesce(f, false) AS in_formula FROM l LEFT JOIN n USING (doc_id, node)"""
)
def structure_node_facts(spark, sf_dir):
    nodes = _tree(spark, sf_dir).withColumn("role", F.element_at(F.array(*map(F.lit, _ROLES)), (F.col("p_size") % 13 + 1).cast("int")))
    return hierarchy.node_facts(nodes).select("doc_id", "node", "role", "standard", "grouping", "role_family", "level", "nests", "parent_lang", "in_formula")


@query("SELECT conv_id AS node, string_agg(role, '&' ORDER BY turn) AS child_roles FROM conversations GROUP BY conv_id")
def child_role_list(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.lit(0).alias("doc_id"), F.col("conv_id").alias("parent"), F.col("turn").alias("node"), "role")
    return hierarchy.child_roles(rows).select("node", "child_roles")


@query(
    """WITH RECURSIVE m AS (SELECT n_regionkey AS doc_id, n_name AS role, lead(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_name) AS target FROM nation),
w AS (SELECT doc_id, role, role AS now, 0 AS n FROM m UNION ALL SELECT w.doc_id, w.role, m.target, w.n + 1 FROM w JOIN m ON m.doc_id = w.doc_id AND m.role = w.now WHERE m.target IS NOT NULL)
SELECT doc_id, role, arg_max(now, n) AS mapped, false AS cyclic FROM w GROUP BY doc_id, role"""
)
def role_mapping(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("doc_id"), F.col("n_name").alias("role"))
    mapping = rows.withColumn("target", F.lead("role").over(Window.partitionBy("doc_id").orderBy("role"))).filter("target IS NOT NULL")
    return hierarchy.mapped_roles(rows, mapping)


@query(
    """WITH c AS (SELECT l_orderkey AS table_id, l_linenumber AS r0, CAST(l_quantity AS INTEGER) % 4 AS c0, 1 + CAST(l_quantity AS INTEGER) % 2 AS rs, 1 + l_linenumber % 3 AS cs FROM lineitem),
x AS (SELECT table_id, unnest(range(r0, r0 + rs)) AS r, c0, cs FROM c), y AS (SELECT table_id, r, unnest(range(c0, c0 + cs)) AS k FROM x), g AS (SELECT table_id, r, k, count(*) AS n FROM y GROUP BY ALL),
w AS (SELECT table_id, r, count(*) AS width, count(*) FILTER (n > 1) AS o FROM g GROUP BY ALL)
SELECT table_id, count(*) AS rows, max(width) AS columns, min(width) <> max(width) AS ragged, CAST(sum(o) AS BIGINT) AS overlapping_places FROM w GROUP BY table_id"""
)
def table_geometry(spark, sf_dir):
    quantity = F.col("l_quantity").cast("int")
    cells = table(spark, sf_dir, "lineitem").select(F.lit(0).alias("doc_id"), F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row"), (quantity % 4).alias("col"), (1 + quantity % 2).alias("row_span"), (1 + F.col("l_linenumber") % 3).alias("col_span"))
    return hierarchy.table_geometry(cells).drop("doc_id")


@query("SELECT doc_id, CASE WHEN n_chars * 100 < 10240 THEN 'tiny' WHEN n_chars * 100 < 1048576 THEN 'small' WHEN n_chars * 100 < 26214400 THEN 'medium' WHEN n_chars * 100 < 262144000 THEN 'large' ELSE 'huge' END AS bucket FROM documents")
def size_bucket(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", derived.size_bucket(F.col("n_chars") * 100).alias("bucket"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS digits FROM orders")
def date_digits(spark, sf_dir):
    text = F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", derived.date_digits(text).alias("digits"))


@query("SELECT p_partkey, 'X' || p_name AS name, CASE WHEN p_size & 4 <> 0 THEN true WHEN p_size & 32 <> 0 THEN false END AS symbolic, CAST(len(regexp_extract_all(p_name, '[0-9A-Fa-f]')) AS INTEGER) AS hex_digits, CASE WHEN p_size < 10 THEN 'object ' || p_partkey || ' 0' ELSE 'offset ' || p_size END AS location FROM part")
def font_properties(spark, sf_dir):
    name = F.concat(F.lit("ABCDEF+X"), "p_name")
    location = derived.location_text(F.lit(None).cast("string"), F.when(F.col("p_size") < 10, F.col("p_partkey")), F.lit(None).cast("int"), F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", derived.without_subset_prefix(name).alias("name"), derived.is_symbolic(F.col("p_size"), name).alias("symbolic"), derived.hex_digit_count(F.col("p_name")).alias("hex_digits"), location.alias("location"))


@query("SELECT l_orderkey, l_linenumber, greatest(l_extendedprice - l_quantity * 1000, 0.0) AS width, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 3 ELSE 4 END AS components FROM lineitem")
def geometry_and_color(spark, sf_dir):
    family = F.when(F.col("l_returnflag") == "A", "DeviceGray").when(F.col("l_returnflag") == "N", "Lab").otherwise("DeviceCMYK")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", derived.span_length(F.col("l_quantity") * 1000, F.col("l_extendedprice")).alias("width"), derived.component_count(F.lit(None).cast("int"), family).alias("components"))


# The object graph, structure trees and metadata.


_KINDS = """WITH d AS (SELECT p_partkey, ['Pages', 'Font', 'XObject', 'Other', 'Annot'][1 + p_partkey % 5] AS t, ['Image', 'Form', 'Widget', 'Type0', 'PS', 'CIDFontType2'][1 + p_size % 6] AS s,
 CASE WHEN p_size > 40 THEN ['Fields'] WHEN p_size > 30 THEN ['Filter', 'V'] WHEN p_size > 20 THEN ['Filter', 'N', 'Alternate'] ELSE ['N'] END AS keys, p_size FROM part)
"""


@query(
    _KINDS
    + """SELECT p_partkey, CASE WHEN s = 'Image' THEN 'image' WHEN s = 'Form' THEN 'formXObject' WHEN s = 'PS' THEN 'postScriptXObject' WHEN s = 'Widget' THEN 'formField' WHEN t = 'Pages' THEN 'pageTree' WHEN t = 'Font' THEN 'font' WHEN t = 'XObject' THEN 'xObject' WHEN t = 'Annot' THEN 'annotation'
 WHEN p_size > 40 THEN 'acroForm' WHEN p_size > 30 THEN 'security' WHEN p_size > 20 THEN 'iccProfile' END AS family,
 CASE s WHEN 'Type0' THEN 'type0' WHEN 'CIDFontType2' THEN 'cidFontType2' END AS font_kind, CASE s WHEN 'Image' THEN 'image' WHEN 'Form' THEN 'xObject' WHEN 'PS' THEN 'postScriptXObject' END AS xobject_kind FROM d"""
)
def family_classification(spark, sf_dir):
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    t, sub = pick(["Pages", "Font", "XObject", "Other", "Annot"], F.col("p_partkey") % 5), pick(["Image", "Form", "Widget", "Type0", "PS", "CIDFontType2"], F.col("p_size") % 6)
    size, some = F.col("p_size"), lambda *x: F.array(*map(F.lit, x))
    keys = F.when(size > 40, some("Fields")).when(size > 30, some("Filter", "V")).when(size > 20, some("Filter", "N", "Alternate")).otherwise(some("N"))
    return table(spark, sf_dir, "part").select("p_partkey", model.family(t, sub, keys).alias("family"), model.font_kind(sub).alias("font_kind"), model.xobject_kind(sub).alias("xobject_kind"))


def _links(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    links = rows.select(F.lit(0).alias("doc_id"), F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.col("o_orderkey").alias("ord"))
    objects = rows.select(F.lit(0).alias("doc_id"), F.col("o_orderkey").alias("identity_key"), F.col("o_orderstatus").alias("family"), "o_totalprice")
    return links, objects


@query("SELECT o_custkey AS src, count(*) AS n, min(o_totalprice) AS least, CASE WHEN count(*) = 1 THEN min(o_totalprice) END AS scalar FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey")
def link_resolution(spark, sf_dir):
    return model.linked_values(*_links(spark, sf_dir), "O", "o_totalprice").select("src", "n", "least", "scalar")


@query("SELECT o_custkey AS src, list(o_totalprice ORDER BY o_orderkey)[1:3] AS values FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey")
def link_lists(spark, sf_dir):
    return model.link_lists(*_links(spark, sf_dir), "O", "o_totalprice", 3).select("src", "values")


@query("SELECT user_id, event_type, min(event_id) AS visit_seq FROM events GROUP BY user_id, event_type")
def identity_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), model.identity_key(F.col("event_type")).alias("identity_key"), F.col("event_id").alias("visit_seq"))
    return model.distinct_objects(rows).select(F.col("doc_id").alias("user_id"), F.col("identity_key").alias("event_type"), "visit_seq")


@query(_TREE + "SELECT doc_id, p_type AS key, arg_max(p_partkey, node) AS value FROM (SELECT p_partkey % 3 AS doc_id, p_partkey // 3 AS node, p_type, p_partkey FROM part) x JOIN p USING (doc_id, node) WHERE node = 1 OR list_contains(path, 1) GROUP BY ALL")
def name_tree(spark, sf_dir):
    nodes = _tree(spark, sf_dir)
    entries = nodes.select("doc_id", "node", F.lit(0).alias("seq"), F.col("p_type").alias("key"), (F.col("node") * 3 + F.col("doc_id")).alias("value"))
    roots = nodes.filter("parent IS NULL").select("doc_id", F.col("node").alias("root"))
    return model.tree_entries(nodes, entries, roots).select("doc_id", "key", "value")


@query(
    _TREE
    + """, c AS (SELECT doc_id, node, unnest(list_concat([node], path)) AS at, unnest(range(len(path) + 1)) AS step FROM p)
SELECT c.doc_id, c.node, r.role AS name, arg_min(r.node, step) AS object, CAST(min(step) AS INTEGER) AS scope FROM c JOIN t r ON r.doc_id = c.doc_id AND r.node = c.at GROUP BY ALL"""
)
def effective_resources(spark, sf_dir):
    nodes = _tree(spark, sf_dir)
    resources = nodes.select("doc_id", "node", F.lit("font").alias("family"), F.col("role").alias("name"), F.col("node").alias("object"))
    return model.effective_resources(nodes, resources).select("doc_id", "node", "name", "object", "scope")


@query(
    """WITH c AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'TH' ELSE 'TD' END AS role, CASE WHEN l_linenumber = 1 THEN 'h' || (l_orderkey % 100) END AS id, l_linenumber = 1 AND l_quantity > 25 AS scoped,
 CASE WHEN l_linenumber % 3 = 0 THEN [] ELSE ['h' || (l_suppkey % 150), 'h' || (l_partkey % 120)] END AS headers FROM lineitem), k AS (SELECT DISTINCT id FROM c WHERE id IS NOT NULL), s AS (SELECT l_orderkey, bool_or(scoped) AS sc FROM c GROUP BY 1),
e AS (SELECT l_orderkey, l_linenumber, unnest(headers) AS h FROM c WHERE role = 'TD'), n AS (SELECT l_orderkey, l_linenumber, count(k.id) AS hits, coalesce(string_agg(DISTINCT h, ',' ORDER BY h) FILTER (k.id IS NULL), '') AS lost FROM e LEFT JOIN k ON k.id = h GROUP BY 1, 2)
SELECT c.l_orderkey * 10 + c.l_linenumber AS node, CASE WHEN role = 'TH' THEN true ELSE coalesce(hits, 0) > 0 OR sc END AS connected, CASE WHEN role = 'TH' THEN '' WHEN coalesce(lost, '') <> '' THEN lost WHEN hits IS NULL AND NOT sc THEN 'missing' ELSE '' END AS unknown_headers
FROM c LEFT JOIN n ON n.l_orderkey = c.l_orderkey AND n.l_linenumber = c.l_linenumber JOIN s ON s.l_orderkey = c.l_orderkey"""
)
def header_cells(spark, sf_dir):
    first = F.col("l_linenumber") == 1
    ids = F.array(F.concat(F.lit("h"), (F.col("l_suppkey") % 150).cast("string")), F.concat(F.lit("h"), (F.col("l_partkey") % 120).cast("string")))
    cells = table(spark, sf_dir, "lineitem").select(
        F.lit(0).alias("doc_id"), F.col("l_orderkey").alias("table_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("node"), F.when(first, "TH").otherwise("TD").alias("role"), F.when(first, F.concat(F.lit("h"), (F.col("l_orderkey") % 100).cast("string"))).alias("id"),
        F.when(first & (F.col("l_quantity") > 25), "Col").alias("scope"), F.when(F.col("l_linenumber") % 3 == 0, F.array().cast("array<string>")).otherwise(ids).alias("headers"),
    )
    return accessibility.header_cells(cells).select("node", "connected", "unknown_headers")


@query("SELECT conv_id AS doc_id, role AS name, arg_min(text, struct_pack(a := turn % 3 <> 0, b := turn)) AS value FROM conversations GROUP BY ALL")
def metadata_pick(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit("n").alias("namespace"), F.col("role").alias("name"), F.when(F.col("turn") % 3 == 0, "x-default").alias("lang"), F.col("turn").alias("seq"), F.col("text").alias("value"))
    return metadata.picked_text(rows).select("doc_id", "name", "value")


@query("SELECT conv_id AS doc_id, CASE WHEN count(*) = 1 THEN any_value(role) ELSE '[' || string_agg(role, ',' ORDER BY turn) || ']' END AS creators FROM conversations GROUP BY conv_id")
def metadata_creators(spark, sf_dir):
    return metadata.creator_text(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), F.col("role").alias("value")))


@query("WITH f AS (SELECT n_nationkey, ['pdfa-', 'pdfua-', 'other-'][1 + n_nationkey % 3] || (1 + n_nationkey % 5) || CASE WHEN n_nationkey % 2 = 0 THEN 'b' ELSE '' END AS t FROM nation) SELECT n_nationkey, t, CASE WHEN regexp_full_match(t, 'pdfa-[1-4][a-z]?|pdfua-[1-2]') THEN CAST(regexp_extract(t, '-([0-9]+)', 1) AS INTEGER) END AS part, CASE WHEN regexp_full_match(t, 'pdfa-[1-4][a-z]?|pdfua-[1-2]') THEN regexp_extract(t, '-[0-9]+(.*)$', 1) END AS conformance FROM f")
def flavour_parsing(spark, sf_dir):
    key = F.col("n_nationkey")
    family = F.element_at(F.array(F.lit("pdfa"), F.lit("pdfua"), F.lit("other")), (1 + key % 3).cast("int"))
    text = metadata.flavour_name(family, 1 + key % 5, F.when(key % 2 == 0, "b"))
    return table(spark, sf_dir, "nation").select("n_nationkey", text.alias("t"), metadata.flavour(text)["part"].alias("part"), metadata.flavour(text)["conformance"].alias("conformance"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'parseFailed' WHEN o_orderkey % 11 = 0 THEN 'encrypted' WHEN o_custkey % 4 <> 1 THEN 'flavourNotUnique' WHEN o_orderstatus <> 'F' THEN 'notValid' ELSE 'noAction' END AS decision FROM orders")
def repair_decision(spark, sf_dir):
    parsed = F.when(F.col("o_orderkey") % 7 == 0, "parseFailed").when(F.col("o_orderkey") % 11 == 0, "encrypted").otherwise("success")
    decision = metadata.repair_decision(parsed, F.when(F.col("o_orderstatus") == "F", "valid").otherwise("invalid"), F.col("o_custkey") % 4)
    return table(spark, sf_dir, "orders").select("o_orderkey", decision.alias("decision"))


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 'kept' ELSE 'ours ' || quality || ', theirs ' || toxic END AS reason FROM labels")
def comparison_reason(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    note = F.when(F.col("quality") == 1, "kept")
    return rows.select("doc_id", metadata.comparison_reason(note, F.lit("expectedDrift"), F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("reason"))


@query(
    """WITH r AS (SELECT DISTINCT p_brand AS profile_id, p_size % 12 AS minor, p_type AS rule_id, p_partkey % 7 = 0 AS bad FROM part),
v AS (SELECT profile_id, max(minor) AS minor FROM r GROUP BY 1), one AS (SELECT profile_id, minor, rule_id, bool_or(bad) AS bad FROM r GROUP BY ALL)
SELECT profile_id, '1.' || minor AS version, 'pdfa' AS family, CAST(right(profile_id, 1) AS INTEGER) AS part, '' AS conformance, 'source ' || minor AS source, count(*) AS rules, count(*) FILTER (bad) AS unsupported, count(*) FILTER (NOT bad) AS executable, count(*) FILTER (NOT bad) * 100 // count(*) AS percent
FROM v JOIN one USING (profile_id, minor) GROUP BY profile_id, minor"""
)
def profile_entries(spark, sf_dir):
    """Brands as profiles in up to twelve versions, 1.0 to 1.11, types as their rules."""
    minor = (F.col("p_size") % 12).cast("string")
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("profile_id"), F.concat(F.lit("1."), minor).alias("version"), F.col("p_type").alias("rule_id"), F.when(F.col("p_partkey") % 7 == 0, "unknown property").alias("reason"), minor.alias("minor"))
    versions = rows.select("profile_id", "version", F.lit("pdfa").alias("family"), F.substring("profile_id", -1, 1).cast("int").alias("part"), F.lit(None).cast("string").alias("conformance"), F.concat(F.lit("source "), "minor").alias("source")).distinct()
    return profiles.catalogue_entries(versions, rows)
