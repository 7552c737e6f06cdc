"""Metadata packets as property rows: picks, lists, claims, checks against schemas; repair decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def picked_text(properties: DataFrame) -> DataFrame:
    """Of each property's values that of ``x-default``, else the first."""
    order = F.struct((F.coalesce("lang", F.lit("")) != "x-default").alias("a"), F.col("seq").alias("b"))
    return properties.groupBy("doc_id", "namespace", "name").agg(F.min_by("value", order).alias("value"))


def one_default_title(properties: DataFrame) -> DataFrame:
    """Whether exactly one title isn't blank and that one is ``x-default``."""
    full = F.trim("value") != ""
    return properties.groupBy("doc_id").agg(((F.count_if(full) == 1) & (F.count_if(full & (F.col("lang") == "x-default")) == 1)).alias("title_ok"))


def creator_text(properties: DataFrame, most: int = 1_000) -> DataFrame:
    """Null without a creator, the creator if there is one, ``[a,b]`` if there are more (*most* at most)."""
    from quillspark.operators.joins import top_per_key

    rows = top_per_key(properties, ["doc_id"], ["seq"], most)
    values = F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"])
    found = rows.groupBy("doc_id").agg(values.alias("v"))
    return found.select("doc_id", F.when(F.size("v") == 1, F.get("v", F.lit(0))).otherwise(F.concat(F.lit("["), F.array_join("v", ","), F.lit("]"))).alias("creators"))


def packet_valid(facts: DataFrame) -> DataFrame:
    """A packet was parsed and none was malformed or hostile."""
    bad = F.bool_or(F.col("kind").isin("Malformed", "Hostile"))
    return facts.groupBy("doc_id").agg((F.bool_or(F.col("kind") == "PacketParsed") & ~bad).alias("serialization_valid"))


def spacing_complies(facts: DataFrame) -> DataFrame:
    return facts.groupBy("doc_id").agg((~F.coalesce(F.bool_or("bad_spacing"), F.lit(False))).alias("spacing_complies"))


def undefined_fields(used: DataFrame, predefined: DataFrame, declared: DataFrame) -> DataFrame:
    """Namespaces that are neither predefined nor declared by the document, distinct, sorted and joined."""
    lost = used.join(predefined.select("namespace"), "namespace", "left_anti").join(declared.select("doc_id", "namespace"), ["doc_id", "namespace"], "left_anti")
    return lost.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("namespace")), "&").alias("undefined"))


def flavour(text: Column) -> Column:
    """``auto``, or family, part and conformance of ``pdfa-2b``, ``pdfua-1``, ``wtpdf-1-0-reuse``; null otherwise."""
    parts = F.struct(F.regexp_extract(text, "^(auto|pdfa|pdfua|wtpdf)", 1).alias("family"), F.regexp_extract(text, "^[a-z]+-([0-9]+)", 1).try_cast("int").alias("part"), F.regexp_extract(text, "^[a-z]+-[0-9]+-?(.*)$", 1).alias("conformance"))
    return F.when(F.rlike(text, F.lit("^(auto|pdfa-[1-4][a-z]?|pdfua-[1-2]|wtpdf-1-0-(reuse|accessibility))$")), parts)


def flavour_name(family: Column, part: Column, conformance: Column) -> Column:
    return F.concat(family, F.lit("-"), part.cast("string"), F.coalesce(conformance, F.lit("")))


def repair_decision(parse_status: Column, status: Column, flavours: Column) -> Column:
    """Why a repair is refused, in order; ``noAction`` where the document is copied unchanged."""
    return F.when(parse_status == "parseFailed", "parseFailed").when(parse_status == "encrypted", "encrypted").when(flavours != 1, "flavourNotUnique").when(status != "valid", "notValid").otherwise("noAction")


def comparison_reason(note: Column, classification: Column, ours: Column, theirs: Column) -> Column:
    """The note, else nothing for a match, else both outcomes."""
    return F.coalesce(note, F.when(classification != "match", F.concat(F.lit("ours "), F.coalesce(ours, F.lit("none")), F.lit(", theirs "), F.coalesce(theirs, F.lit("none")))))


# Value types that extension schemas needn't declare.
VALUE_TYPES = ("Text", "URI", "URL", "XPath", "Boolean", "Integer", "Real", "Date", "AgentName", "ProperName", "MIMEType", "Lang Alt", "Seq", "Bag")


def extension_checks(documents: DataFrame, properties: DataFrame) -> DataFrame:
    """``doc_id``, ``text_valid``, ``seq_valid``, ``bag_valid``, ``types_defined`` of extension schemas.

    *properties* has ``doc_id``, ``role`` (text, sequence, bag, valueType or type), ``value`` and
    ``array_kind``.  Without properties of a role its check holds: texts mustn't be blank, one of the
    sequences (bags) must be one, and every value type is built in or declared by the document.
    """
    role = lambda x: F.col("role") == x
    checked = properties.groupBy("doc_id").agg(
        F.bool_and(F.when(role("text"), F.coalesce(F.trim("value") != "", F.lit(False)))).alias("text_valid"),
        F.bool_or(F.when(role("sequence"), F.col("array_kind").eqNullSafe("Seq"))).alias("seq_valid"),
        F.bool_or(F.when(role("bag"), F.col("array_kind").eqNullSafe("Bag"))).alias("bag_valid"),
    )
    used = properties.filter(role("valueType") & F.col("value").isNotNull() & ~F.col("value").isin(*VALUE_TYPES)).select("doc_id", "value")
    lost = used.join(properties.filter(role("type")).select("doc_id", "value"), ["doc_id", "value"], "left_anti").select("doc_id").distinct().withColumn("lost", F.lit(True))
    true = F.lit(True)
    rows = documents.select("doc_id").join(checked, "doc_id", "left").join(lost, "doc_id", "left")
    return rows.select("doc_id", *[F.coalesce(x, true).alias(x) for x in ("text_valid", "seq_valid", "bag_valid")], F.col("lost").isNull().alias("types_defined"))


def packet_warnings(packets: DataFrame, claims: DataFrame) -> DataFrame:
    """``doc_id``, ``warning``: a missing wrapper, a malformed or hostile packet, a claim made twice (``namespace``, ``name``).

    *packets* has ``doc_id``, ``has_wrapper``, ``malformed`` and ``hostile``.
    """
    made = F.array(F.when(~F.col("has_wrapper"), "missingWrapper"), F.when(F.col("malformed"), "malformed"), F.when(F.col("hostile"), "hostile"))
    own = packets.select("doc_id", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("warning"))
    twice = claims.groupBy("doc_id", "namespace", "name").count().filter("count > 1").select("doc_id", F.concat(F.lit("duplicate claim "), "name").alias("warning")).distinct()
    return own.unionByName(twice)


def capped_facts(facts: DataFrame, most: int) -> DataFrame:
    """The first *most* facts of each document in order of ``seq``, and one ``factCapReached`` row where there were more."""
    from quillspark.operators.joins import top_per_key

    kept = top_per_key(facts, ["doc_id"], ["seq"], most)
    over = facts.groupBy("doc_id").count().filter(F.col("count") > most).select("doc_id")
    reached = over.select("doc_id", *[(F.lit("factCapReached") if name == "kind" else F.lit(None)).cast(kind).alias(name) for name, kind in facts.dtypes if name != "doc_id"])
    return kept.select(*facts.columns).unionByName(reached)
