"""Content streams as ordered rows of operators: families, spans, depth, resources.

A row is ``doc_id``, ``stream``, ``seq``, ``op`` and what the operator names.  Families come from a small
lookup table; spans and depth are running sums in stream order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The families of content operators.
FAMILIES = {
    "inlineImage": "BI",
    "text": "BT ET Tc Tw Tz TL Tf Tr Ts Td TD Tm T*",
    "textShow": "Tj TJ ' \"",
    "markedContent": "BMC BDC MP DP EMC",
    "graphicsState": "q Q cm w J j M d ri i gs",
    "color": "CS cs SC SCN sc scn G g RG rg K k sh",
    "xObject": "Do",
    "path": "m l c v y h re S s f F f* B B* b b* n W W*",
    "compatibility": "BX EX",
}
RESOURCE_OF = {"Tf": "font", "gs": "extGState", "CS": "colorSpace", "cs": "colorSpace", "sh": "shading", "Do": "xObject"}
MAX_OPERATORS = 100_000


def operator_family(op: Column) -> Column:
    """The family of an operator; ``unknown`` for any other word."""
    pairs = [F.lit(x) for family, ops in FAMILIES.items() for o in ops.split() for x in (o, family)]
    return F.coalesce(F.element_at(F.create_map(*pairs), op), F.lit("unknown"))


def classified(rows: DataFrame) -> DataFrame:
    return rows.withColumn("operator_family", operator_family(F.col("op")))


def within_limit(rows: DataFrame, most: int = MAX_OPERATORS) -> DataFrame:
    """The first operators of each stream, and whether the stream has more."""
    w = Window.partitionBy("doc_id", "stream")
    nth = F.row_number().over(w.orderBy("seq"))
    return rows.withColumn("_nth", nth).withColumn("truncated", F.count("*").over(w) > most).filter(F.col("_nth") <= most).drop("_nth")


def with_depth(rows: DataFrame) -> DataFrame:
    """Depth of marked content and of saved graphics states at each operator."""
    from quillspark.operators.hierarchy import nesting_depth

    keys, order, op = ["doc_id", "stream"], ["seq"], F.col("op")
    marked = nesting_depth(rows, keys, order, op.isin("BMC", "BDC"), op == "EMC", "marked_depth")
    return nesting_depth(marked, keys, order, op == "q", op == "Q", "state_depth")


def marked_spans(rows: DataFrame) -> DataFrame:
    """Each marked-content span with its end, its depth and whether text or an image is shown inside.

    An opening and a closing operator at the same depth belong together: the n-th opening with the n-th
    closing of that depth.  What is shown inside is counted as the difference of running counts.
    """
    w = Window.partitionBy("doc_id", "stream").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    op = F.col("op")
    shown = with_depth(rows)
    shown = shown.withColumn("_text", F.count_if(op.isin("Tj", "TJ", "'", '"')).over(w)).withColumn("_image", F.count_if(op.isin("Do", "BI")).over(w))
    opening = shown.filter(op.isin("BMC", "BDC")).withColumn("level", F.col("marked_depth"))
    # a closing operator at depth 0 has nothing to close
    before = F.lag("marked_depth", 1, 0).over(Window.partitionBy("doc_id", "stream").orderBy("seq"))
    closing = shown.withColumn("_before", before).filter((op == "EMC") & (F.col("_before") > 0)).withColumn("level", F.col("marked_depth") + 1)
    at_level = Window.partitionBy("doc_id", "stream", "level").orderBy("seq")
    opened = opening.withColumn("nth", F.row_number().over(at_level)).select("doc_id", "stream", "level", "nth", F.col("seq").alias("start_seq"), F.col("_text").alias("_t0"), F.col("_image").alias("_i0"))
    closed = closing.withColumn("nth", F.row_number().over(at_level)).select("doc_id", "stream", "level", "nth", F.col("seq").alias("end_seq"), F.col("_text").alias("_t1"), F.col("_image").alias("_i1"))
    whole = rows.groupBy("doc_id", "stream").agg(F.count_if(op.isin("Tj", "TJ", "'", '"')).alias("_t"), F.count_if(op.isin("Do", "BI")).alias("_i"))
    spans = opened.join(closed, ["doc_id", "stream", "level", "nth"], "left").join(whole, ["doc_id", "stream"])
    return spans.select("doc_id", "stream", "start_seq", "end_seq", F.col("level").alias("depth"), (F.coalesce("_t1", "_t") > F.col("_t0")).alias("has_text"), (F.coalesce("_i1", "_i") > F.col("_i0")).alias("has_image"))


def resource_uses(rows: DataFrame) -> DataFrame:
    """The named resources that operators use."""
    pairs = [F.lit(x) for item in RESOURCE_OF.items() for x in item]
    kind = F.element_at(F.create_map(*pairs), F.col("op"))
    return rows.withColumn("family", kind).filter(F.col("family").isNotNull() & F.col("name").isNotNull()).select("doc_id", "stream", "seq", "op", "family", "name")


def resolved_uses(uses: DataFrame, resources: DataFrame) -> DataFrame:
    """``status`` of each use: ``resolved``, ``missing`` or ``wrongType``; the innermost scope wins.

    *resources* has ``doc_id``, ``family``, ``name``, ``scope`` (0 innermost) and ``object_family``.
    """
    best = resources.groupBy("doc_id", "family", "name").agg(F.min_by("object_family", "scope").alias("object_family"))
    found = uses.join(best, ["doc_id", "family", "name"], "left")
    status = F.when(F.col("object_family").isNull(), "missing").when(F.col("object_family") == F.col("family"), "resolved").otherwise("wrongType")
    return found.withColumn("status", status)


def stream_summary(rows: DataFrame) -> DataFrame:
    """Per stream: operators, unknown ones, text, marked content, images, deepest nesting."""
    deep = classified(with_depth(rows))
    family = F.col("operator_family")
    return deep.groupBy("doc_id", "stream").agg(
        F.count("*").alias("operator_count"), F.count_if(family == "unknown").alias("unknown_count"), F.bool_or(family == "textShow").alias("has_text"), F.bool_or(family == "markedContent").alias("has_marked_content"),
        F.bool_or(family == "inlineImage").alias("has_inline_image"), F.max("marked_depth").alias("nesting_level"),
    )
