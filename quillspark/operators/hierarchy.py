"""Trees in tables: inheritance, ancestors, nesting, trees of pages and of roles.

A tree is ``doc_id``, ``node``, ``parent``.  Paths to the root come from joins that double their length
each round; every question about ancestors is then one expression over the path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.shared import materialise

MAX_DEPTH = 128
# Roles of the standard structure tree that group others.
GROUPING_ROLES = ("Document", "Part", "Art", "Sect", "Div", "BlockQuote", "Caption", "TOC", "TOCI", "Index", "NonStruct", "Private", "Aside", "DocumentFragment", "Title")
# Roles by what they are about.
ROLE_FAMILIES = {"table": ("Table", "TR", "TH", "TD", "THead", "TBody", "TFoot"), "list": ("L", "LI", "Lbl", "LBody"), "heading": ("H", "H1", "H2", "H3", "H4", "H5", "H6"), "link": ("Link",)}
FORMULA_ROLES = ("Formula", "MathML")

# The roles of the standard structure tree.
STANDARD_ROLES = (
    "Document", "Part", "Art", "Sect", "Div", "BlockQuote", "Caption", "TOC", "TOCI", "Index", "NonStruct", "Private", "P", "H", "H1", "H2", "H3", "H4", "H5", "H6", "L", "LI", "Lbl", "LBody", "Table", "TR", "TH", "TD", "THead", "TBody", "TFoot",
    "Span", "Quote", "Note", "Reference", "BibEntry", "Code", "Link", "Annot", "Ruby", "Warichu", "Figure", "Formula", "Form", "Artifact", "Strong", "Em", "Title", "FENote", "Aside", "Sub", "MathML",
)


def is_standard_role(role: Column) -> Column:
    return F.coalesce(role.isin(*STANDARD_ROLES), F.lit(False))


def is_grouping_role(role: Column) -> Column:
    return F.coalesce(role.isin(*GROUPING_ROLES), F.lit(False))


def ancestor_paths(nodes: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``doc_id``, ``node``, ``depth``, ``path`` (parent first, root last); a cycle ends the path.

    Paths double in each round: a path and the path of its top make the next one, so a tree of depth d
    takes log2(d) joins.  Each round is a written table.
    """
    state = nodes.select("doc_id", "node", F.when(F.col("parent").isNotNull(), F.array("parent")).otherwise(F.array().cast("array<bigint>")).alias("path"), F.col("parent").alias("top"))
    reach = 1
    while True:
        state = materialise(state, "tree-paths")
        if reach >= max_depth or state.filter("top IS NOT NULL").isEmpty():
            break
        above = state.select(F.col("doc_id"), F.col("node").alias("top"), F.col("path").alias("_more"), F.col("top").alias("_top"))
        joined = state.join(above, ["doc_id", "top"], "left")
        state = joined.select("doc_id", "node", F.concat("path", F.coalesce("_more", F.array().cast("array<bigint>"))).alias("path"), F.col("_top").alias("top"))
        reach *= 2
    # the first node that comes again, or the node itself, ends the path, as does the limit
    start = F.struct(F.array().cast("array<bigint>").alias("kept"), F.lit(False).alias("done"))

    def step(acc: Column, x: Column) -> Column:
        done = acc["done"] | (x == F.col("node")) | F.array_contains(acc["kept"], x)
        return F.struct(F.when(done, acc["kept"]).otherwise(F.array_append(acc["kept"], x)).alias("kept"), done.alias("done"))

    path = F.slice(F.aggregate("path", start, step, lambda acc: acc["kept"]), 1, max_depth)
    known = nodes.select("doc_id", F.col("node").alias("_last"))
    cut = state.select("doc_id", "node", path.alias("path")).withColumn("_last", F.get("path", F.size("path") - 1))
    # a parent that isn't a node of the tree ends the path before it
    found = cut.join(known.withColumn("_known", F.lit(True)), ["doc_id", "_last"], "left")
    path = F.when(F.col("_last").isNotNull() & F.col("_known").isNull(), F.slice("path", 1, F.size("path") - 1)).otherwise(F.col("path"))
    return found.select("doc_id", "node", path.alias("path")).select("doc_id", "node", F.size("path").alias("depth"), "path")


def role_family(role: Column) -> Column:
    """What a role is about: table, list, heading or link; null for any other."""
    found = F.lit(None).cast("string")
    for name, roles in ROLE_FAMILIES.items():
        found = F.when(role.isin(*roles), name).otherwise(found)
    return found


def inherited_together(nodes: DataFrame, values: dict[str, Column], max_depth: int = MAX_DEPTH) -> DataFrame:
    """``doc_id``, ``node`` and each of *values* (new name: expression over *nodes*), the node's own or that of its nearest ancestor.

    All are carried in the same rounds: each joins once, whatever the number of values, and reaches twice as far.
    A node asks on as long as one of its values is missing.  What is above *max_depth*, or nowhere, is null.
    """
    open_ = F.lit(False)
    for x in values.values():
        open_ = open_ | x.isNull()
    state = nodes.select("doc_id", "node", F.when(open_, F.col("parent")).alias("_top"), *[x.alias(k) for k, x in values.items()])
    reach = 1
    while True:
        state = materialise(state, "tree-together")
        if reach > max_depth or state.filter(F.col("_top").isNotNull()).isEmpty():
            break
        above = state.select("doc_id", F.col("node").alias("_top"), F.col("_top").alias("_next"), *[F.col(k).alias(f"_above_{k}") for k in values])
        met = state.filter(F.col("_top").isNotNull()).join(above, ["doc_id", "_top"], "left")
        now = {k: F.coalesce(k, f"_above_{k}") for k in values}
        missing = F.lit(False)
        for x in now.values():
            missing = missing | x.isNull()
        met = met.select("doc_id", "node", F.when(missing, F.col("_next")).alias("_top"), *[x.alias(k) for k, x in now.items()])
        state = state.filter(F.col("_top").isNull()).unionByName(met)
        reach *= 2
    return state.drop("_top")


def node_facts(nodes: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """*nodes* (``doc_id``, ``node``, ``parent``, ``role``, ``lang``) with what rules ask of a structure element.

    ``standard``, ``grouping`` and ``role_family`` follow from the role; ``level`` and ``nests`` as in :func:`heading_nests`;
    ``parent_lang`` is that of the nearest element above that has one, ``in_formula`` whether a formula is above.  What
    is above comes in one set of doubling rounds.  A null role is none of these, a parent that isn't a node ends the
    way up, a cycle is followed to *max_depth* at most, and repeated nodes aren't allowed.
    """
    level = heading_level(F.coalesce("role", F.lit("")))
    asked = {"_heading": F.when(level > 0, level), "_lang": F.col("lang"), "_formula": F.when(F.col("role").isin(*FORMULA_ROLES), True)}
    above = inherited_together(nodes, asked, max_depth).withColumnRenamed("node", "parent")
    role = F.col("role")
    nests = F.when(level <= 1, True).otherwise(F.coalesce(F.col("_heading") < level, F.lit(False)))
    facts = {"standard": is_standard_role(role), "grouping": is_grouping_role(role), "role_family": role_family(role), "level": level, "nests": nests, "parent_lang": F.col("_lang"), "in_formula": F.coalesce("_formula", F.lit(False))}
    return nodes.join(above, ["doc_id", "parent"], "left").select(*nodes.columns, *[x.alias(k) for k, x in facts.items()])


def inherited(nodes: DataFrame, value: str, into: str, max_depth: int = MAX_DEPTH) -> DataFrame:
    """*nodes* (``doc_id``, ``node``, ``parent``) with *into*: the node's own *value*, else that of the nearest ancestor that has one.

    Only the value found so far and the next node to ask are carried; both reach twice as far in each round,
    each a written table.  A cycle without a value, and what is above *max_depth*, give null.
    """
    state = nodes.select("doc_id", "node", F.when(F.col(value).isNull(), F.col("parent")).alias("_top"), F.col(value).alias(into))
    reach = 1
    while True:
        state = materialise(state, "tree-inherited")
        if reach > max_depth or state.filter(F.col("_top").isNotNull()).isEmpty():
            break
        above = state.select("doc_id", F.col("node").alias("_top"), F.col("_top").alias("_next"), F.col(into).alias("_found"))
        met = state.filter(F.col("_top").isNotNull()).join(above, ["doc_id", "_top"], "left").select("doc_id", "node", F.col("_next").alias("_top"), F.col("_found").alias(into))
        state = state.filter(F.col("_top").isNull()).unionByName(met)
        reach *= 2
    return nodes.join(state.drop("_top"), ["doc_id", "node"], "left")


def nearest_value(nodes: DataFrame, paths: DataFrame | None, value: str, into: str, own: bool = True) -> DataFrame:
    """The value of the node itself (if *own*) or else of the nearest ancestor that has one; *paths* is not needed."""
    if own:
        return inherited(nodes, value, into)
    above = inherited(nodes, value, into).select("doc_id", F.col("node").alias("parent"), into)
    return nodes.join(above, ["doc_id", "parent"], "left").select(*nodes.columns, into)


def ancestor_roles(nodes: DataFrame, paths: DataFrame, role: str = "role") -> DataFrame:
    """``roles``: the roles of all ancestors, nearest first."""
    steps = paths.select("doc_id", "node", F.posexplode_outer("path").alias("_step", "_at"))
    named = nodes.select("doc_id", F.col("node").alias("_at"), F.col(role).alias("_role"))
    rows = steps.join(named, ["doc_id", "_at"], "left")
    inside = F.array_sort(F.collect_list(F.when(F.col("_role").isNotNull(), F.struct("_step", "_role"))))  # at most MAX_DEPTH
    return rows.groupBy("doc_id", "node").agg(F.transform(inside, lambda x: x["_role"]).alias("roles"))


def heading_level(role: Column) -> Column:
    """1 to 6 for H1 to H6, else 0."""
    return F.when(F.rlike(role, F.lit("^H[1-6]$")), F.substring(role, 2, 1).cast("int")).otherwise(0)


def heading_nests(roles: Column, role: Column) -> Column:
    """Whether the nearest heading above has a lower level; true at level 1 or less, false where there is none."""
    levels = F.filter(F.transform(roles, heading_level), lambda x: x > 0)
    level = heading_level(role)
    return F.when(level <= 1, True).otherwise(F.coalesce(F.get(levels, F.lit(0)) < level, F.lit(False)))


def child_roles(nodes: DataFrame, order: str = "node") -> DataFrame:
    """The roles of each parent's children in order, joined by ``&``."""
    children = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce("role", F.lit("")).alias("r"))))
    rows = nodes.filter(F.col("parent").isNotNull()).groupBy("doc_id", "parent").agg(F.array_join(F.transform(children, lambda x: x["r"]), "&").alias("child_roles"))
    return rows.withColumnRenamed("parent", "node")


def mapped_roles(roles: DataFrame, role_map: DataFrame, doublings: int = 5) -> DataFrame:
    """Follow a document's role map from each role, 32 steps at most.

    A chain that hasn't ended by then is ``cyclic`` and maps to the role itself.  *roles* has ``doc_id``,
    ``role``; *role_map* ``doc_id``, ``role``, ``target``, unique on the first two.  Jumps double in each
    round, and each round is a written table.
    """
    jump = role_map.select("doc_id", "role", "target")
    for _ in range(doublings):
        jump = materialise(jump, "role-map")
        onward = jump.select("doc_id", F.col("role").alias("target"), F.col("target").alias("_next"))
        jump = jump.join(onward, ["doc_id", "target"], "left").select("doc_id", "role", F.coalesce("_next", "target").alias("target"))
    jump = materialise(jump, "role-map")
    unfinished = role_map.select("doc_id", F.col("role").alias("target"), F.lit(True).alias("_more")).distinct()
    found = roles.select("doc_id", "role").distinct().join(jump, ["doc_id", "role"], "left").join(unfinished, ["doc_id", "target"], "left")
    cyclic = F.coalesce("_more", F.lit(False))
    return found.select("doc_id", "role", F.when(cyclic, F.col("role")).otherwise(F.coalesce("target", "role")).alias("mapped"), cyclic.alias("cyclic"))


def nesting_depth(rows: DataFrame, keys: list[str], order: list[str], opens: Column, closes: Column, into: str = "depth") -> DataFrame:
    """Running depth of opened and not yet closed spans, per key in order; it never falls below zero.

    With the running sum S and its running minimum m below zero, the clamped depth is S - min(0, m).
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    summed = rows.withColumn("_sum", F.sum(step).over(w))
    return summed.withColumn(into, F.col("_sum") - F.least(F.lit(0).cast("bigint"), F.min("_sum").over(w))).drop("_sum")


def table_geometry(cells: DataFrame) -> DataFrame:
    """Per table: ragged rows, overlapping cells and the grid's size.

    *cells* has ``doc_id``, ``table_id``, ``row``, ``col`` (the cell's first grid place), ``row_span`` and
    ``col_span``.  Each cell is spread over the places that it covers; places are then counted.
    """
    places = cells.select(
        "doc_id", "table_id", F.explode(F.sequence("row", F.col("row") + F.greatest("row_span", F.lit(1)) - 1)).alias("r"), F.col("col").alias("_c"), "col_span"
    ).select("doc_id", "table_id", "r", F.explode(F.sequence("_c", F.col("_c") + F.greatest("col_span", F.lit(1)) - 1)).alias("c"))
    taken = places.groupBy("doc_id", "table_id", "r", "c").agg(F.count("*").alias("n"))
    per_row = taken.groupBy("doc_id", "table_id", "r").agg(F.count("*").alias("width"), F.count_if(F.col("n") > 1).alias("overlaps"))
    return per_row.groupBy("doc_id", "table_id").agg(F.count("*").alias("rows"), F.max("width").alias("columns"), (F.min("width") != F.max("width")).alias("ragged"), F.sum("overlaps").alias("overlapping_places"))


def table_members(nodes: DataFrame, roles: tuple[str, ...] = ("TR", "TH", "TD")) -> DataFrame:
    """``doc_id``, ``table``, ``node``, ``role``, ``place``: nodes of *roles* under their nearest Table, numbered from 0 in pre-order.

    *nodes* has ``doc_id``, ``node``, ``parent``, ``ord``, ``role``.  A table inside a table is one of its own, whose
    members aren't those of the outer one.
    """
    from quillspark.operators.graphs import visit_order

    marked = nodes.withColumn("_table", F.when(F.col("role") == "Table", F.col("node")))
    above = nearest_value(marked, None, "_table", "table", own=False).filter(F.col("role").isin(*roles) & F.col("table").isNotNull())
    order = visit_order(nodes)[0].select("doc_id", "node", "pre")
    place = F.row_number().over(Window.partitionBy("doc_id", "table").orderBy("pre")) - 1
    return above.select("doc_id", "table", "node", "role").join(order, ["doc_id", "node"]).withColumn("place", place).select("doc_id", "table", "node", "role", "place")
