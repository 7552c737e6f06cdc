"""Order and reach in object graphs: pre-order numbers, reachable sets under a budget, paths planned together.

Trees and graphs are tables of links.  Nothing here holds a path, a tree or a frontier in one task or on the
driver: rounds are joins of written tables, and their number is logarithmic in a tree's size or equal to the
longest shortest path of a graph.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.shared import materialise


def visit_order(nodes: DataFrame, most_nodes: int | None = None, most_depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Pre-order numbers of a forest: ``doc_id``, ``node``, ``pre``, ``depth``, ``last``, and warnings ``doc_id``, ``node``, ``kind``.

    *nodes* has ``doc_id``, ``node``, ``parent`` (null for a root) and ``ord``, the place among its siblings
    (ties: the smaller node).  ``pre`` counts from 0 in each document, trees following each other in order of
    their roots; a subtree is the nodes numbered ``pre`` to ``last``.  Of a node's rows the first by parent and
    ord stands, others are warned of as ``repeated``; a node whose parent isn't there is a root
    (``orphan``), one on or under a cycle has no number (``cycle``).  Nodes numbered *most_nodes* or more, or
    deeper than *most_depth*, go with the warnings ``nodeCap`` and ``depthCap``; null nodes are ignored.

    The tour that enters and leaves each node is a linked list; the sums along it come by doubling: a chain of
    100,000 nodes takes 18 rounds, each a join of two rows a node.
    """
    ranked = nodes.filter("node IS NOT NULL").select("doc_id", "node", "parent", "ord")
    first = ranked.groupBy("doc_id", "node").agg(F.min(F.struct("parent", "ord")).alias("f"), F.count("*").alias("n"))
    first = materialise(first.select("doc_id", "node", "f.parent", "f.ord", "n"), "visit-nodes")
    there = first.select("doc_id", F.col("node").alias("parent"), F.lit(True).alias("there"))
    known = materialise(first.join(there, ["doc_id", "parent"], "left").select("doc_id", "node", F.when(F.col("there"), F.col("parent")).alias("parent"), "ord", "n", (F.col("parent").isNotNull() & F.col("there").isNull()).alias("orphan")), "visit-known")
    warnings = [known.filter("n > 1").select("doc_id", "node", F.lit("repeated").alias("kind")), known.filter("orphan").select("doc_id", "node", F.lit("orphan").alias("kind"))]

    siblings = Window.partitionBy("doc_id", "parent").orderBy("ord", "node")
    placed = materialise(known.select("doc_id", "node", "parent", F.lead("node").over(siblings).alias("sibling"), (F.row_number().over(siblings) == 1).alias("eldest")), "visit-placed")
    child = placed.filter("eldest AND parent IS NOT NULL").select("doc_id", F.col("parent").alias("node"), F.col("node").alias("child"))
    # an event is a node and whether it is left; the next of the last one is null
    entering = placed.join(child, ["doc_id", "node"], "left").select("doc_id", "node", F.lit(False).alias("left"), F.coalesce("child", "node").alias("next"), F.col("child").isNull().alias("next_left"), F.lit(1).cast("long").alias("enters"), F.lit(1).cast("long").alias("level"))
    leaving = placed.select("doc_id", "node", F.lit(True).alias("left"), F.coalesce("sibling", "parent").alias("next"), F.col("sibling").isNull().alias("next_left"), F.lit(0).cast("long").alias("enters"), F.lit(-1).cast("long").alias("level"))
    tour = materialise(entering.unionByName(leaving), "visit-tour")
    longest = tour.groupBy("doc_id").count().agg(F.max("count")).first()[0] or 0
    reach = 1
    # sums over the events from here up to, not including, the next
    while reach < longest:
        ahead = tour.select("doc_id", F.col("node").alias("next"), F.col("left").alias("next_left"), F.col("next").alias("further"), F.col("next_left").alias("further_left"), F.col("enters").alias("more_enters"), F.col("level").alias("more_level"))
        open_ = tour.filter("next IS NOT NULL").join(ahead, ["doc_id", "next", "next_left"])
        moved = open_.select("doc_id", "node", "left", F.col("further").alias("next"), F.col("further_left").alias("next_left"), (F.col("enters") + F.col("more_enters")).alias("enters"), (F.col("level") + F.col("more_level")).alias("level"))
        tour = materialise(tour.filter("next IS NULL").unionByName(moved), "visit-tour")
        reach *= 2
    both = tour.groupBy("doc_id", "node").agg(
        F.max(F.when(~F.col("left"), F.col("enters"))).alias("from_here"), F.max(F.when(F.col("left"), F.col("enters"))).alias("behind"), F.max(F.when(~F.col("left"), -F.col("level"))).alias("depth"), F.bool_or(F.col("next").isNotNull()).alias("endless")
    )
    both = materialise(both, "visit-sums")
    warnings.append(both.filter("endless").select("doc_id", "node", F.lit("cycle").alias("kind")))
    total = both.filter("NOT endless").groupBy("doc_id").agg(F.max("from_here").alias("total"))
    found = both.filter("NOT endless").join(total, "doc_id").select("doc_id", "node", (F.col("total") - F.col("from_here")).alias("pre"), "depth", (F.col("total") - F.col("behind") - 1).alias("last"))
    for kind, most, column in (("nodeCap", most_nodes, F.col("pre")), ("depthCap", None if most_depth is None else most_depth + 1, F.col("depth"))):
        if most is not None:
            warnings.append(found.filter(column >= most).select("doc_id", "node", F.lit(kind).alias("kind")))
            found = found.filter(column < most)
    out = warnings[0]
    for w in warnings[1:]:
        out = out.unionByName(w)
    return found, out


def reachable(links: DataFrame, roots: DataFrame, budget: int | None = None) -> DataFrame:
    """``doc_id``, ``node``, ``steps``, ``truncated``: what *roots* (``doc_id``, ``node``) reach over *links* (``doc_id``, ``src``, ``dst``).

    ``steps`` is the length of the shortest way.  Each round joins only the nodes found in the last one to the
    links and drops what was visited, so a link is followed once.  Where a document would have more than
    *budget* nodes, those of fewer steps, then the smaller ones, stay, nothing further is visited there, and
    all its rows say ``truncated``; the rows don't depend on how the tables are partitioned.  Cycles, repeated links
    and links from nowhere are harmless; null nodes are ignored.
    """
    fresh = roots.filter("node IS NOT NULL").select("doc_id", "node").distinct().withColumn("steps", F.lit(0))
    used = materialise(links.filter("src IS NOT NULL AND dst IS NOT NULL").select("doc_id", "src", "dst").distinct(), "reach-links")
    visited, full, steps = None, None, 0
    while True:
        if budget is not None:
            counts = (fresh if visited is None else fresh.unionByName(visited)).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("steps") == steps).alias("new"))
            over = materialise(counts.filter(F.col("n") > budget).select("doc_id", (F.lit(budget) - F.col("n") + F.col("new")).alias("room")), "reach-over")
            # ranks are asked of documents over the budget only, and up to the budget, which Spark prunes before the shuffle
            nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("node"))
            cut = fresh.join(over, "doc_id").withColumn("nth", nth).filter(F.col("nth") <= budget).filter(F.col("nth") <= F.col("room")).select("doc_id", "node", "steps")
            fresh = fresh.join(over, "doc_id", "left_anti").unionByName(cut)
            full = over.select("doc_id") if full is None else full.unionByName(over.select("doc_id"))
        fresh = materialise(fresh, "reach-fresh")
        if fresh.isEmpty():
            break
        visited = fresh if visited is None else visited.unionByName(fresh)
        steps += 1
        going = fresh if full is None else fresh.join(full, "doc_id", "left_anti")
        found = going.join(used, (going["doc_id"] == used["doc_id"]) & (going["node"] == used["src"])).select(used["doc_id"], F.col("dst").alias("node")).distinct()
        fresh = materialise(found.join(visited, ["doc_id", "node"], "left_anti").withColumn("steps", F.lit(steps)), "reach-found")
    out = fresh if visited is None else visited
    if full is None:
        return out.withColumn("truncated", F.lit(False))
    marks = full.distinct().withColumn("truncated", F.lit(True))
    return out.join(marks, "doc_id", "left").select("doc_id", "node", "steps", F.coalesce("truncated", F.lit(False)).alias("truncated"))


@dataclass(frozen=True)
class Edge:
    """A named link of a family: *objects* (key column ``id`` and properties) that it leads to.

    A link that is a column of its source (*column*) leads to one object at most; else *links* has ``src``, ``dst``, ``ord``.
    """

    target: str
    objects: DataFrame
    column: str | None = None
    links: DataFrame | None = None


MAX_LIST = 65_536


def _trie(paths: Mapping[str, Sequence[str]]) -> dict:
    """Paths (edges, then a property) as nested dictionaries; a property's entry is the list of rules that read it."""
    root: dict = {"edges": {}, "reads": {}}
    for rule, path in paths.items():
        at = root
        for edge in path[:-1]:
            at = at["edges"].setdefault(edge, {"edges": {}, "reads": {}})
        at["reads"].setdefault(path[-1], []).append(rule)
    return root


def path_values(objects: DataFrame, family: str, edges: Mapping[tuple[str, str], Edge], paths: Mapping[str, Sequence[str]], most: int = MAX_LIST) -> DataFrame:
    """For each of *objects* (``id`` and properties) of *family* what every rule's path leads to.

    *paths* gives a rule's edges and the property at their end; *edges* is keyed by family and name.  The
    paths of all rules form a trie, and each of its edges is joined once, whatever the number of rules
    that share it; edges and properties that no path names are not read.  A rule's column is a struct: ``n``
    values, the ``scalar`` if there is one, the ``list`` in link order if there are more, as strings; a
    missing object or a null property counts as no value.  More than *most* values of one object are the ``error``
    ``list too long``, and their list is null; they are not gathered.  Unknown edges are an error here.
    """

    def values(rows: DataFrame, at: str, node: dict) -> DataFrame:
        """*rows* with a column of value lists for each rule below this node of the trie."""
        made = {rule: F.when(F.col(prop).isNotNull(), F.array(F.col(prop).cast("string"))).otherwise(F.array().cast("array<string>")) for prop, rules in node["reads"].items() for rule in rules}
        rows = rows.withColumns({f"_v_{rule}": v for rule, v in made.items()} | {f"_n_{rule}": F.size(v).cast("long") for rule, v in made.items()})
        for name, below in node["edges"].items():
            edge = edges[at, name]
            inner = values(edge.objects, edge.target, below)
            rules = [c[3:] for c in inner.columns if c.startswith("_v_")]
            own = [f"_{k}_{r}" for r in rules for k in "vn"]
            if edge.column is not None:
                reached = inner.select(F.col("id").alias("_dst"), *own)
                rows = rows.join(reached, F.col(edge.column) == F.col("_dst"), "left").drop("_dst")
            else:
                met = edge.links.select(F.col("src").alias("_src"), F.col("dst").alias("_dst"), F.col("ord").alias("_ord")).join(inner.select(F.col("id").alias("_dst"), *own), "_dst")
                before = Window.partitionBy("_src").orderBy("_ord", "_dst").rowsBetween(Window.unboundedPreceding, 0)
                kept = met.withColumns({f"_s_{r}": F.sum(f"_n_{r}").over(before) for r in rules})
                lists = [F.array_sort(F.collect_list(F.when((F.col(f"_s_{r}") <= most) & (F.col(f"_n_{r}") > 0), F.struct("_ord", "_dst", F.col(f"_v_{r}").alias("v"))))) for r in rules]
                flat = [F.flatten(F.transform(x, lambda e: e["v"])).alias(f"_v_{r}") for r, x in zip(rules, lists)]
                reached = kept.groupBy("_src").agg(*flat, *[F.sum(f"_n_{r}").alias(f"_n_{r}") for r in rules])
                rows = rows.join(reached, F.col("id") == F.col("_src"), "left").drop("_src")
            rows = rows.withColumns({f"_v_{r}": F.coalesce(f"_v_{r}", F.array().cast("array<string>")) for r in rules} | {f"_n_{r}": F.coalesce(f"_n_{r}", F.lit(0).cast("long")) for r in rules})
        return rows

    rows = values(objects, family, _trie(paths))
    out = []
    for rule in paths:
        n, v = F.col(f"_n_{rule}"), F.col(f"_v_{rule}")
        out.append(F.struct(n.alias("n"), F.when(n == 1, F.get(v, F.lit(0))).alias("scalar"), F.when((n > 1) & (n <= most), v).alias("list"), F.when(n > most, "list too long").alias("error")).alias(rule))
    return rows.select("id", *out)
