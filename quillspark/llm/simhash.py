"""SimHash near-dedup with a Gray-order hierarchical index.

1. Each text gives one 64-bit fingerprint, or several independent ones, in the task that reads it; the
   shingles of a whole batch are hashed and their bits counted together.
2. Distinct fingerprints are dealt by pigeonhole: of four 16-bit blocks, two fingerprints with at most
   three differing bits agree in one, so each fingerprint goes to four buckets (block, value).  A bucket
   above ``hot_bucket`` rows is dealt again by four parts of the bits that it doesn't agree in yet, as
   often as needed, which is as exact and bounds every bucket.
3. Within a bucket fingerprints are sorted by Gray rank.  Neighbours there share bit patterns; upper
   nodes of a tree keep the bits that all fingerprints below agree on.  Pairs of nodes are compared from
   the top; the differences among agreed bits are a lower bound, and above the limit the whole group of
   pairs is pruned, as are groups that are linked already.  A group whose free bits are within the limit
   is linked as a whole, without its pairs.  Pairs are expanded in slices of bounded size.
4. A bucket yields links to the smallest fingerprint it reaches, so links stay linear in the rows;
   components over all buckets come from alternating large-star and small-star joins.

The pipeline's stage takes its candidates from the same fingerprints and tree (:mod:`similar_texts`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import bounded_batches, materialise, release, shuffle_partitions, slices, table, text_or_empty

SEED = 42
SHINGLE = 3
MAX_BITS = 3
HOT_BUCKET = 20_000
FANOUT = 8
#: Pairs of nodes that are expanded at once (into ``FANOUT ** 2`` pairs each), and rows of small buckets taken together.
SLICE = 16_384
HELD = 50_000
#: Shingles that are hashed and counted together, and texts that are taken together up to it.
CHUNK = 200_000
BATCH_CHARS = 1_000_000

_LANES = np.uint64(0x0101010101010101)


def _mixed(hashes: np.ndarray, number: int) -> np.ndarray:
    """An independent 64-bit hash of each hash; number 0 is the hash itself."""
    if not number:
        return hashes
    v = hashes + np.uint64(number * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def _bit_counts(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in consecutive runs of *sizes* (1 or more) hashes: runs x 64."""
    # eight byte lanes are added at once, in pieces of at most 255 hashes, so that no lane overflows
    pieces = -(-sizes // 255)
    owner = np.repeat(np.arange(len(sizes)), pieces)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = (np.cumsum(sizes) - sizes)[owner] + 255 * inside
    first = np.cumsum(pieces) - pieces
    out = np.empty((len(sizes), 8, 8), np.int64)
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, begin)
        out[:, :, bit] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
    return out.reshape(-1, 64)


def _shingle_hashes(text: str | None, width: int, distinct: bool) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles, in parts of at most ``CHUNK``; nothing for a text without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return
    grams = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    total = max(1, len(words) - width + 1)
    hashes = map(xxhash.xxh64_intdigest, grams, repeat(SEED))
    if distinct:
        found = np.unique(np.fromiter(hashes, np.uint64, total))
        yield from (found[i : i + CHUNK] for i in range(0, len(found), CHUNK))
        return
    for done in range(0, total, CHUNK):
        yield np.fromiter(islice(hashes, CHUNK), np.uint64, min(CHUNK, total - done))


def fingerprints(texts: list[str | None], n: int = 1, width: int = SHINGLE, distinct: bool = False) -> np.ndarray:
    """*n* independent 64-bit SimHashes of the word shingles of each text (texts x n); 0 for a text without words.

    With *distinct* a shingle counts once however often a text has it.
    """
    counts, total = np.zeros((len(texts), n, 64), np.int64), np.zeros(len(texts), np.int64)
    parts: list[np.ndarray] = []
    rows: list[int] = []

    def add() -> None:
        sizes, owner, joined = np.fromiter(map(len, parts), np.int64, len(parts)), np.array(rows), np.concatenate(parts)
        np.add.at(total, owner, sizes)
        for i in range(n):
            np.add.at(counts, (owner, i), _bit_counts(_mixed(joined, i), sizes))
        parts.clear()
        rows.clear()

    held = 0
    for row, text in enumerate(texts):
        for part in _shingle_hashes(text, width, distinct):
            parts.append(part)
            rows.append(row)
            held += len(part)
            if held >= CHUNK:
                add()
                held = 0
    if parts:
        add()
    return np.packbits(2 * counts > total[:, None, None], axis=2, bitorder="little").view(np.uint64)[:, :, 0]


def fingerprint(text: str | None) -> int:
    return int(fingerprints([text])[0, 0])


def _fingerprints(batches: Iterator[pd.DataFrame], n: int, width: int, distinct: bool) -> Iterator[pd.DataFrame]:
    release()
    for batch in batches:
        texts = batch["text"].tolist()
        for start, end in slices([len(x) for x in texts], BATCH_CHARS):
            fps = fingerprints(texts[start:end], n, width, distinct).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[start:end].to_numpy(), "fps": list(fps), "digest": batch["digest"].iloc[start:end].to_numpy()})


def gray_rank(v: np.ndarray) -> np.ndarray:
    """The place of each code word in the reflected Gray sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        v = v ^ (v >> np.uint64(shift))
    return v


class _Forest:
    """Labels of fingerprints under the links seen so far; a label is the smallest place reached."""

    def __init__(self, n: int):
        self.label = np.arange(n, dtype=np.int32)
        self.links = 0

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.label[i], self.label[j]
            open_ = a != b
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            self.links += len(i)
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while True:
                shorter = self.label[self.label]
                if (shorter == self.label).all():
                    break
                self.label = shorter


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def link_runs(values: np.ndarray, run: np.ndarray, max_bits: int = MAX_BITS, wide: np.ndarray | None = None, max_wide: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (uint64) of sorted buckets *run* -> places of the linked ones, and of those that stand for their group.

    Two of a bucket are linked if they differ in at most *max_bits* bits and, where *wide* gives more
    fingerprints of each row, in at most *max_wide* bits of those.  The smallest value stands for a group.
    Memory is in proportion to the rows and to ``SLICE * FANOUT ** 2`` pairs.
    """
    order = np.lexsort((gray_rank(values), run))
    v, run = values[order], run[order]
    more = None if wide is None else wide[order]
    levels = [(v, v, None, None, run)]  # bits set in all, bits set in any, first child, end child, bucket
    while True:
        r = levels[-1][4]
        begins = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        if len(begins) == len(r):
            break
        place = np.arange(len(r)) - np.repeat(begins, np.diff(np.r_[begins, len(r)]))
        start = np.flatnonzero(place % FANOUT == 0).astype(np.int32)
        end = np.r_[start[1:], len(r)].astype(np.int32)
        levels.append((np.bitwise_and.reduceat(levels[-1][0], start), np.bitwise_or.reduceat(levels[-1][1], start), start, end, r[start]))
    first, last = [np.arange(len(v), dtype=np.int32)], [np.arange(1, len(v) + 1, dtype=np.int32)]
    for _, _, start, end, _ in levels[1:]:
        first.append(first[-1][start])
        last.append(last[-1][end - 1])
    forest, top = _Forest(len(v)), len(levels) - 1

    def leaves(i: np.ndarray, j: np.ndarray) -> None:
        for k in range(0, len(i), 4 * SLICE):
            a, b = i[k : k + 4 * SLICE], j[k : k + 4 * SLICE]
            near = forest.label[a] != forest.label[b]
            a, b = a[near], b[near]
            near = np.bitwise_count(v[a] ^ v[b]) <= max_bits
            a, b = a[near], b[near]
            for m in range(0, len(a) if more is not None else 0, SLICE):
                x, y = a[m : m + SLICE], b[m : m + SLICE]
                within = np.bitwise_count(more[x] ^ more[y]).sum(axis=1, dtype=np.int32) <= max_wide
                forest.link(x[within], y[within])
            if more is None:
                forest.link(a, b)

    if more is not None and len(v):  # Gray neighbours first: large groups are then linked before their pairs are taken
        for step in (1, 2, 3):
            i = np.flatnonzero(run[step:] == run[:-step]).astype(np.int32)
            leaves(i, i + np.int32(step))
    roots = np.arange(len(levels[top][0]), dtype=np.int32)
    stack = [(top, roots, roots)] if top else []
    seen, labels = -1, []
    while stack:
        level, a, b = stack.pop()
        if level == 0:
            leaves(a, b)
            continue
        if len(a) > SLICE:
            stack.append((level, a[SLICE:], b[SLICE:]))
            a, b = a[:SLICE], b[:SLICE]
        if seen != forest.links:  # the range of labels below each node
            seen, labels = forest.links, [(forest.label, forest.label)]
            for _, _, start, _, _ in levels[1:]:
                labels.append((np.minimum.reduceat(labels[-1][0], start), np.maximum.reduceat(labels[-1][1], start)))
        low, high = labels[level]
        apart = (low[a] != high[a]) | (low[b] != high[b]) | (low[a] != low[b])
        a, b = a[apart], b[apart]
        all_, any_ = levels[level][:2]
        near = np.bitwise_count((all_[a] & ~any_[b]) | (all_[b] & ~any_[a])) <= max_bits
        a, b = a[near], b[near]
        if more is None:
            whole = np.bitwise_count((any_[a] | any_[b]) & ~(all_[a] & all_[b])) <= max_bits
            x, y = a[whole], b[whole]
            forest.link(first[level][x], first[level][y])
            own = x[x == y]
            n = last[level][own] - first[level][own]
            head = np.repeat(first[level][own], n)
            forest.link(head, head + (np.arange(n.sum(), dtype=np.int32) - np.repeat(_starts(n), n)))
            a, b = a[~whole], b[~whole]
        _, _, start, end, _ = levels[level]
        span = end[b] - start[b]
        n = (end[a] - start[a]) * span
        k = np.arange(n.sum(), dtype=np.int32) - np.repeat(_starts(n).astype(np.int32), n)
        span, same = np.repeat(span, n), np.repeat(a == b, n)
        i, j = np.repeat(start[a], n) + k // span, np.repeat(start[b], n) + k % span
        once = ~same | ((i <= j) if level > 1 else (i < j))
        i, j = i[once], j[once]
        del k, span, same, once, n
        if len(i):
            stack.append((level - 1, i, j))
    # the smallest fingerprint of each local component stands for it
    by_value = np.lexsort((v.view(np.int64), forest.label))
    groups = forest.label[by_value]
    heads = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else np.zeros(0, np.int64)
    stands = np.empty(len(v), np.int64)
    stands[by_value] = np.repeat(by_value[heads], np.diff(np.r_[heads, len(groups)]))
    linked = np.flatnonzero(stands != np.arange(len(v)))
    return order[linked], order[stands[linked]]


def whole_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by ``bucket`` as frames of whole buckets, small ones together."""
    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size < HELD or batch["bucket"].iloc[-1] == held[0]["bucket"].iloc[0]:
            continue
        rows = pd.concat(held, ignore_index=True)
        done = int(rows["bucket"].searchsorted(rows["bucket"].iloc[-1]))
        if done:
            yield rows.iloc[:done]
        held = [rows.iloc[done:].copy()]
        size = len(held[0])
    if size:
        yield pd.concat(held, ignore_index=True)


def _links(batches: Iterator[pd.DataFrame], max_bits: int) -> Iterator[pd.DataFrame]:
    """Links ``a``, ``b`` of rows (``bucket``, ``node``, ``fp``) sorted by bucket."""
    release()
    for rows in whole_buckets(batches):
        i, j = link_runs(rows["fp"].to_numpy(np.int64).view(np.uint64), rows["bucket"].to_numpy(np.int64), max_bits)
        node = rows["node"].to_numpy(np.int64)
        yield pd.DataFrame({"a": node[i], "b": node[j]}).drop_duplicates()


def _parts(mask: int, n: int) -> list[int]:
    """*mask* with each of *n* parts, of equal size if possible, of the bits that it lacks."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [len(free) * k // n for k in range(n + 1)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _dealt(keyed: DataFrame, *carried: str) -> DataFrame:
    n = shuffle_partitions(keyed.sparkSession)
    return keyed.select("bucket", "node", *carried).repartition(n, "bucket").sortWithinPartitions("bucket")


def near_links(fps: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Distinct ``fp`` (long) -> links ``a``, ``b`` that connect all fingerprints within three bits."""
    open_, masks, kept = fps.select("fp", F.lit(0).cast("long").alias("mask")), [0], []
    while True:
        # the masks follow from the round alone: four in the first, four times as many in each further one
        children = {m: _parts(m, MAX_BITS + 1) for m in masks}
        masks = sorted({c for x in children.values() for c in x})
        steps = F.create_map(*[x for m, made in children.items() for x in (F.lit(_signed(m)).cast("long"), F.array(*[F.lit(_signed(c)).cast("long") for c in made]))])
        keyed = open_.select("fp", F.explode(F.element_at(steps, F.col("mask"))).alias("mask"))
        keyed = keyed.withColumn("bucket", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))))
        hot = materialise(keyed.groupBy("bucket").count().filter(F.col("count") > hot_bucket).select("bucket"), "simhash-hot-buckets")
        if hot.isEmpty():
            kept.append(keyed.select("fp", "bucket"))
            break
        kept.append(keyed.join(hot, "bucket", "left_anti").select("fp", "bucket"))
        open_ = materialise(keyed.join(hot, "bucket", "left_semi").select("fp", "mask"), "simhash-hot-rows")
    dealt = _dealt(reduce(DataFrame.unionByName, kept).withColumn("node", F.col("fp")), "fp")
    return dealt.mapInPandas(lambda b: _links(b, MAX_BITS), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """Undirected links ``a``, ``b`` -> ``node``, ``root`` (smallest node reachable), for linked nodes only.

    Alternating large-star and small-star steps; each round is a written table, and the rounds end
    when the set of edges no longer changes (logarithmic in the largest component in practice).
    """
    edges = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = mark(edges)
    while seen[0]:
        # the aggregates are written before each join, so that a hub's rows are in plain exchanges, which
        # adaptive execution splits
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "components-low")
        large = materialise(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "components-large")
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "components-low")
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = materialise(small.select("e.u", "e.v").filter("u <> v").distinct(), "components")
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _components_of(docs: DataFrame, n: int, width: int, distinct: bool, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``doc_id``, ``digest``, ``component_id`` of each row, with a single fingerprint ``fps``, under the links that *linked* gives of ``node``, ``fps``."""
    rows = bounded_batches(docs).select("doc_id", text_or_empty().alias("text"), F.xxhash64(text_or_empty()).alias("digest"))
    rows = rows.mapInPandas(lambda batches: _fingerprints(batches, n, width, distinct), "doc_id long, fps array<long>, digest long")
    # a node is a fingerprint, or where there are several the hash of all
    rows = materialise(rows.withColumn("node", F.get("fps", F.lit(0)) if n == 1 else F.xxhash64("fps")), "simhash-fingerprints")
    nodes = materialise(rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("fps").alias("fps")), "simhash-nodes")
    found = components(linked(nodes.select("node", "fps")))
    rooted = materialise(nodes.join(found, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root")), "simhash-rooted")
    # written, so that the join below has two plain exchanges, whose large partitions Spark can split
    ids = materialise(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-ids")
    named = materialise(rooted.join(ids, "root").select("node", "component_id"), "simhash-named")
    light = rows if n == 1 else rows.drop("fps")
    return light.join(named, "node").drop("node")


def simhash_components(docs: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """``doc_id``, ``fps`` (one long), ``digest`` of the text, ``component_id`` for each row of *docs*.

    Texts are linked if their fingerprints differ in at most three bits.  Null and empty texts, and texts
    of white space only, have fingerprint zero and are linked like any other.  Very long texts are hashed
    whole, in parts.  Ties of a bit (set in exactly half) give 0.  Repeated rows give repeated results.  A
    component without any non-null id has a null id.  Other columns are ignored; an empty table gives none.
    """
    return _components_of(docs, 1, SHINGLE, False, lambda nodes: near_links(nodes.select(F.col("node").alias("fp")), hot_bucket))


def op9_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.get("fps", F.lit(0))), 16, "0")).alias("fingerprint"), "component_id")
