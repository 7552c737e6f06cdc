"""Near-dedup on shingle sets with SetSketch registers.

1. Each text gives its distinct shingles, and of them 180 registers: the least of exponentially distributed
   hash values, on a logarithmic scale of base 1.001, truncated to 16 bits.  Registers of parts of a text
   merge by the least value, so long texts are sketched in parts.  Texts with equal sets are one node.
2. Five registers are a band, 36 bands a sketch; nodes that agree in a band share a bucket.  A pair of
   similarity 0.8 misses all bands with probability 6e-7, one of 0.85 with 2e-10.
3. Every node of a bucket is paired with the bucket's node that shares most with others (a group's original
   rather than one of its copies), so pairs stay linear in the rows.  The similarity of a pair is estimated
   from the numbers of registers above, below and equal, jointly with the sets' known sizes; the likelihood
   has its maximum at a root of a quadratic equation, as the scale's base is near 1.  Pairs five deviations
   below the limit go; the others are verified on the sets of 64-bit shingle hashes.
4. Buckets whose nodes are in different components then are not finished: their nodes come together once
   more, with their sets.  Each node outside the bucket's largest component is compared by registers with the
   nodes of other components there, and the likely ones are verified in the task, by counting shared hashes
   in an index of the bucket.  A link merges two components at once, so that a bucket yields no more links
   than it has nodes.  A large bucket is cut into parts; a node visits all parts unless it is in the largest
   component, whose own nodes needn't be compared with each other.

Sets are made again from the texts for nodes in shared buckets only, which costs less than storing all.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import bounded_batches, materialise, release, slices, table, text_or_empty
from quillspark.llm.simhash import components

SHINGLE, PERCENT = 4, 80
BASE, RATE, TOP = 1.001, 20.0, 2**16 - 1
BANDS, BAND = 36, 5
REGISTERS = BANDS * BAND
#: Deviations of the estimate below the limit at which a pair is given up.
DEVIATIONS = 5.0
#: Shingles that live in a part of a bucket.
PART_SHINGLES = 1 << 20
BATCH_CHARS, CHUNK, SEED = 1_000_000, 1 << 15, 42
_FACTORS = np.random.default_rng(SEED).integers(1, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's four-word shingles (fewer words: of the whole sequence; none: empty)."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, max(1, len(words) - SHINGLE + 1)))


def minima(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The least of each register's hash values over consecutive runs of *sizes* (1 or more) hashes: runs x registers."""
    ends = np.cumsum(sizes)
    out = np.full((len(sizes), REGISTERS), np.iinfo(np.uint64).max, np.uint64)
    for begin in range(0, len(hashes), CHUNK):
        part = hashes[begin : begin + CHUNK]
        first, last = np.searchsorted(ends, [begin, begin + len(part) - 1], side="right")
        starts = np.maximum((ends - sizes)[first : last + 1] - begin, 0)
        y, z = np.empty_like(part), np.empty_like(part)
        for i in range(REGISTERS):
            np.multiply(part, _FACTORS[i], out=y)
            np.right_shift(y, np.uint64(32), out=z)
            np.bitwise_xor(y, z, out=y)
            np.multiply(y, _MIX, out=y)
            column = out[first : last + 1, i]
            np.minimum(column, np.minimum.reduceat(y, starts), out=column)
    return out


def registers(least: np.ndarray) -> np.ndarray:
    """Minima of uniform hash values as register values: those of exponential ones on the logarithmic scale."""
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, TOP).astype("<u2")


def joint_estimate(above: np.ndarray, below: np.ndarray, equal: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """The likeliest similarity of sets of these sizes, given how many registers of the first are above, below or equal.

    With shares u and v of the summed sizes and similarity J the three have probabilities u - vJ, v - uJ and J
    (the rest), up to terms of the order of the base less 1; the derivative's root is that of a quadratic.
    """
    u, v = size_a / (size_a + size_b), size_b / (size_a + size_b)
    square = u * v * (above + below + equal)
    linear = equal * (u * u + v * v) + v * v * above + u * u * below
    root = (linear - np.sqrt(np.maximum(linear * linear - 4 * square * equal * u * v, 0))) / (2 * square)
    return np.minimum(root, np.minimum(u / v, v / u))


def likely(ra: np.ndarray, rb: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether pairs of sketches (rows of *ra* and *rb*) may be similar, and their estimated similarity."""
    limit = PERCENT / 100
    least = limit - DEVIATIONS * np.sqrt(limit * (1 - limit) / REGISTERS)
    equal, above = (ra == rb).sum(1), (ra > rb).sum(1)
    found = joint_estimate(above, REGISTERS - above - equal, equal, size_a.astype(float), size_b.astype(float))
    fits = 100 * np.minimum(size_a, size_b) >= PERCENT * np.maximum(size_a, size_b)
    return fits & (found >= least), found


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    release()
    for batch in batches:
        texts = batch["text"].tolist()
        for start, end in slices([len(x) for x in texts], BATCH_CHARS):
            sets = [shingle_set(t) for t in texts[start:end]]
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            rows = iter(registers(minima(np.concatenate([s for s in sets if len(s)]), sizes[sizes > 0]))) if sizes.any() else iter(())
            regs = [next(rows).tobytes() if n else None for n in sizes]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].iloc[start:end].to_numpy(), "digest": batch["digest"].iloc[start:end].to_numpy(), "n_shingles": sizes,
                "node": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], "regs": regs,
            })


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    release()
    for batch in batches:
        sets = [shingle_set(t).tobytes() for t in batch["text"]]
        same = [xxhash.xxh3_128_digest(s) == node for s, node in zip(sets, batch["node"])]
        yield pd.DataFrame({"node": [n for n, y in zip(batch["node"], same) if y], "hashes": [s for s, y in zip(sets, same) if y]})


def _stack(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u2").reshape(-1, REGISTERS)


def _likely_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    release()
    for batch in batches:
        if len(batch):
            keep, _ = likely(_stack(batch["regs_a"]), _stack(batch["regs_b"]), batch["n_a"].to_numpy(), batch["n_b"].to_numpy())
            yield batch.loc[keep, ["a", "b"]]


def _similar(both: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    return both * (100 + PERCENT) >= PERCENT * (size_a + size_b)


def _verified_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    release()
    for batch in batches:
        keep = []
        for a, b in zip(batch["hashes_a"], batch["hashes_b"]):
            merged = np.sort(np.concatenate([np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)]))
            keep.append(bool(_similar(np.count_nonzero(merged[1:] == merged[:-1]), len(a) // 8, len(b) // 8)))
        yield batch.loc[keep, ["a", "b"]]


class _Home:
    """The nodes that live in a part of a bucket, with an index from hashes to nodes."""

    def __init__(self) -> None:
        self.frames: list[pd.DataFrame] = []
        self.regs: np.ndarray | None = None

    def close(self) -> None:
        if self.regs is None:
            rows = pd.concat(self.frames, ignore_index=True)
            self.regs, self.sizes, self.nodes = _stack(rows["regs"]), rows["n_shingles"].to_numpy(), rows["node"].to_numpy(object)
            self.numbers: dict[bytes, int] = {}
            self.roots = np.array([self.numbers.setdefault(r, len(self.numbers)) for r in rows["root"]])
            hashes = np.frombuffer(b"".join(rows["hashes"]), np.uint64)
            order = np.argsort(hashes, kind="stable")
            self.hashes, self.owners = hashes[order], np.repeat(np.arange(len(rows), dtype=np.int32), self.sizes)[order]

    def shared(self, mine: np.ndarray) -> np.ndarray:
        """How many of the hashes *mine* each node has."""
        begin, end = (np.searchsorted(self.hashes, mine, side) for side in ("left", "right"))
        some = end > begin
        runs = end[some] - begin[some]
        place = np.arange(runs.sum()) + np.repeat(begin[some] - np.cumsum(runs) + runs, runs)
        return np.bincount(self.owners[place], minlength=len(self.nodes))

    def links(self, guests: pd.DataFrame) -> Iterator[tuple[bytes, bytes]]:
        """A link from each of *guests* outside the bucket's largest component to each other component that has one; components merge as they are linked."""
        for g in guests[~guests["largest"]].itertuples(index=False):
            number = self.numbers.setdefault(g.root, len(self.numbers))
            other = np.flatnonzero(self.roots != number)
            mine = np.frombuffer(g.regs, "<u2")
            near = other[(self.regs[other] == mine).sum(1) * 2 > REGISTERS]
            if len(near):
                keep, _ = likely(np.broadcast_to(mine, (len(near), REGISTERS)), self.regs[near], np.full(len(near), g.n_shingles), self.sizes[near])
                near = near[keep]
            if len(near):
                near = near[_similar(self.shared(np.frombuffer(g.hashes, np.uint64))[near], g.n_shingles, self.sizes[near])]
            while len(near):
                yield g.node, self.nodes[near[0]]
                gone = self.roots[near[0]]
                self.roots[self.roots == gone] = number
                self.numbers = {r: number if n == gone else n for r, n in self.numbers.items()}
                near = near[self.roots[near] != number]


def _open_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links across components, of rows sorted by bucket and part, those at home before those that visit."""
    release()
    key, home, found = None, _Home(), []

    def finish() -> None:
        if home.frames:
            home.close()
            found.extend(home.links(pd.concat(home.frames)))

    for batch in batches:
        for (bucket, part, visits), rows in batch.groupby(["bucket", "part", "visits"], sort=True):
            if key != (bucket, part):
                finish()
                key, home = (bucket, part), _Home()
            if not visits:
                home.frames.append(rows)
            elif home.frames:
                home.close()
                found.extend(home.links(rows))
        yield pd.DataFrame(found, columns=["a", "b"])
        found.clear()
    finish()
    yield pd.DataFrame(found, columns=["a", "b"])


def _open_rows(shared: DataFrame, nodes: DataFrame, roots: DataFrame, part_shingles: int) -> DataFrame:
    """Rows of the buckets that hold several components, dealt to parts in which about *part_shingles* at most live."""
    labelled = nodes.select("node", "n_shingles").join(roots, "node", "left").select("node", "n_shingles", F.coalesce("root", "node").alias("root"))
    rows = materialise(shared.join(labelled, "node").select("bucket", "node", "n_shingles", "root"), "setsketch-rooted")
    kinds = rows.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum(F.col("n_shingles") + 64).alias("size"))
    kinds = kinds.groupBy("bucket").agg(F.sum("size").alias("size"), F.count("*").alias("kinds"), F.max(F.struct("n", "root")).alias("most")).filter("kinds > 1")
    kinds = materialise(kinds.select("bucket", F.ceil(F.col("size") / F.lit(part_shingles)).cast("int").alias("parts"), F.col("most.root").alias("largest_root")), "setsketch-open")
    home = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    open_ = rows.join(kinds, "bucket").withColumn("home", home).withColumn("largest", F.col("root") == F.col("largest_root"))
    open_ = open_.withColumn("part", F.explode(F.when(F.col("largest"), F.array("home")).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    return materialise(open_.select("bucket", "part", (F.col("part") != F.col("home")).alias("visits"), "node", "root", "largest"), "setsketch-dealt")


def links(nodes: DataFrame, texts: DataFrame, part_shingles: int = PART_SHINGLES) -> DataFrame:
    """``node``, ``root`` of all linked *nodes* (``node``, ``n_shingles``, ``regs``, ``digest`` of a text); *texts* has ``digest``, ``text``."""
    size = 2 * BAND
    band = F.explode(F.array(*[F.xxhash64(F.lit(i), F.substring("regs", size * i + 1, size)) for i in range(BANDS)]))
    banded = nodes.select("node", band.alias("bucket"))
    counts = materialise(banded.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "setsketch-counts")
    shared = materialise(banded.join(counts, "bucket"), "setsketch-shared")
    crowd = materialise(shared.groupBy("node").agg(F.sum("n").alias("crowd")), "setsketch-crowd")
    some = materialise(nodes.join(crowd, "node", "left_semi"), "setsketch-some")
    needed = some.select("node", F.col("digest").alias("node_digest"))
    sets = texts.join(needed, F.col("digest") == F.col("node_digest")).select("node", "text")
    sets = materialise(sets.mapInPandas(_sets, "node binary, hashes binary").groupBy("node").agg(F.first("hashes").alias("hashes")), "setsketch-sets")

    centres = shared.join(crowd, "node").groupBy("bucket").agg(F.max(F.struct("crowd", "node")).alias("most"))
    centres = materialise(centres.select("bucket", F.col("most.node").alias("centre")), "setsketch-centres")
    star = shared.join(centres, "bucket").filter("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    star = materialise(star, "setsketch-stars")
    left, right = (some.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}")) for x in "ab")
    pairs = materialise(star.join(left, "a").join(right, "b").mapInPandas(_likely_pairs, "a binary, b binary"), "setsketch-likely")
    left, right = (sets.select(F.col("node").alias(x), F.col("hashes").alias(f"hashes_{x}")) for x in "ab")
    linked = materialise(pairs.join(left, "a").join(right, "b").mapInPandas(_verified_pairs, "a binary, b binary"), "setsketch-links")

    roots = components(linked)
    open_ = _open_rows(shared.select("bucket", "node"), some, roots, part_shingles)
    dealt = open_.join(some.select("node", "n_shingles", "regs"), "node").join(sets, "node")
    dealt = dealt.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "visits")
    more = materialise(dealt.mapInPandas(_open_links, "a binary, b binary").distinct(), "setsketch-links")
    return roots if more.isEmpty() else components(linked.unionByName(more))


def near_duplicates(docs: DataFrame, part_shingles: int = PART_SHINGLES) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` for each row of *docs* (``doc_id``, ``text``).

    Texts are linked if the intersection of their sets of four-word shingles is at least 80 percent of the
    union.  Null and empty texts, and texts of white space, have empty sets, are linked with nothing and are
    components by themselves.  Repeated rows give repeated results; a component's id is its smallest, null
    only if it has no other, and ``kept`` holds for every row with that id.  Very long texts are sketched
    and compared whole.  Other columns are ignored; an empty table gives none.
    """
    texts = bounded_batches(docs).select("doc_id", text_or_empty().alias("text"), F.xxhash64(text_or_empty()).alias("digest"))
    rows = materialise(texts.mapInPandas(_sketches, "doc_id long, digest long, n_shingles long, node binary, regs binary"), "setsketch-rows")
    some = rows.filter("n_shingles > 0")
    nodes = materialise(some.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n_shingles"), F.min("digest").alias("digest"), F.first("regs").alias("regs")), "setsketch-nodes")
    roots = links(nodes.drop("first_id"), texts.select("digest", "text"), part_shingles)
    # written, so that the joins have plain exchanges on both sides, whose large partitions Spark can split
    rooted = materialise(nodes.select("node", "first_id").join(roots, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root")), "setsketch-roots")
    ids = materialise(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "setsketch-ids")
    named = materialise(rooted.join(ids, "root").select("node", "component_id"), "setsketch-named")
    out = some.join(named, "node").select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op12_setsketch_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Intersections by joining on the shingles themselves, components by following links.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN [array_to_string(ws[i : i + 3], ' ') FOR i IN range(1, len(ws) - 2)] WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 180 * inter >= 80 * (x.n + y.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = w.doc_id
"""
