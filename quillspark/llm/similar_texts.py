"""The pipeline's near copies: candidates by operator 9's fingerprints and tree, verified on shingle sets.

1. Each text gives its distinct five-word shingles and of them ``FINGERPRINTS`` independent 64-bit SimHashes.
   Texts with equal sets are one node.
2. A band is a drawn choice of bits of one fingerprint, and nodes that agree in a band share a bucket.  A
   band's width follows the number of nodes, so that a bucket has about ``CHANCE`` chance rows at any size,
   and the number of bands follows from the width: a pair at the limit agrees in none with a probability of
   ``MISS`` at most (:func:`bands`).
3. In a bucket the Gray-sorted tree of :mod:`simhash` links nodes by the bits of two fingerprints, three
   deviations above the mean of a pair at the limit.  What hangs together there is a group.  Its centre is
   the smallest of the nodes near the majority of its bits, so that the many groups that the copies of a text
   form in different bands have few centres between them; groups of the same centre are one.
4. Every node of a group is paired with the centre.  Pairs four deviations above the mean over all
   fingerprints go, the others are verified on the sets of 64-bit shingle hashes.
5. Groups that hold several components then are gone through once more, with their sets: each node outside
   the group's largest component is counted against an index of the others' shingles.  A link merges two
   components at once, so links stay linear; large groups are cut into parts (as in :mod:`setsketch`).

So a link is always one between sets of at least the similarity, and each verified pair counts even if the
pairs around it fail.  Sets are made again from the texts, for nodes of groups only.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log2

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import bounded_batches, drop_rows, materialise, release, slices, text_or_empty
from quillspark.llm.setsketch import PART_SHINGLES, _open_rows
from quillspark.llm.simhash import BATCH_CHARS, HOT_BUCKET, _bit_counts, _dealt, _mixed, _shingle_hashes, _signed, components, link_runs, whole_buckets

SHINGLE, PERCENT, FINGERPRINTS = 5, 80, 12
#: Chance rows of a bucket (two to this power), least width of a band, and the share of pairs at the limit that no band catches.
CHANCE, LEAST_WIDTH, MISS = 6, 16, 0.01
#: Bits by which a centre may be farther from the majority of its group's 128 bits than the nearest node.
SLACK = 6
SEED = 42


def differing_share(percent: int) -> float:
    """The share of differing fingerprint bits of two sets of equal size with this Jaccard similarity, the largest of any sizes."""
    return float(np.arccos(2 * percent / (100 + percent)) / np.pi)


def most_bits(bits: int, share: float, deviations: float) -> int:
    return int(bits * share + deviations * np.sqrt(bits * share * (1 - share)))


def missed(width: int, each: int, n: int, share: float) -> float:
    """The probability that a pair agrees in none of *each* drawn bands of *width* bits of *n* fingerprints."""
    d = range(65)
    agree = np.array([comb(64 - k, width) / comb(64, width) for k in d])
    chance = np.array([comb(64, k) * share**k * (1 - share) ** (64 - k) for k in d])
    return float((chance * (1 - agree) ** each).sum() ** n)


def bands(nodes: int, n: int = FINGERPRINTS, percent: int = PERCENT) -> list[tuple[int, int]]:
    """(fingerprint, mask) of each band for so many nodes."""
    width = max(LEAST_WIDTH, ceil(log2(max(1, nodes))) - CHANCE)
    share, each = differing_share(percent), 1
    while missed(width, each, n, share) > MISS:
        each += 1
    drawn = np.random.default_rng(SEED)
    return [(i, sum(1 << int(b) for b in drawn.permutation(64)[:width])) for i in range(n) for _ in range(each)]


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's five-word shingles (fewer words: of the whole sequence; none: empty)."""
    return np.concatenate([np.empty(0, np.uint64), *_shingle_hashes(text, SHINGLE, True)])


def _node(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def set_fingerprints(sets: list[np.ndarray], n: int) -> np.ndarray:
    """*n* SimHashes of each set (sets x n); 0 for an empty one."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    out, some = np.zeros((len(sets), n), np.uint64), np.flatnonzero(sizes)
    if len(some):
        joined = np.concatenate(sets)
        for i in range(n):
            ones = 2 * _bit_counts(_mixed(joined, i), sizes[some]) > sizes[some, None]
            out[some, i] = np.packbits(ones, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _sketches(batches: Iterator[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    release()
    for batch in batches:
        texts = batch["text"].tolist()
        for start, end in slices([len(x) for x in texts], BATCH_CHARS):
            sets = [shingle_set(t) for t in texts[start:end]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].iloc[start:end].to_numpy(), "digest": batch["digest"].iloc[start:end].to_numpy(),
                "n_shingles": [len(s) for s in sets], "node": [_node(s) for s in sets], "fps": list(set_fingerprints(sets, n).view(np.int64)),
            })


def _groups(batches: Iterator[pd.DataFrame], max_bits: int, max_wide: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by bucket (``node``, ``fp``, ``next_fp``) -> ``centre``, ``node`` of what hangs together in a bucket."""
    release()
    for rows in whole_buckets(batches):
        wide = rows[["fp", "next_fp"]].to_numpy(np.int64).view(np.uint64)
        member, head = link_runs(np.ascontiguousarray(wide[:, 0]), rows["bucket"].to_numpy(np.int64), max_bits, wide, max_wide)
        heads = np.unique(head)
        found = pd.DataFrame({"group": np.r_[head, heads], "place": np.r_[member, heads]})
        found = found.assign(node=rows["node"].to_numpy(object)[found["place"]]).sort_values(["group", "node"], ignore_index=True)
        if not len(found):
            continue
        begins = np.flatnonzero(np.r_[True, np.diff(found["group"]) != 0])
        sizes = np.diff(np.r_[begins, len(found)])
        bits = np.unpackbits(np.ascontiguousarray(wide[found["place"]]).view(np.uint8), axis=1)
        most = 2 * np.add.reduceat(bits, begins, axis=0, dtype=np.int32) > sizes[:, None]
        far = (bits != np.repeat(most, sizes, axis=0)).sum(axis=1)
        near = np.flatnonzero(far <= np.repeat(np.minimum.reduceat(far, begins), sizes) + SLACK)
        # nodes of a group are in order, so the first near one is the smallest
        centre = np.repeat(near[np.searchsorted(near, begins)], sizes)
        other = np.flatnonzero(centre != np.arange(len(found)))
        nodes = found["node"].to_numpy(object)
        yield pd.DataFrame({"centre": nodes[centre[other]], "node": nodes[other]}).drop_duplicates()


def candidate_groups(nodes: DataFrame, count: int, n: int = FINGERPRINTS, percent: int = PERCENT, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """*count* distinct ``node``, ``fps`` (*n* longs) -> distinct ``centre``, ``node``: groups of nodes that may be similar, each with a row for every node but its centre.

    A bucket above *hot_bucket* rows is cut into parts, and each pair of parts is compared in a bucket of
    its own, so none is left out and no task holds more than two.  Which buckets may be hot is found on every
    hundredth or so of the nodes, a bound far below the limit; those alone are counted on all rows.
    """
    made = bands(count, n, percent)
    share, width = differing_share(percent), made[0][1].bit_count()
    max_bits, max_wide = most_bits(64 - width, share, 3), most_bits(128 - width, share, 3)
    fp = [F.get("fps", F.lit(i)) for i in range(n)]
    band = [F.struct(fp[i].alias("fp"), fp[(i + 1) % n].alias("next_fp"), F.xxhash64(F.lit(k), fp[i].bitwiseAND(F.lit(_signed(mask)).cast("long"))).alias("bucket")) for k, (i, mask) in enumerate(made)]
    keyed = nodes.select("node", F.explode(F.array(*band)).alias("b")).select("node", "b.*")
    rate = max(1, hot_bucket // 100)
    drawn = keyed.filter(F.pmod(F.xxhash64(F.lit(SEED), "node"), F.lit(rate)) == 0) if rate > 1 else keyed
    often = materialise(drawn.groupBy("bucket").count().filter(F.col("count") * rate * 2 > hot_bucket).select("bucket"), "similar-often")
    if not often.isEmpty():
        hot = keyed.join(often, "bucket", "left_semi").groupBy("bucket").count().filter(F.col("count") > hot_bucket)
        hot = materialise(hot.select("bucket", F.ceil(F.col("count") / F.lit(hot_bucket)).cast("int").alias("parts")), "similar-hot")
        part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
        split = keyed.join(hot, "bucket").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        split = split.select("node", "fp", "next_fp", F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other")).alias("bucket"))
        keyed = keyed.join(hot, "bucket", "left_anti").select("node", "fp", "next_fp", "bucket").unionByName(split)
    return _dealt(keyed, "fp", "next_fp").mapInPandas(lambda b: _groups(b, max_bits, max_wide), "centre binary, node binary").distinct()


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    release()
    for batch in batches:
        sets = [shingle_set(t) for t in batch["text"]]
        same = [_node(s) == node for s, node in zip(sets, batch["node"])]
        yield pd.DataFrame({"node": [n for n, y in zip(batch["node"], same) if y], "hashes": [s.tobytes() for s, y in zip(sets, same) if y]})


def similar(both, size_a, size_b, percent: int):
    """Whether sets of these sizes with *both* elements in common have at least this similarity."""
    return both * (100 + percent) >= percent * (size_a + size_b)


def _verified(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    release()
    for batch in batches:
        keep = []
        for a, b in zip(batch["hashes_a"], batch["hashes_b"]):
            merged = np.sort(np.frombuffer(a + b, np.uint64))
            keep.append(bool(similar(np.count_nonzero(merged[1:] == merged[:-1]), len(a) // 8, len(b) // 8, percent)))
        yield batch.loc[keep, ["a", "b"]]


class _Residents:
    """The nodes that live in a part of a group, their components, and an index from shingle hashes to nodes."""

    def __init__(self, rows: pd.DataFrame, percent: int) -> None:
        self.percent, self.nodes, self.sizes = percent, rows["node"].to_numpy(object), rows["n_shingles"].to_numpy()
        self.numbers: dict[bytes, int] = {}
        self.roots = np.array([self.numbers.setdefault(r, len(self.numbers)) for r in rows["root"]])
        hashes = np.frombuffer(b"".join(rows["hashes"]), np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owners = hashes[order], np.repeat(np.arange(len(rows), dtype=np.int32), self.sizes)[order]

    def shared(self, mine: np.ndarray) -> np.ndarray:
        """How many of the hashes *mine* each resident has."""
        begin, end = (np.searchsorted(self.hashes, mine, side) for side in ("left", "right"))
        runs = end - begin
        place = np.arange(runs.sum()) + np.repeat(begin - np.cumsum(runs) + runs, runs)
        return np.bincount(self.owners[place], minlength=len(self.nodes))

    def links(self, guests: pd.DataFrame) -> Iterator[tuple[bytes, bytes]]:
        """One link from each of *guests* outside the largest component to each other component with a similar resident."""
        for g in guests[~guests["largest"]].itertuples(index=False):
            number = self.numbers.setdefault(g.root, len(self.numbers))
            near = np.flatnonzero(similar(self.shared(np.frombuffer(g.hashes, np.uint64)), g.n_shingles, self.sizes, self.percent) & (self.roots != number))
            while len(near):
                yield g.node, self.nodes[near[0]]
                gone = self.roots[near[0]]
                self.roots[self.roots == gone] = number
                self.numbers = {r: number if x == gone else x for r, x in self.numbers.items()}
                near = near[self.roots[near] != number]


def _open_links(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Links across components, of rows sorted by group and part, residents before visitors."""
    release()
    key, waiting, home = None, [], None

    def settle() -> Iterator[tuple[bytes, bytes]]:
        nonlocal home
        if home is None and waiting:
            rows = pd.concat(waiting, ignore_index=True)
            home = _Residents(rows, percent)
            yield from home.links(rows)

    for batch in batches:
        found: list[tuple[bytes, bytes]] = []
        for (bucket, part, visits), rows in batch.groupby(["bucket", "part", "visits"], sort=True):
            if key != (bucket, part):
                found.extend(settle())
                key, waiting, home = (bucket, part), [], None
            if not visits:
                waiting.append(rows)
                continue
            found.extend(settle())
            if home is not None:
                found.extend(home.links(rows))
        yield pd.DataFrame(found, columns=["a", "b"])
    yield pd.DataFrame(list(settle()), columns=["a", "b"])


def verified_roots(groups: DataFrame, nodes: DataFrame, texts: DataFrame, n: int = FINGERPRINTS, percent: int = PERCENT, part_shingles: int = PART_SHINGLES) -> DataFrame:
    """``node``, ``root`` of all nodes linked inside *groups*; *nodes* has ``node``, ``n_shingles``, ``digest``, ``fps`` (*n* longs), *texts* ``digest``, ``text``."""
    pair = [F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")]
    every = groups.select(F.explode(F.array("centre", "node")).alias("node")).distinct()
    some = materialise(nodes.join(every, "node", "left_semi"), "similar-some")
    star = groups.select(*pair).distinct()
    left, right = (some.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("fps").alias(f"fps_{x}")) for x in "ab")
    differing = F.aggregate(F.zip_with("fps_a", "fps_b", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, x: total + x)
    fits = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (differing <= most_bits(64 * n, differing_share(percent), 4))
    pairs = materialise(star.join(left, "a").join(right, "b").filter(fits).select("a", "b"), "similar-likely")

    # sets are made for pairs that the bits don't rule out, and for groups in which a star leaves pairs open
    sizes = materialise(groups.groupBy("centre").count().filter("count > 1").select("centre"), "similar-larger")
    larger = groups.join(sizes, "centre", "left_semi").select(F.xxhash64("centre").alias("bucket"), "node")
    larger = materialise(larger.unionByName(sizes.select(F.xxhash64("centre").alias("bucket"), F.col("centre").alias("node"))), "similar-open-groups")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(larger.select("node")).distinct()
    needed = some.join(wanted, "node", "left_semi").select("node", F.col("digest").alias("node_digest"))
    sets = texts.join(needed, F.col("digest") == F.col("node_digest")).select("node", "text")
    sets = materialise(sets.mapInPandas(_sets, "node binary, hashes binary").groupBy("node").agg(F.first("hashes").alias("hashes")), "similar-sets")
    left, right = (sets.select(F.col("node").alias(x), F.col("hashes").alias(f"hashes_{x}")) for x in "ab")
    linked = materialise(pairs.join(left, "a").join(right, "b").mapInPandas(lambda b: _verified(b, percent), "a binary, b binary"), "similar-links")

    roots = components(linked)
    open_ = _open_rows(larger, some, roots, part_shingles)
    # a set tells its own size, so that the many rows of open groups are joined once
    dealt = open_.join(sets, "node").withColumn("n_shingles", F.expr("octet_length(hashes) div 8"))
    dealt = dealt.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "visits")
    more = materialise(dealt.mapInPandas(lambda b: _open_links(b, percent), "a binary, b binary").distinct(), "similar-links")
    return roots if more.isEmpty() else components(linked.unionByName(more))


def similar_components(docs: DataFrame, n: int = FINGERPRINTS, percent: int = PERCENT, hot_bucket: int = HOT_BUCKET, part_shingles: int = PART_SHINGLES) -> DataFrame:
    """``doc_id``, ``digest`` of the text, ``component_id`` for each row of *docs* (``doc_id``, ``text``).

    Texts are linked if their sets of five-word shingles have at least *percent* percent of their union in
    common and they are candidates.  Null and empty texts, and those of white space only, have the same empty
    set and are one component, linked with nothing else.  Texts with fewer words are one shingle.  Very long
    texts are taken whole.  Repeated rows give repeated results; a component without any non-null id has a
    null id.  Other columns are ignored; an empty table gives none.
    """
    texts = bounded_batches(docs).select("doc_id", text_or_empty().alias("text"), F.xxhash64(text_or_empty()).alias("digest"))
    rows = materialise(texts.mapInPandas(lambda b: _sketches(b, n), "doc_id long, digest long, n_shingles long, node binary, fps array<long>"), "similar-rows")
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n_shingles"), F.min("digest").alias("digest"), F.first("fps").alias("fps"))
    nodes = materialise(nodes, "similar-nodes")
    filled = nodes.filter("n_shingles > 0")
    groups = materialise(candidate_groups(filled.select("node", "fps"), filled.count(), n, percent, hot_bucket), "similar-groups")
    roots = verified_roots(groups, filled.drop("first_id"), texts.select("digest", "text"), n, percent, part_shingles)
    # written, so that the joins have plain exchanges on both sides, whose large partitions Spark can split
    rooted = materialise(nodes.select("node", "first_id").join(roots, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root")), "similar-roots")
    ids = materialise(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "similar-ids")
    named = materialise(rooted.join(ids, "root").select("node", "component_id"), "similar-named")
    return rows.select("node", "doc_id", "digest").join(named, "node").select("doc_id", "digest", "component_id")


def near_deduplicated(docs: DataFrame, n: int = FINGERPRINTS, percent: int = PERCENT) -> DataFrame:
    """One row of each component of :func:`similar_components`, with all columns of *docs*: that with the smallest id.

    Of several rows with that id the one of the smallest text digest stays, and one of identical rows; a
    null id comes after any other.  Null and empty texts are one component.  An empty table gives none.
    """
    rows = materialise(similar_components(docs, n, percent), "similar-stage")
    best = rows.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "digest")).alias("best"))
    best = materialise(best.select(F.col("component_id").alias("_c"), F.col("best.doc_id").alias("_best_id"), F.col("best.digest").alias("_best_digest")), "similar-best")
    stays = rows["doc_id"].eqNullSafe(best["_best_id"]) & (rows["digest"] == best["_best_digest"])
    judged = materialise(rows.join(best, rows["component_id"].eqNullSafe(best["_c"])).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), stays.alias("_stays")), "similar-judged")
    counted = judged.groupBy("_id", "_digest").agg(F.max("_stays").alias("_stays"), F.count("*").alias("_n"))
    doomed = counted.filter(~F.col("_stays") | (F.col("_n") > 1)).select("_id", "_digest", F.col("_stays").alias("_repeat"))
    return drop_rows(docs, materialise(doomed, "similar-doomed"), F.xxhash64(text_or_empty()))
