import random
from collections import defaultdict

import numpy as np
import pytest

from quillspark.llm.setsketch import BANDS, BAND, REGISTERS, joint_estimate, minima, near_duplicates, registers, shingle_set

SCHEMA = "doc_id long, text string, node string, regs int, component_id string"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_set(text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in (text or "").translate(FOLD)).split(" ") if w]
    if len(words) < 4:
        return frozenset([" ".join(words)] if words else [])
    return frozenset(" ".join(words[i : i + 4]) for i in range(len(words) - 3))


def slow_near(rows):
    sets = [slow_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    for i, s in enumerate(sets):
        both = defaultdict(int)
        for x in s:
            for j in where[x]:
                both[j] += j < i
        for j, n in both.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n) and n:
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        known = [x for x in ids[find(i)] if x is not None]
        c = d if not sets[i] else min(known) if known else None
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


def check(spark, rows, part_shingles=1 << 20, parts=None):
    docs = spark.createDataFrame([(*r, "clash", 1, "c") for r in rows], SCHEMA)
    got = near_duplicates(docs.repartition(parts) if parts else docs, part_shingles)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == slow_near(rows)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize("part_shingles", [1 << 20, 1000])
def test_groups_around_the_limit(spark, part_shingles):
    """Copies of copies, whose links are found only if a bucket's nodes are compared beyond its centre."""
    rng, rows = random.Random(part_shingles), []
    for g in range(6):
        base = [f"w{rng.randrange(5000)}" for _ in range(120 + 40 * g)]
        members = [base]
        for _ in range(30):
            members.append(edited(rng, rng.choice(members), rng.randint(1, 4 + g)))
        rows += [(1000 * g + rng.randrange(10**9), " ".join(m)) for m in members]
    rows += [(i, " ".join(f"u{rng.randrange(10**5)}" for _ in range(80))) for i in range(40)]
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(500 + i, f"{passage} " + " ".join(f"v{rng.randrange(10**5)}" for _ in range(40))) for i in range(60)]
    check(spark, rows, part_shingles)


def test_odd_rows(spark):
    words = " ".join(f"w{i}" for i in range(9))
    long = " ".join(f"l{i}" for i in range(60_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (None, None), (1, None), (4, "One two"), (5, "oNE\x0btwo"), (6, "one two three"), (7, "ÉCOLE a b c"), (8, "école a b c"), (9, words.upper()), (10, words), (10, words),
        (None, words), (None, "solo text of five words"), (None, "solo text of five words"), (11, long), (12, long + " end of it"), (13, "a b c d a b c d a b c d"), (14, "a b c d a b c d"), (15, "one two three four five"), (16, "one two three four five"),
    ]
    check(spark, rows)


def test_exact_limit(spark):
    """Sets of 9 and 10 shingles that share 8 of 10, or 9 and 7 of them."""
    a = [f"w{i}" for i in range(12)]
    check(spark, [(1, " ".join(a)), (2, " ".join(a[:11])), (3, " ".join(a[:10])), (4, " ".join(a[:9])), (5, " ".join(["z", *a[1:]]))])


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_same_rows_at_any_partitioning(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(edited(rng, base, rng.randint(0, 6)))) for i in range(80)] + [(200 + i, " ".join(base)) for i in range(50)]
    check(spark, rows, 2000, 64)


def test_registers_merge_and_collide_as_similarity_says():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**63, 100_000, dtype=np.uint64)
    whole = minima(hashes, np.array([len(hashes)]))
    parts = minima(hashes, np.array([10, 40_000, 59_990]))
    assert (parts.min(0) == whole[0]).all() and (registers(parts).max(0) == registers(whole)[0]).all()
    rates, found = [], []
    for _ in range(60):
        pool = rng.integers(0, 2**63, 600, dtype=np.uint64)
        a, b = pool[:500], pool[100:580]  # 400 of 580 shared
        ra, rb = registers(minima(np.concatenate([a, b]), np.array([500, 480])))
        equal, above = (ra == rb).sum(), (ra > rb).sum()
        rates.append(equal / REGISTERS)
        found.append(joint_estimate(above, REGISTERS - above - equal, equal, 500.0, 480.0))
    assert abs(np.mean(rates) - 400 / 580) < 0.015 and abs(np.mean(found) - 400 / 580) < 0.015 and np.std(found) < np.std(rates)
    assert (1 - 0.8**BAND) ** BANDS < 1e-6


def test_estimate_is_the_likeliest():
    rng = np.random.default_rng(2)
    for _ in range(50):
        u = rng.uniform(0.45, 0.55)
        v = 1 - u
        above, below = rng.integers(1, 40, 2)
        equal = REGISTERS - above - below
        grid = np.linspace(0.001, min(u / v, v / u) - 1e-6, 20_000)
        best = grid[np.argmax(above * np.log(u - v * grid) + below * np.log(v - u * grid) + equal * np.log(grid))]
        assert abs(joint_estimate(above, below, equal, u, v) - best) < 1e-3


def test_sets():
    assert len(shingle_set(None)) == len(shingle_set(" \n")) == 0
    assert (shingle_set("A b") == shingle_set("a  B")).all() and len(shingle_set("a b c d e a b c d e")) == 5
