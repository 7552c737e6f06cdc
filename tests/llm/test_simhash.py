import random
import subprocess
import sys

import numpy as np
import pytest
import xxhash

from quillspark.llm.simhash import CHUNK, components, fingerprint, fingerprints, gray_rank, link_runs, near_links, simhash_components


def slow_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, bits=3):
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one two", "A b C", "a b c a b c", "Été à la plage\x0bencore une fois", "x " * 500])
def test_fingerprint(text):
    assert fingerprint(text) == slow_fingerprint(text)


def test_gray_rank():
    codes = np.arange(4096, dtype=np.uint64)
    assert (gray_rank(codes ^ (codes >> np.uint64(1))) == codes).all()


def clustered(seed, n, hubs=12):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(hubs)] + [0]
    out = []
    for _ in range(n):
        v = rng.choice(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5])):
            v ^= 1 << rng.randrange(64)
        out.append(v)
        if rng.random() < 0.2:
            base.append(v)
    return out + [rng.getrandbits(64) for _ in range(n // 4)]


@pytest.mark.parametrize("seed", range(4))
def test_index_in_one_bucket(seed):
    fps = sorted(set(clustered(seed, 300)))
    i, j = link_runs(np.array(fps, np.uint64), np.zeros(len(fps), np.int64))
    root = {fps[x]: fps[y] for x, y in zip(i, j)}
    want = slow_components(fps)
    groups = {}
    for f, w in zip(fps, want):
        groups.setdefault(w, set()).add(root.get(f, f))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def peak_of_a_large_bucket(n, flips):
    """Megabytes that a fresh process takes for one bucket of *n* fingerprints near one centre."""
    code = f"""
import numpy as np, resource
from quillspark.llm.simhash import link_runs
rng = np.random.default_rng(5)
masks = np.array([sum(1 << int(x) for x in rng.choice(48, {flips}, replace=False)) for _ in range({n})], np.uint64)
fps = np.unique(masks ^ np.uint64(0x1234567890ABCDEF))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
i, j = link_runs(fps, np.zeros(len(fps), np.int64))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    return float(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)


def test_memory_of_a_large_bucket():
    assert peak_of_a_large_bucket(50_000, 6) < 200


@pytest.mark.parametrize("hot", [50_000, 20])
def test_links_and_components_over_buckets(spark, hot):
    fps = sorted(set(clustered(9, 400)))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    root = dict(components(near_links(spark.createDataFrame([(s,) for s in signed], "fp long"), hot)).collect())
    want, groups = slow_components(fps), {}
    for s, w in zip(signed, want):
        groups.setdefault(w, set()).add(root.get(s, s))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_documents(spark):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(300)]
    rows = []
    for i in range(60):
        words = rng.choices(vocabulary, k=rng.choice([1, 2, 40, 400]))
        rows.append((i, " ".join(words)))
        if i % 3 == 0:
            words[len(words) // 2] = "changed"
            rows.append((100 + i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, "  "), (203, rows[0][1].upper()), (203, rows[0][1].upper()), (None, rows[1][1]), (None, "alone in the world")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.fps[0] % 2**64, r.component_id) for r in simhash_components(docs).collect()), key=str)
    fps = [slow_fingerprint(t) for _, t in rows]
    label = slow_components(fps)
    least = {}
    for (i, _), w in zip(rows, label):
        if i is not None:
            least[w] = min(i, least.get(w, i))
    assert got == sorted(((i is None, i or 0, f, least.get(w)) for (i, _), f, w in zip(rows, fps, label)), key=str)
    empty = spark.createDataFrame([], docs.schema)
    assert simhash_components(empty).count() == 0


def test_a_text_of_more_shingles_than_a_part():
    rng = random.Random(8)
    text = " ".join(rng.choices(["a", "b", "c", "d", "e"], k=2 * CHUNK + 77))
    several = ["x y", text, None, "one two three four"]
    got = fingerprints(several)[:, 0].tolist()
    assert got == [slow_fingerprint(x) for x in several]
    assert fingerprints(["a b c d"], 3)[0, 0] == fingerprint("a b c d") and len(set(fingerprints(["a b c d"], 3)[0].tolist())) == 3
