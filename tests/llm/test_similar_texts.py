import random
from collections import defaultdict

import pytest

from quillspark.llm.similar_texts import FINGERPRINTS, MISS, bands, differing_share, missed, near_deduplicated, set_fingerprints, shingle_set, similar_components
from quillspark.llm.simhash import fingerprints


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def similarity(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x or y else 1.0


def slow_components(texts):
    """The place of the first text that each is linked with, over all pairs whose sets are equal or share 80 percent of their union."""
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def edited(rng, words, edits, vocabulary):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(vocabulary)
    return words


def vocabulary_of(rng, n):
    return ["".join(rng.choices("abcdefghij", k=5)) for _ in range(n)]


def test_bands_follow_the_rows():
    width = lambda n: bands(n)[0][1].bit_count()
    assert [width(n) for n in (0, 1, 1000, 2**22, 2**22 + 1, 2**26)] == [16, 16, 16, 16, 17, 20]
    for nodes in (1, 2**24):
        made = bands(nodes)
        each = len(made) // FINGERPRINTS
        assert made == bands(nodes) and len(set(made)) == len(made)
        assert missed(width(nodes), each, FINGERPRINTS, differing_share(80)) <= MISS < missed(width(nodes), each - 1, FINGERPRINTS, differing_share(80))


def test_sets_and_their_fingerprints():
    texts = ["a b c d e f a b c d e", "", "x", "one two three four five six"]
    assert [len(shingle_set(t)) for t in [*texts, None]] == [len(shingles(t)) for t in [*texts, None]]
    assert set_fingerprints([shingle_set(t) for t in texts], 3).tolist() == fingerprints(texts, 3, 5, True).tolist()
    assert set_fingerprints([], 3).shape == (0, 3)


@pytest.mark.parametrize(("hot", "part"), [(20_000, 1 << 20), (30, 1000)])
def test_components_against_all_pairs(spark, hot, part):
    rng = random.Random(6)
    vocabulary, texts = vocabulary_of(rng, 3000), []
    for _ in range(25):
        words = rng.choices(vocabulary, k=300)
        # one or two edits are far above the limit and forty far below; those between are held by the test of recall
        texts += [" ".join(words)] + [" ".join(edited(rng, words, rng.choice([1, 2, 4, 40]), vocabulary)) for _ in range(4)]
    base = rng.choices(vocabulary, k=400)
    # a chain: each differs little from the one before, far ones not at all alike; a large group about one text
    for step in range(12):
        base = base[:step * 30] + rng.choices(vocabulary, k=20) + base[step * 30 + 20 :]
        texts.append(" ".join(base))
    centre = rng.choices(vocabulary, k=250)
    texts += [" ".join(edited(rng, centre, 3, vocabulary)) for _ in range(80)]
    want = slow_components(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar_components(docs, hot_bucket=hot, part_shingles=part).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_recall_by_band_and_no_pair_below(spark):
    rng = random.Random(11)
    vocabulary, rows, found = vocabulary_of(rng, 4000), [], {}
    for i in range(900):
        words = rng.choices(vocabulary, k=200)
        other = edited(rng, words, rng.choice([1, 2, 2, 3, 3, 4, 4, 4, 5, 5, 6, 8]), vocabulary)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        found[i] = similarity(rows[-2][1], rows[-1][1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar_components(docs).collect()}
    bands_ = defaultdict(list)
    for i, j in found.items():
        bands_[min(int(j * 20 + 1e-9), 19) / 20].append(got[2 * i] == got[2 * i + 1])
    assert len(bands_[0.8]) > 80 and len(bands_[0.75]) > 80
    for low, linked in bands_.items():
        assert (sum(linked) / len(linked) >= 0.97) if low >= 0.8 else not any(linked), low
    assert len({got[2 * i] for i in range(900)}) == 900


def test_a_tie_counts(spark):
    # nine shingles of which eight are common: 8 of 10; eight of which seven are common: 7 of 9
    words = [f"w{i}" for i in range(40)]
    pairs = [(words[:13], words[:12] + ["x"]), (words[20:32], words[20:31] + ["y"])]
    texts = [" ".join(t) for pair in pairs for t in pair]
    assert [similarity(texts[0], texts[1]), similarity(texts[2], texts[3])] == [0.8, 7 / 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in similar_components(docs).collect()) == [(0, 0), (1, 0), (2, 2), (3, 3)]


def test_odd_rows(spark):
    rng = random.Random(2)
    vocabulary = vocabulary_of(rng, 500)
    long = " ".join(rng.choices(vocabulary, k=150_000))
    one = " ".join(rng.choices(vocabulary, k=100))
    rows = [(1, None), (2, ""), (3, " \t "), (None, None), (10, one), (11, one.upper()), (11, one.upper()), (None, one + " more"), (20, long), (21, long + " end"), (30, "few words"), (31, "Few  words"), (None, "alone in the world of this test"), (40, "few word")]
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, node string, bucket int")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.component_id) for r in similar_components(docs).collect()), key=str)
    want = {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 20: 20, 21: 20, 30: 30, 31: 30, 40: 40}
    named = [(False, i, want[i]) for i, _ in rows if i is not None]
    assert got == sorted([*named, (True, 0, 1), (True, 0, 10), (True, 0, None)], key=str)
    left = near_deduplicated(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == [(False, 1), (False, 10), (False, 20), (False, 30), (False, 40), (True, 0)]
    assert similar_components(docs.limit(0)).count() == 0 and near_deduplicated(docs.limit(0)).count() == 0
