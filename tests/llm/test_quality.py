import math
import random
import zlib

import numpy as np
import pytest

from quillspark.llm.quality import QualityModel, features, good_rows, score_quality

DOCS, LABELS = "doc_id long, text string, score string", "doc_id long, quality int, toxic int, text string"


def corpus():
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(500):
        plain = " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 8))) for _ in range(rng.choice([20, 100]))).capitalize() + "."
        bad = rng.random() < 0.3
        kind = rng.randrange(3)
        text = plain if not bad else (plain.upper().replace(" ", "!! "), plain.replace(" ", " | "), (plain.split()[0] + " ") * 60)[kind]
        rows.append((i, text, "x"))
        if i % 2 == 0:
            labels.append((i, int(not bad), 0, "clash"))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    odd = [(1000, None, ""), (1001, "", ""), (None, rows[0][1], ""), (1002, rows[1][1] * 500, ""), (1002, rows[1][1] * 500, "")]
    docs, marks = spark.createDataFrame(rows + odd, DOCS), spark.createDataFrame(labels + [(None, 1, 0, ""), (5, None, None, "")], LABELS)
    got = {r.doc_id: r for r in score_quality(docs, marks).collect()}
    assert score_quality(docs, marks).count() == len(rows) + len(odd)
    held = [(got[i].predicted, q) for i, q, _, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(a == b for a, b in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    # labels of held-out rows are not read
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, t, x) for i, q, t, x in labels]
    again = {r.doc_id: r.score for r in score_quality(docs, spark.createDataFrame(flipped, LABELS)).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-9 for i in got)
    kept = good_rows(docs, marks)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got.values()) + got[1002].predicted


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a", ""), (2, None, "")], DOCS)
    assert {r.score for r in score_quality(docs, spark.createDataFrame([], LABELS)).collect()} == {1.0}
    assert score_quality(docs.limit(0), spark.createDataFrame([(1, 1, 0, "")], LABELS)).count() == 0


def test_features_of_odd_texts():
    assert np.isfinite(features(["", " ", "é", "a" * 100_000, "\x00\x7f"])).all()


def slow_features(text):
    """The features from their definition, a byte at a time."""
    kinds = {}
    for chars, kind in (("0123456789", 2), (" ", 3), ("\n", 4), (".", 5), (",", 6), ("!", 7), ("?", 8), ("|", 9), ("'\"`", 10), ("-_", 11), ("#$%&*+=^~@<>", 12), ("()[]{}/\\", 13), (":;", 14)):
        kinds.update(dict.fromkeys(map(ord, chars), kind))
    kinds.update(dict.fromkeys(range(65, 91), 1))
    raw = text.encode()
    of = [kinds.get(b, 15 if b < 32 or b == 127 else 0) for b in raw]
    out = [0.0] * 260
    for a, b in zip(of, of[1:]):
        out[16 * a + b] += 1
    out = [math.sqrt(x / (len(of) - 1)) if len(of) > 1 else 0.0 for x in out]
    words = raw.split()
    if words:
        n = len(words)
        out[256] = sum(a == b for a, b in zip(words, words[1:])) / n
        out[257] = min(len(set(words)), 2 * n**0.7) / n**0.7
        out[258] = math.log1p(len(raw) / n)
    out[259] = math.log1p(len(raw)) / 10
    return out


def test_features_are_their_definition():
    texts = ["", "a", "A b, c! 12\n\n\tx | y", "the the the cat " * 20, "é日本 (a) [b] {c} \x7f"]
    assert features(texts) == pytest.approx(np.array([slow_features(t) for t in texts]), abs=1e-5)


def pu_risk(w, p, u, prior):
    """Positive-unlabelled risk from its definition, its negative part held at zero or above."""
    loss = lambda z, y: np.mean(np.log1p(np.exp(-y * z)))
    return prior * loss(p @ w, 1) + max(0.0, loss(u @ w, -1) - prior * loss(p @ w, -1))


def test_risk_and_prior_on_known_mixtures():
    rng = np.random.default_rng(3)
    for prior in (0.3, 0.6):
        positive = lambda n: rng.normal(1.5, 1, (n, 3))
        negative = lambda n: rng.normal(-1.5, 1, (n, 3))
        p, u = positive(2000), np.concatenate([positive(int(3000 * prior)), negative(int(3000 * (1 - prior)))])
        rng.shuffle(u)
        model = QualityModel(p, u)
        assert abs(model.prior - prior) < 0.1
        x, y = model._standard(p), model._standard(u)
        found = pu_risk(model.weights, x, y, model.prior)
        assert found < pu_risk(np.zeros_like(model.weights), x, y, model.prior) / 2
        # no step along an axis is much better
        for k in range(len(model.weights)):
            for step in (-0.1, 0.1):
                moved = model.weights.copy()
                moved[k] += step
                assert pu_risk(moved, x, y, model.prior) > found - 0.01
        test = np.concatenate([positive(500), negative(500)])
        right = (model._standard(test) @ model.weights > 0) == np.r_[np.ones(500, bool), np.zeros(500, bool)]
        assert right.mean() > 0.95
