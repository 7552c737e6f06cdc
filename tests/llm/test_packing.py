import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillspark.llm.packing import MAX_TOKENS, TOKENIZER, WordEncoder, chunks, packed, sequences, shortest_pack_first, slots

SCHEMA = "doc_id long, text string, length string, start string"


@pytest.mark.parametrize("seed", range(6))
def test_patterns_hold_every_piece_and_little_padding(seed):
    rng = random.Random(seed)
    size = rng.choice([16, 64, 4096])
    histogram = {}
    for _ in range(rng.choice([1, 30, 5000])):
        k = rng.choice([rng.randint(1, size), rng.randint(1, max(1, size // 10)), size, size // 2 + 1])
        histogram[k] = histogram.get(k, 0) + 1
    patterns = shortest_pack_first(histogram, size)
    placed = {}
    for packs, pattern in patterns:
        assert sum(k * n for k, n in pattern) <= size
        for k, n in pattern:
            placed[k] = placed.get(k, 0) + n * packs
    assert placed == histogram
    assert len(slots(patterns)) >= len(histogram)
    volume, packs = sum(k * n for k, n in histogram.items()), sum(p for p, _ in patterns)
    large = sum(n for k, n in histogram.items() if k > size // 2)
    assert packs <= max(large, -(-volume // size)) * 1.1 + 2


def test_ids_are_the_tokenizer_s():
    rng = random.Random(7)
    pool = "abcdeABC  \n\t 012.,!?'s't'LL-\u00e9\u00df\u00d1\u65e5\u0301\u00a0\u0130\u03a3 \x1c\U0001f600"
    texts = ["".join(rng.choices(pool, k=rng.choice([0, 1, 5, 40, 400]))) for _ in range(1500)] + ["<|endoftext|>", "a <|ENDOFTEXT|>, b", "It's, she'LL. go", "a,, b. c!! d_, e", "word " * 9000]
    tokenizer, encoder = Tokenizer.from_file(TOKENIZER), WordEncoder(TOKENIZER)
    cut = [chunks(x) for x in texts]
    words = sorted(set().union(*cut))
    ids_of = dict(zip(words, encoder.ids(words)))
    for text, parts in zip(texts, cut):
        assert np.frombuffer(b"".join(ids_of[x] for x in parts), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_packed(spark):
    rng = random.Random(8)
    rows = [(i, "word " * rng.choice([0, 1, 30, 700, 4095, 4096, 9000]) + ("x" if i % 2 else ""), "clash", "clash") for i in range(80)]
    rows += [(500, None, "", ""), (501, "", "", ""), (None, "nobody's text", "", ""), (502, "twice", "", ""), (502, "twice", "", "")] + [(600 + i, "same length", "", "") for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = packed(docs).collect()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = {}
    for i, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        want.setdefault(i, []).append(ids)
    own, by_sequence = {}, {}
    for r in got:
        own.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, texts in want.items():
        ids = texts[0]
        pieces = sorted(own[i], key=lambda r: r.start)
        assert sum(r.length for r in pieces) == len(texts) * len(ids) and all(r.doc_tokens == len(ids) for r in pieces)
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= MAX_TOKENS
    total = sum(r.length for r in got)
    assert len(by_sequence) <= total / MAX_TOKENS * 1.1 + 2 and sorted(by_sequence) == list(range(len(by_sequence)))
    whole = sequences(docs).collect()
    assert sum(r.n_tokens for r in whole) == total and all(len(r.ids) == 4 * r.n_tokens for r in whole)
    assert packed(docs.limit(0)).count() == 0
