import base64
import hashlib
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import corpus_words
from quillspark.llm.byte_bpe import PATTERN, RANKS, MergeReplay, Splitter, decode, encode, round_trip


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def replay():
    return MergeReplay(RANKS)


def encoded(replay, texts):
    cut = [Splitter()(x) for x in texts]
    words = sorted(set().union(*cut))
    ids = dict(zip(words, replay.replay([x.encode() for x in words])))
    return [np.frombuffer(b"".join(ids[x] for x in words), "<u4").tolist() for words in cut]


TEXTS = ["", " ", "a", "Hello, world's  best\n\n \tthing's 12 345", "<|endoftext|>", "é日本\u0301 ½²Ⅷ", "a" * 20_000, " " * 5000, "\x1c\x85\xa0x", "The the THE " * 300, "ǅ×÷ſ\u2028y"]


def test_known_texts(library, replay):
    for text, ids in zip(TEXTS, encoded(replay, TEXTS)):
        assert ids == library.encode_ordinary(text)
        assert b"".join(replay.tokens[x] for x in ids) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_any_texts(library, replay, texts):
    for text, ids in zip(texts, encoded(replay, texts)):
        assert ids == library.encode_ordinary(text)


def test_random_words(library, replay):
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzeeett  ", k=rng.choice([3, 30, 300]))) for _ in range(800)]
    assert encoded(replay, texts) == [library.encode_ordinary(x) for x in texts]


def test_every_token_of_the_vocabulary(library, replay):
    words = [x for x in replay.ranks if x]
    assert [np.frombuffer(x, "<u4").tolist() for x in replay.replay(words)] == [library._core_bpe.encode_single_piece(x) for x in words]


def test_blocks_and_words_over_many_partitions(spark, library, monkeypatch):
    monkeypatch.setattr(corpus_words, "BLOCK_CHARS", 200)
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("abcdeé ", k=rng.choice([1, 4, 9]))) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 30, 400])))) for i in range(120)]
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in encode(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == {i: library.encode_ordinary(t) for i, t in rows}


def test_frames(spark, library):
    docs = spark.createDataFrame([(i if i else None, t, "clash") for i, t in enumerate([None, *TEXTS, TEXTS[3]])], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in round_trip(docs).collect()}
    for i, text in enumerate(["", *TEXTS, TEXTS[3]]):
        ids = library.encode_ordinary(text)
        r = got[i or None]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    coded = encode(docs)
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in coded.collect()}[4] == library.encode_ordinary(TEXTS[3])
    assert {r.doc_id: bytes(r.data) for r in decode(coded).collect()}[4] == TEXTS[3].encode()
    assert round_trip(docs.limit(0)).count() == 0


def test_words_are_shuffled_packed_and_texts_not_at_all(spark, library):
    """Texts stay in the buckets of their blocks; a list of words goes out and comes back as packed values, less than their bytes."""
    words = [f" word{i:05}" for i in range(20_000)]
    pack = corpus_words.packed_words(words)
    assert corpus_words.unpacked_words(**pack) == words and sum(map(len, pack.values())) * 3 < sum(map(len, words))
    assert all(corpus_words.unpacked(corpus_words.packed(np.array(x, np.uint32))).tolist() == x for x in ([], [0], [1, 2**32 - 1, 300]))
    assert corpus_words.unpacked_words(**corpus_words.packed_words(["", "é日", "😀\0\n"])) == ["", "é日", "😀\0\n"]
    docs = spark.createDataFrame([(i, "the same words " * i) for i in range(50)], "doc_id long, text string").repartition(3)
    got = round_trip(docs)
    rows = {r.doc_id: r.n_tokens for r in got.collect()}
    assert rows == {i: len(library.encode_ordinary("the same words " * i)) for i in range(50)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange") - plan.count("BroadcastExchange") == 2 * (1 + plan.count("== Initial Plan =="))
