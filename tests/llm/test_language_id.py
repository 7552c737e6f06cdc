import random
import zlib

import pytest

from quillspark.llm.common import table
from quillspark.llm.language_id import BLOCK, CrossParser, accepted, identify


def slow_phrases(parser, sample, text):
    """Greedy parse of the whole coded text into longest substrings of the coded sample."""
    sample = parser._symbols([sample])[0].tobytes()
    rest, count = parser._symbols([text])[0].tobytes(), 0
    while rest:
        n = 0
        while n < len(rest) and rest[: n + 1] in sample:
            n += 1
        count += 1
        rest = rest[max(n, 1) :]
    return count


SAMPLES = {"aa": "the cat sat on the mat and the dog sat on the log " * 3, "bb": "der hund und die katze sassen auf der matte " * 3, "cc": "πολύ ωραία μέρα σήμερα "}


@pytest.mark.parametrize("text", ["The CAT sat!!", "", "12 34", "und die dog", "zzz qqq", "σήμερα the", "x", "the cat " * 900, SAMPLES["bb"][3:] * 40, "κσκ qd" * 1200, "ab\u0301c 日本"])
def test_phrases_are_those_of_a_greedy_parse(text):
    parser = CrossParser(SAMPLES)
    count, _ = parser.phrases(["some other text", text, "der"])
    assert count[:, 1].tolist() == [slow_phrases(parser, SAMPLES[x], text) for x in parser.languages]


def test_long_texts_are_parsed_as_a_whole():
    rng = random.Random(4)
    samples = {"aa": words(rng, ["the", "ing", "an"], 400), "bb": words(rng, ["ung", "a", "é", "the"], 400)}
    parser = CrossParser(samples)
    texts = [words(rng, ["the", "ing", "a", "é"], k) for k in (1, 30, 200, 700, 1500)] + [samples["aa"] * 3, "the" * BLOCK, "q" * (3 * BLOCK)]
    count, _ = parser.phrases(texts)
    assert count.T.tolist() == [[slow_phrases(parser, samples[x], t) for x in parser.languages] for t in texts]


def words(rng, syllables, n):
    return " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(n))


def corpus():
    rng = random.Random(2)
    kinds = {"xx": ["the", "ing", "an", "er", "on"], "yy": ["ung", "sch", "ei", "ver", "tz"], "zz": ["ción", "os", "ue", "la", "mi"]}
    return [(i, words(rng, kinds[k], rng.choice([5, 50, 300])), k, "extra") for i, k in enumerate(rng.choices(list(kinds), k=300))]


SCHEMA = "doc_id long, text string, lang string, score string"


def test_held_out_accuracy_and_edge_cases(spark):
    rows = corpus()
    odd = [(1000, None, "xx", ""), (1001, "", None, ""), (1002, " 12 !? ", "yy", ""), (None, rows[0][1], "xx", ""), (1003, rows[0][1] * 200, None, ""), (1003, rows[0][1] * 200, None, "")]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    got = identify(docs).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + len(odd)
    held = [(by_id[i].lang_pred, k) for i, _, k, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(a == b for a, b in held) / len(held) >= 0.95
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    assert [by_id[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert by_id[1003].lang_pred == rows[0][2] == by_id[None].lang_pred
    # labels of held-out rows are not read
    poisoned = spark.createDataFrame([(i, t, "poison" if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else k, s) for i, t, k, s in rows + odd], SCHEMA)
    assert sorted(map(str, identify(poisoned).collect())) == sorted(map(str, got))
    kept = accepted(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted([i for i, *_ in rows] + [1003, 1003])


def test_empty_and_nothing_learnt(spark):
    assert identify(spark.createDataFrame([], SCHEMA)).count() == 0
    r = identify(spark.createDataFrame([(1, "some text", None, "")], SCHEMA)).first()
    assert (r.lang_pred, r.score) == ("und", 0.0)


def han(rng, first, n):
    """Text of *n* rare letters from a range of 3,000."""
    return "".join(chr(first + rng.randrange(3000)) for _ in range(n))


def test_letters_of_large_alphabets_are_not_merged():
    rng = random.Random(4)
    parser = CrossParser({"zh": han(rng, 0x4E00, 16_000), "ja": han(rng, 0x6000, 16_000), "en": SAMPLES["aa"]})
    texts = [han(rng, 0x4E00, 300), han(rng, 0x6000, 300), han(rng, 0xAC00, 300), "".join(chr(0x10A0 + rng.randrange(32)) for _ in range(300))]
    languages, _, rate = parser.judge(texts)
    assert languages[:2] == ["zh", "ja"]
    assert min(rate[2:]) > 1.2 * max(rate[:2])  # other scripts don't parse into long phrases


def test_samples_do_not_shrink_with_the_number_of_languages():
    rng = random.Random(5)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöùúûüýþ", k=17_000))
    alone = CrossParser({"a": text}).phrases([text])[0]
    many = CrossParser({"a": text, **{f"x{i}": text[i : i + 9_000] for i in range(12)}}).phrases([text])[0]
    assert many[0].tolist() == alone[0].tolist()


def test_every_labelled_language_is_learnt(spark):
    rng = random.Random(6)
    kinds = {f"l{k:02d}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3)) for _ in range(6)] for k in range(70)}
    rows = [(100 * i + j, words(rng, kinds[k], 60), k, "") for i, k in enumerate(kinds) for j in range(6)]
    rows += [(9000 + j, words(rng, ["ζω", "λα", "μει"], 12_000), "long", "") for j in range(4)]  # only rows over the bound of a row
    got = {r.doc_id: r.lang_pred for r in identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i: got[i] for i, *_ in rows} == {i: k for i, _, k, _ in rows}


FOREIGN = [
    "La situazione economica del paese è migliorata notevolmente negli ultimi anni grazie alle riforme. Il governo ha deciso di continuare su questa strada.",
    "Suomen kieli on yksi Euroopan unionin virallisista kielistä ja sitä puhuu noin viisi miljoonaa ihmistä. Kesällä monet lähtevät mökille.",
    "Wczoraj wieczorem poszliśmy do kina na nowy film, który bardzo nam się podobał. Potem wróciliśmy do domu ostatnim tramwajem.",
    "De regering heeft gisteren besloten dat de nieuwe wet volgend jaar wordt ingevoerd. Veel mensen zijn het daar niet mee eens.",
]


def test_unlearnt_languages_of_a_known_alphabet_go(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(10_000_000 + i, x, None) for i, x in enumerate(FOREIGN)], "doc_id long, text string, lang string")
    rows = docs.unionByName(more)
    kept = {r.doc_id for r in accepted(rows).select("doc_id").collect()}
    assert not kept & {10_000_000 + i for i in range(len(FOREIGN))}
    labelled = {r.doc_id for r in docs.filter("lang is not null").select("doc_id").collect()}
    assert len(labelled - kept) <= len(labelled) // 500
