"""The registered queries that SQL can't express, on whole tables, against brute force or held-out labels."""

import base64
import hashlib
import html
import re
import zlib

import numpy as np
import pytest
import tiktoken
from tokenizers import Tokenizer

from quillspark.llm.byte_bpe import PATTERN, RANKS
from quillspark.llm.packing import MAX_TOKENS, TOKENIZER
from quillspark.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_simhash import slow_components, slow_fingerprint


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").collect()


def run(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    return found.columns, found.collect()


def test_names():
    assert [f"op{n}_" for n in range(1, 14)] == [n[: n.index("_") + 1] for n in QUERIES if n != "pipeline"]
    assert set(ORACLE_SQL) == {"op1_url_filter", "op2_warc", "op6_exact_dedup", "op11_filter_audit", "op12_setsketch_near_dedup", "op13_spelling_variants"}


def test_op3(spark, sf_dir, docs):
    columns, rows = run(spark, sf_dir, "op3_flac")
    assert columns == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs)
    for d in docs:
        raw = (d.text or "").encode()
        pad = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        assert r.media_bytes < len(pad) + 200


def test_op4(spark, sf_dir, docs):
    columns, rows = run(spark, sf_dir, "op4_language_id")
    assert columns == ["doc_id", "held_out", "lang_pred", "score"] and len(rows) == len(docs)
    lang = {d.doc_id: d.lang for d in docs}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert sum(held) / len(held) >= 0.95


def test_op5(spark, sf_dir, docs):
    columns, rows = run(spark, sf_dir, "op5_packing")
    assert columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    tokenizer, pieces, packs = Tokenizer.from_file(TOKENIZER), {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        packs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d in docs:
        ids = tokenizer.encode(d.text or "", add_special_tokens=False).ids + [2]
        at = 0
        for r in sorted(pieces[d.doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for places in packs.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))] and sum(n for _, n in places) <= MAX_TOKENS


def test_op7(spark, sf_dir, docs):
    columns, rows = run(spark, sf_dir, "op7_byte_bpe")
    assert columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    with open(RANKS, "rb") as file:
        library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}, special_tokens={})
    want = set()
    for d in docs:
        ids = library.encode_ordinary(d.text or "")
        want.add((d.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest()))
    assert {tuple(r) for r in rows} == want


def test_op8(spark, sf_dir):
    columns, rows = run(spark, sf_dir, "op8_html_extraction")
    assert columns == ["page_id", "url", "text", "n_chars"]
    got = {r.page_id: r for r in rows}
    for p in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert got[p.page_id].text == "\n\n".join(x for x in blocks if x) and got[p.page_id].n_chars == len(got[p.page_id].text)


def test_op9(spark, sf_dir, docs):
    columns, rows = run(spark, sf_dir, "op9_simhash_near_dedup")
    assert columns == ["doc_id", "fingerprint", "component_id"]
    fps = [slow_fingerprint(d.text) for d in docs]
    label, least = slow_components(fps), {}
    for d, w in zip(docs, label):
        least[w] = min(d.doc_id, least.get(w, d.doc_id))
    assert {tuple(r) for r in rows} == {(d.doc_id, f"{f:016x}", least[w]) for d, f, w in zip(docs, fps, label)}


def test_op10(spark, sf_dir, docs):
    columns, rows = run(spark, sf_dir, "op10_quality_classifier")
    assert columns == ["doc_id", "held_out", "score", "predicted"] and len(rows) == len(docs)
    got = {r.doc_id: r for r in rows}
    held = [got[r.doc_id].predicted == r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(held) / len(held) >= 0.9 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_op4_against_a_plain_greedy_parse(spark, sf_dir, docs):
    """The language of texts of moderate length from the definition: fewest bits over a parse into longest substrings."""
    from quillspark.llm.language_id import SAMPLE_CHARS, CrossParser, labelled_samples
    from tests.llm.test_language_id import slow_phrases

    samples = labelled_samples(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    parser = CrossParser({})
    coded = {}
    for language, text in samples.items():
        codes = parser._symbols([text])[0]
        coded[language] = codes[np.cumsum((codes & 0xC0) != 0x80) <= SAMPLE_CHARS].tobytes().decode("utf-8", "ignore")
    got = {r.doc_id: r.lang_pred for r in run(spark, sf_dir, "op4_language_id")[1]}
    short = [d for d in docs if 0 < len(d.text or "") < 1200][:60]
    assert len(short) > 20
    for d in short:
        if not any(c.isalpha() for c in d.text):
            assert got[d.doc_id] == "und"
            continue
        bits = {x: slow_phrases(parser, s, d.text) * np.log2(len(s.encode()) + 2) for x, s in coded.items()}
        assert bits[got[d.doc_id]] == pytest.approx(min(bits.values()))


def test_op10_against_a_plain_fit(spark, sf_dir, docs):
    """Scores of a model fitted in one process on samples and features made from their definitions."""
    from pyspark.sql import functions as F

    from quillspark.llm import quality
    from tests.llm.test_quality import slow_features

    key = {r.doc_id: r.h for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    trusted = {r.doc_id for r in labels if r.quality == 1 and zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    rows = sorted((key[d.doc_id], slow_features(d.text or ""), d.doc_id) for d in docs)
    model = quality.QualityModel(np.array([x for _, x, i in rows if i in trusted], np.float32), np.array([x for _, x, _ in rows], np.float32))
    want = {i: float(quality._sigmoid(model._standard(np.array([x], np.float32)) @ model.weights)[0]) for _, x, i in rows}
    got = {r.doc_id: r.score for r in run(spark, sf_dir, "op10_quality_classifier")[1]}
    assert got == pytest.approx(want, abs=1e-3)
