import random

import corpus_pipeline
from quillspark.llm import exact_dedup, language_id, packing, quality, similar_texts
from quillspark.llm.common import table


def test_stages_match_their_operators(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    state = docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "quality_classifier", "exact_dedup", "simhash_near_dedup", "packing"]
    rules = {
        "language_id": lambda d: {r.doc_id for r in language_id.identify(d).collect() if r.lang_pred != "und" and r.rate <= language_id.FOREIGN_RATE},
        "quality_classifier": lambda d: {r.doc_id for r in quality.score_quality(d, table(spark, sf_dir, "labels")).collect() if r.predicted == 1},
        "exact_dedup": lambda d: {r.doc_id for r in exact_dedup.exact_dedup(d).collect() if r.kept},
        "simhash_near_dedup": lambda d: {r.component_id for r in similar_texts.similar_components(d).collect()},
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialise(stage(spark, state, sf_dir), "test")
        assert out.columns == docs.columns
        assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(rules[name](state))
        state = out
    rows = corpus_pipeline.STAGES[-1][1](spark, state, sf_dir).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in state.select("doc_id").collect()}
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)


def test_odd_rows(spark, sf_dir):
    rng = random.Random(3)
    plain = [(i, " ".join(rng.choices(["the", "of", "thing", "ander", "tion", "ha", "re"], k=60)) + ".", "en", "s", 1) for i in range(30)]
    rows = plain + [(100, None, None, None, None), (101, "", "en", None, None), (None, plain[0][1], None, None, None), (5, plain[5][1], "en", "s", 1), (7, plain[8][1].upper(), "en", "s", 1), (102, "12 34", "en", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    state = docs
    for _, stage in corpus_pipeline.STAGES:
        state = corpus_pipeline.materialise(stage(spark, state, sf_dir), "test")
    assert state.count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
