"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import corpus_pipeline
from quillspark.llm import byte_bpe, exact_dedup, filter_audit, flac, html_text, language_id, packing, quality, setsketch, simhash, spelling, url_filter, warc

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_warc": warc.op2_warc,
    "op3_flac": flac.op3_flac,
    "op4_language_id": language_id.op4_language_id,
    "op5_packing": packing.op5_packing,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_byte_bpe": byte_bpe.op7_byte_bpe,
    "op8_html_extraction": html_text.op8_html_extraction,
    "op9_simhash_near_dedup": simhash.op9_simhash_near_dedup,
    "op10_quality_classifier": quality.op10_quality_classifier,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_setsketch_near_dedup": setsketch.op12_setsketch_near_dedup,
    "op13_spelling_variants": spelling.op13_spelling_variants,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op1_url_filter": url_filter.ORACLE_SQL,
    "op2_warc": warc.ORACLE_SQL,
    "op6_exact_dedup": exact_dedup.ORACLE_SQL,
    "op11_filter_audit": filter_audit.ORACLE_SQL,
    "op12_setsketch_near_dedup": setsketch.ORACLE_SQL,
    "op13_spelling_variants": spelling.ORACLE_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
