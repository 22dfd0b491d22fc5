"""The queries of this subpackage, by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from turnflow.llm import alignment, cotraining, decontam, html_text, mixing, ngram_join, personal_data, quality_rules, sharding, spelling, suffix_dedup, toxicity, urls

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_html_extraction": html_text.op3_html_extraction,
    "op4_mixing": mixing.op4_mixing,
    "op5_sharding": sharding.op5_sharding,
    "op6_url_filters": urls.op6_url_filters,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_quality_classifier": cotraining.op8_quality_classifier,
    "op9_decontamination": decontam.op9_decontamination,
    "op10_ngram_join": ngram_join.op10_ngram_join,
    "op11_cross_tokenizer": alignment.op11_cross_tokenizer,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_personal_data": personal_data.op13_personal_data,
}

ORACLES = {
    "op1_suffix_dedup": suffix_dedup.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op9_decontamination": decontam.ORACLE,
    "op10_ngram_join": ngram_join.ORACLE,
}
