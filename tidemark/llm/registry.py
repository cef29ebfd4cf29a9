"""The queries of this subpackage and the SQL that checks them, by name."""

from __future__ import annotations

from tidemark.llm import archive, decontamination, fingerprint, html_text, jaccard_join, language, language_model, mixing, packing, periodic_runs, sharding, term_divergence, toxicity

QUERIES = {
    "op1_html_text": html_text.op1_html_text,
    "op2_language": language.op2_language,
    "op3_mixing": mixing.op3_mixing,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_language_model": language_model.op5_language_model,
    "op6_warc": archive.op6_warc,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_sharding": sharding.op9_sharding,
    "op10_fingerprint": fingerprint.op10_fingerprint,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_packing": packing.op12_packing,
    "op13_term_divergence": term_divergence.op13_term_divergence,
}

SQL = {
    "op4_jaccard_join": jaccard_join.OP4_SQL,
    "op6_warc": archive.OP6_SQL,
    "op8_decontamination": decontamination.OP8_SQL,
    "op13_term_divergence": term_divergence.OP13_SQL,
}
