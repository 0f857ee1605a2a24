"""The queries of this subpackage and their DuckDB SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from caremart.llm import (chat, collocations, decontaminate, fingerprint, html, jaccard, mixing, negatives, packing, pii,
                          quality, tokens, toxicity)

QUERIES = {
    "op1_source_mixing": mixing.query,
    "op2_token_counts": tokens.query,
    "op3_document_fingerprints": fingerprint.query,
    "op4_html_extraction": html.query,
    "op5_chat_formatting": chat.query,
    "op6_ngram_jaccard_join": jaccard.query,
    "op7_personal_data": pii.query,
    "op8_toxicity": toxicity.query,
    "op9_quality_classifier": quality.query,
    "op10_benchmark_decontamination": decontaminate.query,
    "op11_packing": packing.query,
    "op12_hard_negatives": negatives.query,
    "op13_phrase_collocations": collocations.query,
}

SQL = {
    "op1_source_mixing": mixing.SQL,
    "op5_chat_formatting": chat.SQL,
    "op12_hard_negatives": negatives.SQL,
    "op13_phrase_collocations": collocations.SQL,
}
