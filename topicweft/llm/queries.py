"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import (
    decontaminate, exact_dedup, language_id, licenses, line_dedup, lm_scoring, near_join, packing, phrases, spelling,
    substring_dedup, suffix_dedup, token_counts,
)

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_ngram_jaccard_join": near_join.op2_ngram_jaccard_join,
    "op3_lm_scoring": lm_scoring.op3_lm_scoring,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_language_id": language_id.op8_language_id,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_packing": packing.op10_packing,
    "op11_line_dedup": line_dedup.op11_line_dedup,
    "op12_phrase_collocations": phrases.op12_phrase_collocations,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}
SQL = {
    "op6_substring_dedup": substring_dedup.OP6_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op9_decontamination": decontaminate.OP9_SQL,
    "op11_line_dedup": line_dedup.OP11_SQL,
    "op12_phrase_collocations": phrases.OP12_SQL,
}
