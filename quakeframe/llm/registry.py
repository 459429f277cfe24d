"""All queries of the subpackage and their SQL."""

from __future__ import annotations

from . import best_fit_packing, decontaminate, language_id, license_scan, lm_score, phrase_repeats, piece_codec, quality_rules, ranked_search, secret_scan, simhash_dedup, token_counts, vector_codes

MODULES = (license_scan, language_id, secret_scan, token_counts, piece_codec, quality_rules, simhash_dedup, decontaminate, lm_score, phrase_repeats, best_fit_packing, ranked_search, vector_codes)

QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
