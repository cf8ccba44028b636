"""The queries of this package and their SQL, by name."""

from __future__ import annotations

from . import bpe, dedup, fingerprint, language, mixing, neighbours, packing, phrases, pii, quality, runs, secret_scan, urls

QUERIES = {
    "op1_near_dedup": dedup.op1_near_dedup,
    "op2_quality": quality.op2_quality,
    "op3_bpe": bpe.op3_bpe,
    "op4_secrets": secret_scan.op4_secrets,
    "op5_neighbours": neighbours.op5_neighbours,
    "op6_personal_data": pii.op6_personal_data,
    "op7_mixing": mixing.op7_mixing,
    "op8_fingerprints": fingerprint.op8_fingerprints,
    "op9_language_id": language.op9_language_id,
    "op10_url_filters": urls.op10_url_filters,
    "op11_runs": runs.op11_runs,
    "op12_packing": packing.op12_packing,
    "op13_phrases": phrases.op13_phrases,
}

SQL = {
    "op8_fingerprints": fingerprint.SQL,
    "op10_url_filters": urls.SQL,
    "op13_phrases": phrases.SQL,
}
