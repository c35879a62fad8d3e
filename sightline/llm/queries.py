"""The registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from sightline.llm import chat, decontaminate, fim, fingerprint, jaccard, licenses, lm, mixing, quality, runs, suffix, tokenfile, urls


def queries() -> dict:
    return {
        "op1_url_filters": urls.op1_url_filters,
        "op2_document_fingerprints": fingerprint.op2_document_fingerprints,
        "op2_document_branches": fingerprint.op2_document_branches,
        "op3_source_mixing": mixing.op3_source_mixing,
        "op4_suffix_dedup": suffix.op4_suffix_dedup,
        "op5_license_scan": licenses.op5_license_scan,
        "op6_benchmark_decontamination": decontaminate.op6_benchmark_decontamination,
        "op7_quality_classifier": quality.op7_quality_classifier,
        "op8_chat_formatting": chat.op8_chat_formatting,
        "op9_jaccard_join": jaccard.op9_jaccard_join,
        "op10_lm_scoring": lm.op10_lm_scoring,
        "op11_periodic_runs": runs.op11_periodic_runs,
        "op12_fill_in_middle": fim.op12_fill_in_middle,
        "op13_token_files": tokenfile.op13_token_files,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_document_fingerprints": fingerprint.ORACLE,
        "op6_benchmark_decontamination": decontaminate.ORACLE,
        "op8_chat_formatting": chat.ORACLE,
        "op12_fill_in_middle": fim.ORACLE,
    }
