"""The queries of this subpackage and the SQL of those that SQL expresses."""

from __future__ import annotations

from gapweave.llm import counts, decontaminate, html, langid, ngram_join, packing, pii, quality, shards, urls


def queries() -> dict:
    return {
        "op1_pii": pii.op1_pii,
        "op2_best_fit_packing": packing.op2_best_fit_packing,
        "op3_ngram_jaccard_join": ngram_join.op3_ngram_jaccard_join,
        "op4_token_shards": shards.op4_token_shards,
        "op5_benchmark_decontamination": decontaminate.op5_benchmark_decontamination,
        "op6_url_filters": urls.op6_url_filters,
        "op7_quality_rules": quality.op7_quality_rules,
        "op8_token_counts": counts.op8_token_counts,
        "op9_language_id": langid.op9_language_id,
        "op10_html_extraction": html.op10_html_extraction,
    }


def oracle_sql() -> dict[str, str]:
    return {**decontaminate.SQL, **urls.SQL, **quality.SQL}
