"""The opN_<name> queries of this subpackage and the SQL twins of those that SQL can express."""

from __future__ import annotations

from arbora.llm import langid, licenses, packing, periods, pieces, pq, quality, resampling, rules, simhash, substring, tokens, topk


def queries() -> dict:
    found = (
        tokens.op1_token_counts,
        packing.op2_packing,
        pq.op3_embedding_near_dedup,
        simhash.op4_simhash_near_dedup,
        substring.op5_substring_dedup,
        quality.op6_quality_classifier,
        topk.op7_exact_top_k,
        pieces.op8_sentencepiece_sampling,
        licenses.op9_license_scan,
        langid.op10_language_id,
        resampling.op11_importance_resampling,
        periods.op12_periodic_runs,
        rules.op13_quality_rules,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_embedding_near_dedup": pq.OP3_SQL,
        "op5_substring_dedup": substring.OP5_SQL,
        "op7_exact_top_k": topk.OP7_SQL,
        "op9_license_scan": licenses.OP9_SQL,
        "op11_importance_resampling": resampling.OP11_SQL,
        "op13_quality_rules": rules.OP13_SQL,
    }
