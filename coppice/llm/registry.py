"""The corpus queries and their SQL twins, by name."""

from __future__ import annotations

from coppice.llm import bpe_roundtrip, exact_dedup, fill_middle, kd_shard, language_id, poisson_mix, preference, simhash, span_dedup, token_counts, topk, toxicity, vector_codes


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.query,
        "op2_token_counts": token_counts.query,
        "op3_bpe_roundtrip": bpe_roundtrip.query,
        "op4_kd_shard": kd_shard.query,
        "op5_poisson_mix": poisson_mix.query,
        "op6_simhash": simhash.query,
        "op7_language_id": language_id.query,
        "op8_toxicity": toxicity.query,
        "op9_exact_topk": topk.query,
        "op10_preference": preference.query,
        "op11_vector_codes": vector_codes.query,
        "op12_span_dedup": span_dedup.query,
        "op13_fill_middle": fill_middle.query,
    }


def oracle_sql() -> dict[str, str]:
    """Texts in SQL for what SQL can express."""
    twins = {"op1_exact_dedup": exact_dedup, "op5_poisson_mix": poisson_mix, "op9_exact_topk": topk, "op10_preference": preference, "op11_vector_codes": vector_codes, "op13_fill_middle": fill_middle}
    return {name: module.SQL for name, module in twins.items()}
