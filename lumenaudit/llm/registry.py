"""Queries and SQL of the training-data operators, for __spark_entry__."""

from __future__ import annotations

from . import collocations, crosspolytope, html_template, lattice_lm, minhash, mixing, packing, ranked_search, substring, token_counts, token_orc, topk, toxicity


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_count_tokens": token_counts.op2_count_tokens,
        "op3_top_k": topk.op3_top_k,
        "op4_pack_documents": packing.op4_pack_documents,
        "op5_token_orc": token_orc.op5_token_orc,
        "op6_embedding_near_duplicates": crosspolytope.op6_embedding_near_duplicates,
        "op7_minhash_near_duplicates": minhash.op7_minhash_near_duplicates,
        "op8_extract_main_text": html_template.op8_extract_main_text,
        "op9_mix_sources": mixing.op9_mix_sources,
        "op10_lattice_lm": lattice_lm.op10_lattice_lm,
        "op11_collocations": collocations.op11_collocations,
        "op12_substring_dedup": substring.op12_substring_dedup,
        "op13_ranked_search": ranked_search.op13_ranked_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_top_k": topk.OP3_SQL,
        "op6_embedding_near_duplicates": crosspolytope.OP6_SQL,
        "op9_mix_sources": mixing.OP9_SQL,
        "op11_collocations": collocations.OP11_SQL,
        "op12_substring_dedup": substring.OP12_SQL,
        "op13_ranked_search": ranked_search.OP13_SQL,
    }
