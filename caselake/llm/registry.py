"""Queries and SQL of the corpus operators."""

from __future__ import annotations

from . import (
    ann_tree,
    bin_packing,
    fertility_rules,
    language_id,
    line_dedup,
    secret_scan,
    simhash_dedup,
    source_mixing,
    suffix_dedup,
    term_search,
    token_output,
    toxic_crf,
    vector_codes,
)

QUERIES = {
    "op1_toxic_crf": toxic_crf.op1_toxic_crf,
    "op2_simhash_dedup": simhash_dedup.op2_simhash_dedup,
    "op3_fertility_rules": fertility_rules.op3_fertility_rules,
    "op4_bin_packing": bin_packing.op4_bin_packing,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_source_mixing": source_mixing.op6_source_mixing,
    "op7_language_id": language_id.op7_language_id,
    "op8_ann_tree": ann_tree.op8_ann_tree,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_token_output": token_output.op10_token_output,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_term_search": term_search.op12_term_search,
    "op13_suffix_dedup": suffix_dedup.op13_suffix_dedup,
}
SQL = {"op5_line_dedup": line_dedup.OP5_SQL, "op11_vector_codes": vector_codes.OP11_SQL, "op12_term_search": term_search.OP12_SQL}


def queries() -> dict:
    import corpus_pipeline

    return {**QUERIES, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    return dict(SQL)
