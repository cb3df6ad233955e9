"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from dossierlake.llm import queries

QUERIES = {
    "op1_lm_scores": queries.op1_lm_scores,
    "op2_quality": queries.op2_quality,
    "op3_simhash": queries.op3_simhash,
    "op4_packing": queries.op4_packing,
    "op5_mix_sources": queries.op5_mix_sources,
    "op6_license_scan": queries.op6_license_scan,
    "op7_surrogates": queries.op7_surrogates,
    "op8_exact_search": queries.op8_exact_search,
    "op9_nearest": queries.op9_nearest,
    "op10_token_records": queries.op10_token_records,
    "read_records_by_range": queries.read_records_by_range,
    "op11_site_text": queries.op11_site_text,
    "op12_whitening": queries.op12_whitening,
    "op13_fill_middle": queries.op13_fill_middle,
}

ORACLE_SQL = {
    "op5_mix_sources": queries.OP5_SQL,
    "op6_license_scan": queries.OP6_SQL,
    "op8_exact_search": queries.OP8_SQL,
    "read_records_by_range": queries.RECORDS_BY_RANGE_SQL,
    "op13_fill_middle": queries.OP13_SQL,
}
