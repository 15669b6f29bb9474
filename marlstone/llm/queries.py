"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from marlstone.llm import exact_dedup, html_text, language_id, mixing, packing, quality_rules, simhash, substring_dedup, url_filter, warc

QUERIES = {
    f.__name__: f
    for f in (
        exact_dedup.op1_exact_dedup,
        packing.op2_best_fit_packing,
        html_text.op3_html_text,
        substring_dedup.op4_substring_dedup,
        url_filter.op5_url_filter,
        mixing.op6_mixing,
        language_id.op7_language_id,
        simhash.op8_simhash,
        warc.op9_warc,
        quality_rules.op10_quality_rules,
    )
}

#: Queries without SQL are tested against brute force in tests/llm.
SQL = {"op1_exact_dedup": exact_dedup.SQL, "op5_url_filter": url_filter.SQL, "op6_mixing": mixing.SQL, "op9_warc": warc.SQL}
