"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import functools

import corpus_pipeline
from molscreen.llm import exact_topk, kd_shards, mixing, packing, prefix_trie, quality_model, quality_rules, quotations, rotated_codes, simhash, spelling, token_counts, url_filter
from molscreen.session import ship


def _shipped(fn):
    @functools.wraps(fn)
    def run(spark, sf_dir):
        return fn(ship(spark), sf_dir)

    return run


QUERIES = {
    name: _shipped(fn)
    for name, fn in {
        "op1_quotations": quotations.query,
        "op2_url_filter": url_filter.query,
        "op3_quality_model": quality_model.query,
        "op4_simhash": simhash.query,
        "op5_packing": packing.query,
        "op6_kd_shards": kd_shards.query,
        "op7_rotated_codes": rotated_codes.query,
        "op8_token_counts": token_counts.query,
        "op9_mixing": mixing.query,
        "pipeline": corpus_pipeline.run,
        "op10_quality_rules": quality_rules.query,
        "op11_prefix_trie": prefix_trie.query,
        "op12_spelling": spelling.query,
        "op13_exact_topk": exact_topk.query,
    }.items()
}
SQL = {
    "op1_quotations": quotations.SQL,
    "op2_url_filter": url_filter.SQL,
    "op9_mixing": mixing.SQL,
    "op10_quality_rules": quality_rules.SQL,
    "op11_prefix_trie": prefix_trie.SQL,
    "op12_spelling": spelling.SQL,
    "op13_exact_topk": exact_topk.SQL,
}
