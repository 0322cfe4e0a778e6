"""The queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

import corpus_pipeline

from weftwork.llm import chat_format, fingerprints, language, line_dedup, mixing, near_dedup, packing, periodic_runs, prefix_trie, sharding, suffix_dedup, topk, toxicity

MODULES = [chat_format, fingerprints, language, line_dedup, mixing, near_dedup, packing, periodic_runs, prefix_trie, sharding, suffix_dedup, topk, toxicity]


def queries() -> dict:
    out = {}
    for module in MODULES:
        out |= module.QUERIES
    return out | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    out = {}
    for module in MODULES:
        out |= module.ORACLE_SQL
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
