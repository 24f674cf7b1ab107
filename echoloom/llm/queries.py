"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import best_fit, conversations, exact_dedup, line_dedup, mixing, near_dedup, packing, pii, quality, spelling, substring_dedup, token_counts, url_filter

MODULES = (url_filter, exact_dedup, pii, quality, substring_dedup, line_dedup, near_dedup, token_counts, mixing, packing, spelling, conversations, best_fit)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    own = {k: s for m in MODULES for k, s in m.SQL.items()}
    return own | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
