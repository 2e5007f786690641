"""The queries of this package, by name."""

from __future__ import annotations

import corpus_pipeline

from . import chat, exact_dedup, fim, language_id, licenses, media, merkle, mixing, ngram_join, packing, quality, token_counts, url_rules

MODULES = (packing, mixing, chat, ngram_join, language_id, licenses, media, quality, url_rules, exact_dedup, token_counts, fim, merkle)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
