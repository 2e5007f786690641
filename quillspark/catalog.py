"""The queries of this library and their SQL twins."""

from __future__ import annotations

from .plans import batch_queries, board_queries, building_queries, edit_queries, file_queries, finding_queries, frame_queries, layout_queries, page_queries, structure_queries, table_queries, text_queries

MODULES = (text_queries, table_queries, page_queries, file_queries, structure_queries, batch_queries, edit_queries, board_queries, building_queries, frame_queries, layout_queries, finding_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
