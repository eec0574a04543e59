"""All queries of the engine by name, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from . import detail_queries, file_queries, page_queries, picture_queries, sheet_queries, vision_queries

QUERIES = {**sheet_queries.QUERIES, **vision_queries.QUERIES, **file_queries.QUERIES, **detail_queries.QUERIES, **page_queries.QUERIES, **picture_queries.QUERIES}
ORACLES = {**sheet_queries.ORACLES, **vision_queries.ORACLES, **file_queries.ORACLES, **detail_queries.ORACLES, **page_queries.ORACLES, **picture_queries.ORACLES}
