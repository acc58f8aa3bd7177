"""The registry of queries and of their equivalents in SQL."""

from __future__ import annotations

from stackroom.plans import model_queries, record_queries, text_queries

QUERIES: dict = {**record_queries.QUERIES, **text_queries.QUERIES, **model_queries.QUERIES}
ORACLES: dict[str, str] = {**record_queries.ORACLES, **text_queries.ORACLES, **model_queries.ORACLES}
