"""Every registered query of the lead-data operators, and its SQL."""

from __future__ import annotations

from . import chain_queries, delivery_queries, ledger_queries, match_queries, page_queries, record_queries, rule_queries, site_queries, stream_queries

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _part in (site_queries, record_queries, page_queries, chain_queries, delivery_queries, stream_queries, match_queries, ledger_queries, rule_queries):
    QUERIES.update(_part.QUERIES)
    ORACLE_SQL.update(_part.ORACLE_SQL)
