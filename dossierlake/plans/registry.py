"""Queries of the audit operators and the SQL that checks them.

Queries over literal rows alone are unit tests: those of the same name in derived_queries take their place here.
"""

from __future__ import annotations

from dossierlake.plans import audit_queries, derived_queries, extended_queries, file_queries, fixture_queries, whole_audit

#: Without a table behind them and without a query of the same name over one.
LITERAL_ONLY = ("profile_first_field", "combined_patches")
LITERAL = {n: m for m in (fixture_queries, file_queries) for n in m.QUERIES if n in derived_queries.QUERIES or n in LITERAL_ONLY}

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (audit_queries, fixture_queries, whole_audit, file_queries, extended_queries, derived_queries):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
for _name in LITERAL_ONLY:
    del QUERIES[_name], ORACLE_SQL[_name]
