"""Names of the registered queries, with the SQL that checks them."""

from . import annotated, bindings, durable, intake, ledger, more, nested, pages, receipts

_MODULES = (bindings, more, receipts, intake, ledger, pages, durable, nested, annotated)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
