"""All registered queries of this subpackage, with their SQL."""

from __future__ import annotations

from loomspark.llm import queries_docpairs, queries_fitting, queries_leakage, queries_quantiles, queries_syntaxcheck

_MODULES = [queries_docpairs, queries_quantiles, queries_syntaxcheck, queries_fitting, queries_leakage]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
