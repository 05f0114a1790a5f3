"""Every registered query of the monitoring operators, with its DuckDB SQL."""

from __future__ import annotations

from skeinwatch.plans import drift_queries, eval_queries, genai_queries, stream_queries, table_queries, trace_queries

QUERIES: dict = {}
ORACLE: dict = {}
for _module in (drift_queries, trace_queries, genai_queries, eval_queries, table_queries, stream_queries):
    QUERIES.update(_module.BOOK.queries)
    ORACLE.update(_module.BOOK.oracle)
