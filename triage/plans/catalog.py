"""All registered queries and their oracles, by name."""

from __future__ import annotations

from . import event_queries, ngram_queries, oracle, repair_queries, runmetric_queries, store_queries, triage_queries

QUERIES = {}
QUERIES.update(triage_queries.QUERIES)
QUERIES.update(repair_queries.QUERIES)
QUERIES.update(event_queries.QUERIES)
QUERIES.update(ngram_queries.QUERIES)
QUERIES.update(runmetric_queries.QUERIES)
QUERIES.update(store_queries.QUERIES)

ORACLE = {}
ORACLE.update(oracle.ORACLE)
ORACLE.update(repair_queries.ORACLE)
ORACLE.update(event_queries.ORACLE)
ORACLE.update(ngram_queries.ORACLE)
ORACLE.update(runmetric_queries.ORACLE)
ORACLE.update(store_queries.ORACLE)

assert set(ORACLE) <= set(QUERIES), set(ORACLE) - set(QUERIES)
