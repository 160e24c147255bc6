"""All registered queries and the SQL text that checks them."""

from __future__ import annotations

from sentrace.plans import (
    feature_queries,
    label_queries,
    metric_queries,
    report_queries,
    scoring_queries,
    session_queries,
    source_queries,
)

MODULES = (
    session_queries,
    report_queries,
    feature_queries,
    label_queries,
    metric_queries,
    scoring_queries,
    source_queries,
)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: text for module in MODULES for name, text in module.ORACLE.items()}
