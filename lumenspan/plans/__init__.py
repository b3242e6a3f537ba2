"""Registered queries of the analytics operators and the SQL they are checked with."""

from lumenspan.plans import build_queries, fit_queries, metric_queries, report_queries, text_queries  # noqa: F401  they register their queries
from lumenspan.plans import oracle, queries, registry
from lumenspan.plans.queries import flagship

QUERIES = {**queries.QUERIES, **registry.QUERIES}
ORACLE_SQL = {**oracle.ORACLE_SQL, **registry.ORACLE_SQL}

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
