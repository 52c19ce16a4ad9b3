"""All queries of the library's own operators, with SQL for the same rows."""

from __future__ import annotations

from strandmix.plans import clustered, models, signal, studies
from strandmix.plans.registry import ORACLE, QUERIES, Query

#: Importing them registers their queries.
MODULES = (signal, models, studies, clustered)

flagship = clustered.flagship


def queries() -> dict[str, Query]:
    """By name, from the modules above."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """SQL by name, for those that SQL can express."""
    return dict(ORACLE)
