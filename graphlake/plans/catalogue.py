"""All registered graph queries."""

from __future__ import annotations

from collections.abc import Callable

from graphlake.plans import analytics_queries, change_queries, index_queries, path_queries, scan_queries, text_queries  # noqa: F401
from graphlake.plans.registry import QUERIES, SQL


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
