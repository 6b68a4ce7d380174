"""All queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from tiersight.queries import aggregates, demand, geography, joins, lists, naming, quality, recordkeeping, scripts, search, statistics, villages, windows  # noqa: F401
from tiersight.queries.base import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
