"""All bound queries and their SQL."""

from __future__ import annotations

from . import bound, bound_cases, bound_codes, bound_more, bound_rest, bound_rules  # noqa: F401  registers as it loads


def queries() -> dict:
    return dict(bound.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(bound.SQL)
