"""Registered queries over the driver's tables, with their SQL."""

from . import compare, matched, programs, registry, rules  # noqa: F401  they register their queries
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark, sf_dir):
    """The evaluation funnel by group."""
    return QUERIES["a4_funnel_by_group"](spark, sf_dir)
