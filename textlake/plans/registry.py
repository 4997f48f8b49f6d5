"""All core queries by name, each with the SQL that checks it."""

from __future__ import annotations

from textlake.plans import more_queries, path_queries, survey_queries, table_queries, text_queries  # noqa: F401
from textlake.plans.base import QUERIES, SQL, Query

FLAGSHIP = "r2_exact_path"


def queries() -> dict[str, Query]:
    """Query by name; each takes (spark, directory of tables)."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """SQL by the query's name."""
    return dict(SQL)
