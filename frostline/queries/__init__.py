"""One query per operator over the test tables, each with DuckDB SQL for the same rows where SQL can express it."""

from frostline.queries import compare, lifecycle, selection, values  # noqa: F401  they register their queries
from frostline.queries.common import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
