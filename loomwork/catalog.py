"""All queries of the engine's own operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwork.plans import registry
from loomwork.plans import relational, search, upkeep  # noqa: F401  they register their queries

#: The query that entry() runs.
FLAGSHIP = "vec_topk"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
