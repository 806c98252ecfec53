"""Everything that is registered."""

from strideframe.plans import (  # noqa: F401
    history_queries,
    learning_queries,
    lifecycle_queries,
    quality_queries,
    sensor_queries,
    source_queries,
    stream_queries,
)
from strideframe.plans.registry import CHECKS, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(CHECKS)
