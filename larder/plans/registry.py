"""All queries and oracle statements outside the subpackage llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larder.plans import evaluation_queries, metric_queries, profile_queries, ranking_queries, records, sample_queries, source_queries, text_queries

_MODULES = (profile_queries, sample_queries, metric_queries, ranking_queries, source_queries, text_queries, evaluation_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = dict(records.queries())
    for m in _MODULES:
        out |= m.R.queries
    return out


def oracle_sql() -> dict[str, str]:
    out = dict(records.oracle_sql())
    for m in _MODULES:
        out |= m.R.sql
    return out
