"""Query registry: name -> Spark callable (spark, sf_dir) and DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


def build() -> tuple[dict[str, QueryFn], dict[str, str]]:
    from linkrisk.plans import (dataset_queries, feature_queries, feed_queries, linear_checks, model_queries, scanlog_queries,
                                stream_queries)
    qs: dict[str, QueryFn] = {}
    sql: dict[str, str] = {}
    for mod in (feature_queries, dataset_queries, scanlog_queries, model_queries, stream_queries, feed_queries, linear_checks):
        mod.register(qs, sql)
    return qs, sql
