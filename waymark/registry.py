"""Every query of the library but those of the subpackage llm, by name, and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


from .plans import catalogue_plans, class_plans, course_plans, detail_plans, exchange_plans, extra_plans, geometry_plans, ground_plans, map_plans, model_plans, network_plans, pixel_plans, score_plans, store_plans, table_plans, text_plans, track_plans  # noqa: E402, F401
