"""The registered queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import boundary_plans, extract_plans, geometry_plans, page_plans, place_plans, record_plans, stream_plans, subdivision_plans

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**page_plans.QUERIES, **record_plans.QUERIES, **place_plans.QUERIES, **boundary_plans.QUERIES, **geometry_plans.QUERIES, **extract_plans.QUERIES, **stream_plans.QUERIES, **subdivision_plans.QUERIES}
ORACLE_SQL: dict[str, str] = {**page_plans.ORACLE_SQL, **record_plans.ORACLE_SQL, **place_plans.ORACLE_SQL, **boundary_plans.ORACLE_SQL, **geometry_plans.ORACLE_SQL, **extract_plans.ORACLE_SQL, **stream_plans.ORACLE_SQL, **subdivision_plans.ORACLE_SQL}
