"""Queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terazi.plans import combined_queries
from terazi.plans.data_queries import DATA_QUERIES, DATA_SQL
from terazi.plans.reference_queries import SQL, Q, flow_decomposition


def core_queries() -> dict:
    return dict(DATA_QUERIES) | dict(Q) | dict(combined_queries.Q)


def core_sql() -> dict:
    return dict(DATA_SQL) | dict(SQL) | dict(combined_queries.SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of size split into market effect and flow, per fund."""
    return flow_decomposition(spark, sf_dir)
