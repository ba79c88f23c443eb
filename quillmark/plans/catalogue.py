"""All registered queries over the core operators, the same in DuckDB SQL, and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmark.operators import context
from quillmark.plans import file_queries, search_queries, service_queries  # noqa: F401  they register their queries
from quillmark.plans.registered import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid ranked search, its results within a token budget."""
    return context.within_budget(search_queries.hybrid(spark, sf_dir))
