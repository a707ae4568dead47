"""All queries of the engine by name, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_queries: dict = {}
_oracle: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) as a query, with DuckDB SQL for the same rows."""

    def put(f):
        if name in _queries:
            raise ValueError(f"query {name} is there already")
        _queries[name] = f
        if sql is not None:
            _oracle[name] = sql
        return f

    return put


def _load() -> None:
    """Import the modules that register queries."""
    from quillgrid.plans import discovery_queries, metric_queries, model_queries, other_queries, part_queries, run_queries, scalar_queries, table_queries, wide_queries  # noqa: F401


def queries() -> dict:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracle)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return _queries["a09_decision_source_metrics"](spark, sf_dir)
