"""Named queries over the driver's tables, with a DuckDB oracle where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}
_loaded = False


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir), and the SQL that must give the same rows."""

    def keep(fn):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn

    return keep


def _load() -> None:
    global _loaded
    if not _loaded:
        _loaded = True
        from lodestone.plans import corpus_queries, ledger_queries, retrieval_queries, verify_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _ORACLES
