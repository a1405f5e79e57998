"""Named queries with their optional reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexigraph.sources.derived import FIXTURE_SQL, Derived

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(Derived) -> DataFrame``; ``sql`` may use the derived views as ``fx_*``.

    ``sql`` is either one SELECT or ``cte AS (...), cte2 AS (...) SELECT ...`` started by ``WITH``.
    """

    def wrap(fn):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = lambda spark, sf_dir: fn(Derived(spark, sf_dir))
        if sql is not None:
            body = sql.strip()
            if body[:4].upper() == "WITH":
                _SQL[name] = f"WITH RECURSIVE {FIXTURE_SQL},\n{body[4:].strip()}"
            else:
                _SQL[name] = f"WITH RECURSIVE {FIXTURE_SQL}\n{body}"
        return fn

    return wrap


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    return dict(_SQL)
