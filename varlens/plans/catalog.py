"""Registry of the queries run over the driver tables.

Each entry pairs a Spark query ``fn(spark, sf_dir) -> DataFrame`` with the
DuckDB SQL that computes the same table (or None when the operator is not
expressible in SQL and is checked on row counts and by unit tests).  Double
columns are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from varlens.functions.exprs import round_doubles

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None, rounded: bool = True):
    """Decorator adding a query (and its oracle SQL) under ``name``."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return round_doubles(df) if rounded else df

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return fn
    return deco


def _load_all() -> None:
    # Importing the modules fills the registry.
    from varlens.plans import (q_archive, q_curves, q_tables, q_splits, q_density,  # noqa: F401
                               q_features, q_sequence, q_stats, q_ml, q_io)


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_SQL)


def r6(expr: str, alias: str) -> str:
    """SQL for a double output column rounded like ``round_doubles``."""
    x = f"CAST({expr} AS DOUBLE)"
    r = f"CAST(floor({x} * CAST('1000000.0' AS DOUBLE) + CAST('0.5' AS DOUBLE)) AS DOUBLE) / CAST('1000000.0' AS DOUBLE)"
    return f"(CASE WHEN abs({x}) < CAST('1e12' AS DOUBLE) THEN {r} ELSE {x} END) + CAST('0.0' AS DOUBLE) AS {alias}"


def dbl(x: float) -> str:
    """A double literal in SQL that parses to exactly the Python float."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def lin_sql(k: str, start: float, stop: float, num: int) -> str:
    """SQL for the k-th value of np.linspace(start, stop, num)."""
    step = (float(stop) - float(start)) / (num - 1)
    return f"(CASE WHEN {k} = {num - 1} THEN {dbl(stop)} ELSE CAST({k} AS DOUBLE) * {dbl(step)} + {dbl(start)} END)"
