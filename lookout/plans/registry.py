"""Registry of the queries exposed to the driver (``queries()`` / ``oracle_sql()``).

Each query takes ``(spark, sf_dir)``, reads the driver tables, shapes them
with a telemetry view and runs one operator of the library. The oracle is
DuckDB SQL written from the operator's definition, not from the Spark plan.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return deco


def load_all() -> None:
    from . import q_detect, q_respond, q_read, q_stream  # noqa: F401
