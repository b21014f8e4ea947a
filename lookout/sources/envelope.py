"""Stream envelopes: decode and dead-letter split."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def decode_envelope(df: DataFrame, schema: T.StructType, data: str = "data") -> DataFrame:
    """S3: ``data`` JSON -> typed columns (PERMISSIVE: bad text gives NULLs)."""
    parsed = F.from_json(F.col(data), schema)
    return df.withColumn("__d", parsed).select(
        *[c for c in df.columns], *[F.col(f"__d.{f.name}").alias(f.name) for f in schema.fields])


def decode_flat(df: DataFrame, fields: list[str]) -> DataFrame:
    """S3, flat form: each listed string field holds a JSON value or a plain
    string; both become VARIANT columns (JSON parsed, anything else kept as a
    JSON string)."""
    out = df
    for f in fields:
        as_string = F.variant_get(F.parse_json(F.to_json(F.array(F.col(f)))), "$[0]", "variant")
        out = out.withColumn(f, F.when(F.col(f).isNotNull(),
                                       F.coalesce(F.try_parse_json(F.col(f)), as_string)))
    return out


def split_dead_letters(df: DataFrame, source: str, data: str = "data", id_col: str = "id",
                       ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """(good rows, dead letters). A row is dead when ``data`` is not a JSON
    document; dead letters keep source, id, reason, the first 500 chars and time."""
    ok = F.try_parse_json(F.col(data)).isNotNull()
    good = df.filter(ok)
    dead = df.filter(~ok | F.col(data).isNull()).select(
        F.lit(source).alias("source"), F.col(id_col).cast("string").alias("msg_id"),
        F.lit("json_decode_error").alias("reason"),
        F.substring(F.coalesce(F.col(data), F.lit("")), 1, 500).alias("data"),
        F.col(ts).alias("ts"))
    return good, dead


def handled(df: DataFrame, handler: Callable, args: list[Column], returns: str) -> tuple[DataFrame, DataFrame]:
    """(done, failed). ``handler`` is called with ``args`` of each row; ``done``
    has its ``value``, ``failed`` the ``error`` that it raised. One row's error
    stops neither the others nor the job; rows are handled in Arrow batches."""
    def run(*columns: pd.Series) -> pd.DataFrame:
        out = []
        for row in zip(*columns):
            try:
                out.append((handler(*row), None))
            except Exception as exc:  # noqa: BLE001 - whatever the handler raises is the row's error
                out.append((None, f"{type(exc).__name__}: {exc}"))
        return pd.DataFrame(out, columns=["value", "error"])

    d = df.withColumn("__h", F.pandas_udf(run, f"value {returns}, error string")(*args))
    failed = F.col("__h.error").isNotNull()
    return (d.filter(~failed).select(*df.columns, "__h.value"), d.filter(failed).select(*df.columns, "__h.error"))


def processing_dead_letters(failed: DataFrame, source: str, reason: str = "error",
                            id_col: str = "id", ts: str = "ts") -> DataFrame:
    """S4, processing-error variant: rows whose handling failed (``reason``
    holds the error text) become dead letters with the reason cut to 200 chars."""
    return failed.select(
        F.lit(source).alias("source"), F.col(id_col).cast("string").alias("msg_id"),
        F.substring(F.coalesce(F.col(reason).cast("string"), F.lit("")), 1, 200).alias("reason"),
        F.col(ts).alias("ts"))
