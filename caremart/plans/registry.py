"""Registry of named queries: a Spark builder and (optionally) its DuckDB oracle per name.

Every double column of a result is snapped to 9 significant digits with
``floor(x * s + c) / s``, ``s = 10^(8 - floor(log10|x|))``, ``c = sqrt(2) - 1``, on both sides: the same IEEE
operations in both engines, so equal doubles stay equal (``round()`` differs between
engines on half-way values), and summation-order noise of large sums is far below
the last kept digit.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIGNIFICANT = 9
# Offset of the snap (sqrt(2) - 1): its boundary is neither a short decimal nor a dyadic
# fraction, the values floating-point arithmetic tends to land on exactly.
OFFSET = 0.41421356237309515


@dataclass
class QuerySpec:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doubles: Sequence[str] = field(default_factory=tuple)
    survey_ids: str = ""


REGISTRY: dict[str, QuerySpec] = {}


def snap_doubles(df: DataFrame) -> DataFrame:
    cols = []
    for name, dtype in df.dtypes:
        if dtype in ("double", "float"):
            x = F.col(name).cast("double")
            sc = F.pow(F.lit(10.0), F.lit(SIGNIFICANT - 1) - F.floor(F.log10(F.abs(x))))
            cols.append(F.when(x == 0, F.lit(0.0)).otherwise(F.floor(x * sc + OFFSET) / sc).alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)


def snap_sql(sql: str, doubles: Sequence[str]) -> str:
    if not doubles:
        return sql
    def one(c: str) -> str:
        x = f"CAST({c} AS DOUBLE)"
        sc = f"pow(10.0, {SIGNIFICANT - 1} - floor(log10(abs({x}))))"
        return f"CASE WHEN {x} = 0 THEN 0.0 ELSE floor({x} * {sc} + CAST({OFFSET!r} AS DOUBLE)) / {sc} END AS {c}"
    rep = ", ".join(one(c) for c in doubles)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) q"


def register(name: str, sql: str | None = None, doubles: Sequence[str] = (), ids: str = ""):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def deco(fn):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return snap_doubles(fn(spark, sf_dir))
        build.__name__ = fn.__name__
        build.__doc__ = fn.__doc__
        REGISTRY[name] = QuerySpec(name, build, snap_sql(sql, doubles) if sql else None, tuple(doubles), ids)
        return fn
    return deco
