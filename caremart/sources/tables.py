"""SRC1-SRC4, SRC12-SRC13: table scans and dimension views."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caremart.schemas import CARE_SCHEMAS


def load_table(spark: SparkSession, directory: str, name: str, schema=None) -> DataFrame:
    """SRC1: scan one parquet table, with the declared care schema when it has one.

    A given schema skips footer inference across thousands of files; column
    pruning and filter pushdown reach the scan because the plan stays lazy.
    """
    schema = schema if schema is not None else CARE_SCHEMAS.get(name)
    path = os.path.join(directory, name if name.endswith(".parquet") else f"{name}.parquet")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


def active_dim(df: DataFrame, cols: Sequence[str] | None = None,
               order_by: Sequence[str | Column] = ("name",), active_col: str = "active") -> DataFrame:
    """SRC2-SRC4: active rows of a dimension, projected and ordered.

    Rows whose ``active`` flag is NULL are not active (SQL ``WHERE active``).
    """
    out = df.where(F.col(active_col)) if active_col in df.columns else df
    if cols:
        out = out.select(*cols)
    return out.orderBy(*order_by)


def staff_directory(users: DataFrame, roles: Sequence[str] = ("Staff", "Supervisor"),
                    role_col: str = "role", order_by: Sequence[str] = ("full_name",)) -> DataFrame:
    """SRC12: users whose role is one of ``roles``, ordered by name."""
    return users.where(F.col(role_col).isin(list(roles))).orderBy(*order_by)


def user_directory(users: DataFrame, cols: Sequence[str] | None = None,
                   order_by: Sequence[str] = ("role", "full_name")) -> DataFrame:
    """SRC13: the user list ordered by role then name."""
    out = users.select(*cols) if cols else users
    return out.orderBy(*order_by)
