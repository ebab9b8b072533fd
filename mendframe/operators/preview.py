"""Previews: first, last and repaired rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K


def head(df: DataFrame, order_by: str, n: int = K.PREVIEW_ROWS) -> DataFrame:
    return df.orderBy(order_by).limit(n)


def tail(df: DataFrame, order_by: str, n: int = K.PREVIEW_ROWS) -> DataFrame:
    return df.orderBy(F.desc(order_by)).limit(n).orderBy(order_by)


def repaired_rows(df: DataFrame, order_by: str, flag: str = "repaired", n: int = K.PREVIEW_ROWS) -> DataFrame:
    return df.filter(F.col(flag)).orderBy(order_by).limit(n)
