"""Taking, repeating, numbering and splitting streams."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def take(df: DataFrame, n: int | None, order: str = "pos") -> DataFrame:
    """The first n rows by position; None takes all, a negative n is an error."""
    if n is None:
        return df
    if n < 0:
        raise ValueError("cannot take a negative number of rows")
    return df.where(F.col(order) < n)


def loop(df: DataFrame, n: int | None = None, count: int | None = None, order: str = "pos") -> DataFrame:
    """df n times over, with epoch and a new position. count: the rows of df, counted if not given.

    Without n the stream has no end, so only loop_take can run it.
    """
    if n is None:
        raise ValueError("an endless loop needs a take: use loop_take")
    total = df.count() if count is None else count
    epochs = F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1))).alias("epoch")
    out = df.select("*", epochs) if n > 0 else df.select("*", epochs).limit(0)
    return out.withColumn(order, F.col("epoch").cast("long") * total + F.col(order))


def loop_take(df: DataFrame, k: int, order: str = "pos") -> DataFrame:
    """The first k rows of df repeated without end; an empty df gives none."""
    total = df.count()
    return take(loop(df, math.ceil(k / total) if total else 0, total, order), k, order)


def numbered(df: DataFrame, pad: int | None = None, name: str = "idx", order: str = "pos") -> DataFrame:
    """df with its position as name; with pad as text of at least pad digits, never cut."""
    return df.withColumn(name, F.col(order) if pad is None else F.format_string(f"%0{pad}d", F.col(order)))


def split(df: DataFrame, index: int, of: int, order: str = "pos", reindex: bool = True) -> DataFrame:
    """Every of-th row from index on, as position // of if reindex; of <= 1 is all rows."""
    if of <= 1:
        return df
    out = df.where(F.col(order) % of == index)
    return out.withColumn(order, F.floor(F.col(order) / of).cast("long")) if reindex else out
