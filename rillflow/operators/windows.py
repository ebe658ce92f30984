"""Batches and count windows over positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Positions of a block of windows, at least.
BLOCK = 4096


def items_of(df: DataFrame, order: str) -> Column:
    names = [c for c in df.columns if c != order]
    return F.struct(*names) if len(names) != 1 else F.col(names[0])


def batched(df: DataFrame, size: int, collation: list[Column] | None = None, drop_last: bool = True, order: str = "pos") -> DataFrame:
    """Consecutive groups of size rows: batch_id and items in order, or the aggregates of collation.

    drop_last leaves out a last group that is not full. A size of 0 gives no rows, a negative one is an error.
    """
    if size < 0:
        raise ValueError("a batch size cannot be negative")
    if size == 0:
        return batched(df.limit(0), 1, collation, drop_last, order)
    rows = df.withColumn("batch_id", F.floor(F.col(order) / size).cast("long"))
    aggs = collation or [F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("p"), items_of(df, order).alias("i")))), lambda x: x["i"]).alias("items")]
    out = rows.groupBy("batch_id").agg(F.count("*").alias("_n"), *aggs)
    return (out.where(F.col("_n") == size) if drop_last else out).drop("_n")


def sliding(df: DataFrame, window: int, stride: int = 1, drop_last: bool = True, least: int = 1, fill: bool = False, order: str = "pos") -> DataFrame:
    """Windows of window rows that start every stride rows: win_start and items.

    Partial windows at the end: none with drop_last; else those of at least `least` rows, or with fill all of them padded
    with nulls. A stream shorter than one window has, without drop_last, one window whatever `least` is. An empty stream
    has none.

    Rows are dealt into blocks of positions, and a block also gets the window-1 rows behind it, so that a row is moved
    twice at most; the windows of a block are slices of its rows.
    """
    if not (window > 1 and window > least >= 1 and window >= stride >= 1):
        raise ValueError("need window > 1, window > least >= 1 and window >= stride >= 1")
    size = -(-max(BLOCK, window) // stride) * stride  # windows start at the same places in every block
    home = F.floor(F.col(order) / size)
    halo = F.floor((F.col(order) - (window - 1)) / size)
    blocks = F.array_distinct(F.array(home.cast("long"), F.greatest(F.lit(0), halo).cast("long")))
    rows = df.select(F.col(order).alias("_p"), items_of(df, order).alias("_i"), F.explode(blocks).alias("_b"))
    held = rows.groupBy("_b").agg(F.array_sort(F.collect_list(F.struct("_p", "_i"))).alias("_r"), F.count_if(F.col("_p") < (F.col("_b") + 1) * size).alias("_own"))
    starts = held.select("_b", "_r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_own") - 1, F.lit(stride).cast("long"))).alias("_s"))
    cut = F.slice("_r", (F.col("_s") + 1).cast("int"), F.lit(window))
    out = starts.select((F.col("_b") * size + F.col("_s")).alias("win_start"), F.transform(cut, lambda x: x["_i"]).alias("items"))
    n = F.size("items")
    if drop_last:
        return out.where(n == window)
    only = F.col("win_start") == 0
    if fill:
        pad = F.array_repeat(F.element_at("items", -1), F.lit(window) - n)
        return out.withColumn("items", F.concat("items", F.transform(pad, lambda x: F.when(F.lit(False), x))))
    return out.where((n >= least) | only)
