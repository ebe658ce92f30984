"""Operators that look at one row at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that go back to the JVM at once.
BATCH = 10_000


def mapped(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns added or replaced by expressions."""
    return df.withColumns(columns)


def filtered(df: DataFrame, predicate: Column | str) -> DataFrame:
    """Rows for which predicate holds; null counts as false."""
    return df.filter(predicate)


def truthy(col: Column, kind: str) -> Column:
    """Python's truth of a value of a Spark type name: zero, empty text, empty arrays and null are false."""
    if kind == "boolean":
        out = col
    elif kind in ("string", "binary"):
        out = F.length(col) > 0
    elif kind.startswith(("array", "map")):
        out = F.size(col) > 0
    else:
        out = col != 0
    return F.coalesce(out, F.lit(False))


def flattened(df: DataFrame, items: str, value: str = "value", order: str = "pos") -> DataFrame:
    """A row for each element of the array column items: order, inner_pos, value; empty and null arrays give none."""
    rest = [c for c in df.columns if c not in (items, order)]
    return df.select(order, *rest, F.posexplode(items).alias("inner_pos", value))


def schema_of(schema: str | StructType) -> StructType:
    return schema if isinstance(schema, StructType) else StructType.fromDDL(schema)


def in_batches(rows: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Dictionaries as Arrow batches of a schema: values keep their types, what is missing is null."""
    rows = iter(rows)
    while held := list(islice(rows, BATCH)):
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def map_partition(df: DataFrame, function: Callable[[Iterator[dict]], Iterable[dict]], schema: str | StructType) -> DataFrame:
    """function over the iterator of a partition's rows; resources that it opens last for the partition.

    Rows cross as Arrow data, so that integers beside nulls stay integers.
    """
    out = schema_of(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(function(row for b in batches for row in b.to_pylist()), arrow)

    return df.mapInArrow(run, out)


def map_rows(df: DataFrame, function: Callable[..., dict], schema: str | StructType, **kwargs) -> DataFrame:
    """function(row as dict, **kwargs) -> dict for every row, in Arrow batches: for what expressions cannot say."""
    return map_partition(df, lambda rows: (function(r, **kwargs) for r in rows), schema)


def filter_rows(df: DataFrame, predicate: Callable[..., object], **kwargs) -> DataFrame:
    """Rows for which predicate(row as dict, **kwargs) is true in Python's sense."""
    return map_partition(df, lambda rows: (r for r in rows if predicate(r, **kwargs)), df.schema)


def map_waiting(df: DataFrame, function: Callable[..., dict], schema: str | StructType, workers: int = 8, buffer: int = 100, **kwargs) -> DataFrame:
    """map_rows for a function that waits (for a store, a service): a task runs up to workers calls at once and keeps the
    order of rows; at most buffer results wait."""
    if workers < 1 or buffer < 1:
        raise ValueError("workers and buffer must be positive")

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        with ThreadPoolExecutor(workers) as pool:
            ahead = [pool.submit(function, r, **kwargs) for r in islice(rows, buffer)]
            while ahead:
                done = ahead.pop(0).result()
                ahead += [pool.submit(function, r, **kwargs) for r in islice(rows, 1)]
                yield done

    return map_partition(df, run, schema)
