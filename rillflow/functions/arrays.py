"""Nd-arrays in rows: flat data, type and shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode(data: Column, kind: str, shape: list[int]) -> Column:
    return F.struct(data.alias("data"), F.lit(kind).alias("type"), F.array(*[F.lit(n) for n in shape]).alias("shape"))


def to_json(data: Column, kind: str, shape: list[int]) -> Column:
    return F.to_json(encode(data, kind, shape))


def from_json(text: Column) -> Column:
    return F.from_json(text, "data array<double>, type string, shape array<int>")


def rows_of(data: Column, width: int) -> Column:
    """Flat data as an array of rows of width values."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(data) - 1) / width).cast("int")), lambda i: F.slice(data, i * width + 1, F.lit(width)))


def flat(nested: Column) -> Column:
    return F.flatten(nested)
