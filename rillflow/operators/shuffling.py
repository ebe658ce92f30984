"""Shuffles: by hash, by hash within blocks, and the seeded buffer."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .position import with_position, written

#: Draws that the driver holds at a time.
CHUNK = 500_000


def seeded(seed: object) -> object:
    """The seed itself, or for None one that differs from process to process and from time to time."""
    import os
    import time

    return f"{os.getpid()}{time.time()}" if seed is None else seed


def hash_shuffle(df: DataFrame, seed: object = 0, order: str = "pos") -> DataFrame:
    """A full permutation: rows in order of the md5 of seed and position; the old position is in_pos."""
    key = F.md5(F.concat(F.lit(f"{seeded(seed)}:"), F.col("in_pos").cast("string")))
    rows = df.withColumnRenamed(order, "in_pos").withColumn("_h", key)
    return with_position(rows, ["_h", "in_pos"], order).drop("_h")


def block_shuffle(df: DataFrame, size: int = 1000, seed: object = 0, order: str = "pos") -> DataFrame:
    """Rows permuted by hash within blocks of size positions: no row moves by size or more. One shuffle, no global sort."""
    if size < 2:
        return df.withColumn("in_pos", F.col(order))
    key = F.md5(F.concat(F.lit(f"{seeded(seed)}:"), F.col("in_pos").cast("string")))
    rows = df.withColumnRenamed(order, "in_pos").withColumn("_h", key)
    block = F.floor(F.col("in_pos") / size).cast("long")
    inside = Window.partitionBy(block).orderBy("_h", "in_pos")
    return rows.withColumn(order, block * size + F.row_number().over(inside) - 1).drop("_h")


def buffer_chunks(n: int, size: int | None = 1000, initial: int = 100, seed: object = None) -> Iterator[list[int]]:
    """The input positions in output order of a buffer shuffle of n items, CHUNK at a time.

    The buffer takes an item, and a second while it is not full; from min(initial, size) items on, each step gives one
    drawn item whose place the last item fills; at the end the rest is drawn. A size under 2 changes nothing.
    """
    size = 1000 if size is None else size
    draw = random.Random(seeded(seed))
    start, held, out, at = min(initial, size), [], [], 0

    def give():
        k = draw.randint(0, len(held) - 1)
        out.append(held[k])
        last = held.pop()
        if k < len(held):
            held[k] = last

    while at < n or held:
        if size < 2:
            out.append(at)
            at += 1
        elif at < n:
            two = len(held) + 1 < size and at + 1 < n
            held.extend(range(at, at + 1 + two))
            at += 1 + two
            if len(held) >= start:
                give()
        else:
            give()
        if len(out) >= CHUNK:
            yield out
            out = []
    yield out


def buffer_order(n: int, size: int | None = 1000, initial: int = 100, seed: object = None) -> list[int]:
    return [i for chunk in buffer_chunks(n, size, initial, seed) for i in chunk]


def buffer_shuffle(df: DataFrame, size: int | None = 1000, initial: int = 100, seed: object = 0, order: str = "pos") -> DataFrame:
    """The seeded buffer shuffle itself. Its order depends only on the count and is one sequence of draws, so the driver
    makes it, a chunk at a time, and writes it to the shared folder; rows are then joined to it. block_shuffle has the same
    bound on how far a row moves, and needs no such sequence."""
    n, at = df.count(), 0

    def tables():
        nonlocal at
        for chunk in buffer_chunks(n, size, initial, seed):
            yield pa.table({order: range(at, at + len(chunk)), "in_pos": chunk}, schema=pa.schema([(order, pa.int64()), ("in_pos", pa.int64())]))
            at += len(chunk)

    drawn = written(df.sparkSession, tables(), f"{order} long, in_pos long")
    return df.withColumnRenamed(order, "in_pos").join(drawn, "in_pos")
